"""Fingerprints, spelling groups and lexical search against brute force, and on unusual input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from framescope.llm import fingerprints as FP
from framescope.llm import queries
from framescope.llm import lexical_search as LS
from framescope.llm import spelling_groups as SG

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, word string, n string, shard string, term string, task string, row string, code string"
EXTRA = ("a", "b", "c", "d", "e", "f", "g")
EDGE = [
    (1, None, *EXTRA),
    (1, "", *EXTRA),
    (2, "Hello hello hellq, hello", *EXTRA),
    (2, "Hello hello hellq, hello", *EXTRA),
    (2, "other words here", *EXTRA),
    (None, "Hello of no one", *EXTRA),
    (None, "Hello of no one", *EXTRA),
    (3, "words " * 300_000, *EXTRA),
    (4, "x" * 2_000_000, *EXTRA),
    (5, "  \n\t ", *EXTRA),
    (6, "Ünder Éa ÿes naïve naive naïve naive naive naïve ÀÀÀÀÀ", *EXTRA),
    (9_007_199_254_740_993, "Hello", *EXTRA),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Fingerprints


def in_order(rows):
    """The documents as the query puts them in order, for distinct identifiers."""
    return sorted(rows, key=lambda r: -r["doc_id"])


def multiset_likeness(a: str, b: str) -> float:
    x, y = (Counter(parts) for parts in FP.paragraphs([a, b]))
    total = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / total if total else 1.0


def test_fingerprints_equal_brute_force(spark, docs):
    got = {r["doc_id"]: r for r in queries.op11_fingerprints(spark, SF).collect()}
    rows = in_order(docs.collect())
    assert len(got) == len(rows)
    for row, following in zip(rows, [*rows[1:], rows[0]], strict=True):
        text, other = row["text"] or "", following["text"] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        result = got[row["doc_id"]]
        assert result["n_chars"] == len(text)
        assert result["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert result["near_edited"] == pytest.approx(multiset_likeness(text, edited))
        assert result["near_next"] == pytest.approx(multiset_likeness(text, other))
    by_text = defaultdict(set)
    for row in rows:
        by_text[row["text"]].add(got[row["doc_id"]]["fingerprint"])
    assert all(len(prints) == 1 for prints in by_text.values())
    assert len({p for prints in by_text.values() for p in prints}) == len(by_text)


def test_fingerprint_string_is_the_sketch():
    sets = FP.digests(["one\ntwo\nthree", "one\ntwo\nfour", ""])
    again = FP.Sketches.of_strings(FP._sketch(sets, FP.CELLS).strings())
    left = FP.Sketches.of_strings(again.strings()[:1]).minus(FP.Sketches.of_strings(again.strings()[1:2]))
    decoded, _, digest, sign = left.peel()
    assert decoded.all()
    assert set(digest[sign > 0]) == set(sets[0]) - set(sets[1])
    assert set(digest[sign < 0]) == set(sets[1]) - set(sets[0])


def test_differences_come_back_at_every_size():
    rng = np.random.default_rng(5)
    before, after = [], []
    for size in (0, 1, 2, 5, 10, 40, 200, 3000):
        for shared in (0, 1, 500):
            common = rng.integers(0, 2**63, shared).astype(np.uint64)
            before.append(np.concatenate([common, rng.integers(0, 2**63, size).astype(np.uint64)]))
            after.append(np.concatenate([common, rng.integers(0, 2**63, size // 2).astype(np.uint64)]))
    for a, b, (removed, added, cells) in zip(before, after, FP.differences(before, after), strict=True):
        assert set(removed) == set(a) - set(b) and len(removed) == len(set(a) - set(b))
        assert set(added) == set(b) - set(a) and len(added) == len(set(b) - set(a))
        assert cells >= FP.CELLS


def test_paragraphs_hold_all_words_and_end_at_lines():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", "déf", " ", "  ", "\n", " ", "　", "😀", "word "]) for _ in range(60))
        parts = [p.decode("utf-32-le") for p in FP.paragraphs([text])[0]]
        assert "".join(parts).split() == "".join(parts).split()
        assert [w for p in parts for w in p.split()] == text.split()
        assert all(p == p.strip() and p and len(p.splitlines()) == 1 for p in parts)
    both = FP.paragraphs(["one two", "one two", "", "three"])
    assert both[0] == both[1] and both[2] == [] and len(both) == 4


def test_an_edit_changes_few_paragraphs(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    changed = [*words[:1000], "inserted", *words[1000:]]
    rows = [(1, " ".join(words), " ".join(changed), "x"), (2, None, None, "x"), (3, "a", None, "x")]
    frame = spark.createDataFrame(rows, "id bigint, text string, other string, before string")
    got = {r["id"]: r for r in FP.compare_versions(frame, "id", "text", "other").collect()}
    assert 1 <= len(got[1]["removed"]) <= 2 and 1 <= len(got[1]["added"]) <= 3 and got[1]["likeness"] > 0.98
    assert got[2]["likeness"] == 1.0 and got[3]["likeness"] == 0.0 and len(got[3]["removed"]) == 1


def test_fingerprints_of_unusual_rows(spark, edge, empty):
    got = FP.edited_fingerprints(edge).collect()
    assert len(got) == len(EDGE)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in EDGE)
    assert FP.edited_fingerprints(empty).count() == 0
    assert FP.document_fingerprints(empty).count() == 0
    prints = FP.document_fingerprints(edge).collect()
    assert len(prints) == len(EDGE) and prints[0]["n_paragraphs"] == 0
    one = spark.createDataFrame([(7, "alone in here")], "doc_id bigint, text string")
    only = FP.edited_fingerprints(one).first()
    assert only["near_next"] == 1.0
    assert only["edited_sha256"] == hashlib.sha256(b"alone ialone ").hexdigest()
    same = spark.createDataFrame([(None, "the very same text")] * 500, "doc_id bigint, text string").repartition(8)
    equal = FP.edited_fingerprints(same).select("fingerprint", "near_next").distinct().collect()
    assert len(equal) == 1 and equal[0]["near_next"] == 1.0


# Spelling groups


def brute_words(rows, every):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{word}".encode())
            if every and h % every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= 5:
                counts[word] += 1
    return counts


def edits(word, letters):
    near = {word[:i] + word[i + 1 :] for i in range(len(word))}
    near |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    near |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return near - {word}


def brute_groups(counts):
    letters = sorted({c for w in counts for c in w})
    form, near_count = {}, {}
    for word, n in counts.items():
        near = [w for w in edits(word, letters) if w in counts]
        near_count[word] = len(near)
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form[word] = best if best is not None and counts[best] >= 2 * n else None
    out = {}
    for word, n in counts.items():
        root = word
        while form[root] is not None:
            root = form[root]
        out[word] = (form[word], root, n, near_count[word], counts[form[word]] if form[word] else None)
    return out


def groups_of(frame):
    rows = frame.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_spelling_groups_equal_brute_force(spark, docs):
    counts = brute_words([(r["doc_id"], r["text"]) for r in docs.collect()], 97)
    assert {r["word"]: r["n"] for r in SG.document_words(docs, 97).collect()} == counts
    kept = {w: n for w, n in counts.items() if n >= 3}
    assert groups_of(queries.op12_spelling_groups(spark, SF)) == brute_groups(kept)


def test_neighbourhoods_are_complete_and_without_repeats():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    reduced = SG.Reduced(words, 3, already=True)
    found = defaultdict(list)
    for place, code in reduced.neighbours():
        for p, c in zip(place.tolist(), code.tolist(), strict=True):
            found[p].append(c)
    for p, word in enumerate(words):
        want = sorted(edits(word, "abc") | {word})
        hashes = SG.Reduced(want, 3, already=True).hashes().tolist()
        assert sorted(found[p]) == sorted(hashes)


def test_dense_vocabulary_and_long_chains(spark):
    rng = random.Random(7)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 7))): rng.randint(3, 60) for _ in range(900)}
    counts |= {"z" * 10 + "y" * i: 3 * 2**i for i in range(20)}  # a chain through twenty forms
    counts |= {"q" * 5000: 5, "q" * 4999: 20, "q" * 4999 + "r": 9}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = groups_of(SG.spelling_groups(vocabulary))
    assert got == brute_groups(counts)
    assert got["z" * 10][1] == "z" * 10 + "y" * 19
    assert got == groups_of(SG.spelling_groups(vocabulary, symbols=2))


def test_spelling_joins_broadcast_nothing(spark):
    """Neighbourhoods are many times as large as Spark takes them for, so no join may choose by that size."""
    words = spark.createDataFrame([("hello", 9), ("hellq", 3), ("other", 3)], "word string, n bigint")
    for frame in (SG.near_words(words), SG.spelling_groups(words)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_words_of_unusual_rows(edge, empty):
    rows = [(r[0], r[1]) for r in EDGE]
    for every in (0, 97, 2):
        got = SG.document_words(edge, every).collect()
        assert {r["word"]: r["n"] for r in got} == dict(brute_words(rows, every))
    assert SG.document_words(empty, 97).count() == 0
    assert SG.spelling_groups(SG.document_words(empty)).count() == 0


# Lexical search


def brute_terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute_search(docs, items, k=10):
    counted = [(i, Counter(brute_terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    frequency = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        terms = [t for t in set(brute_terms(text)) if t in frequency]
        scores = []
        for doc_id, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for t in terms:
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) if c[t] else 0
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, missing, doc_id) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if missing else doc_id, -score))
    return Counter(out)


def results(frame):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect())


def test_search_equals_brute_force(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute_search([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert results(queries.op13_lexical_search(spark, SF)) == want


def test_search_in_small_shards_and_blocks(spark, docs, monkeypatch):
    """Shards, blocks and cells of a few rows give the same results; ties span many shards."""
    for name, value in (("SHARD_DOCS", 7), ("BLOCK_QUERIES", 3), ("CELLS", 50)):
        monkeypatch.setattr(LS, name, value)
    copies = docs.filter("doc_id < 20").withColumn("doc_id", F.explode(F.array(*[F.col("doc_id") + 100 * i for i in range(9)])))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").filter("item_id < 7")
    want = brute_search([tuple(r) for r in copies.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert results(LS.search_index(LS.build_index(copies), items)) == want


def test_strata_below_the_kth_score_are_left_out():
    lengths = np.array([5] * 20 + [500] * 20)
    index = LS.LexicalIndex(None, 40, int(lengths.sum()))
    search = LS.ShardSearch(index, [["a"]], {"a": 100}, 10)
    seen = []
    original = np.nonzero
    postings = [("a", np.ones(40, np.int32), np.arange(40, dtype=np.int32))]
    try:
        np.nonzero = lambda x: seen.append(x.shape) or original(x)
        query, row, score = search(np.arange(40), lengths, postings)
    finally:
        np.nonzero = original
    assert row.tolist() == list(range(10)) and len(set(score.tolist())) == 1 and set(query.tolist()) == {0}
    assert [shape for shape in seen if len(shape) == 2] == [(1, 20)]  # the long documents' stratum was never added up


def test_search_of_unusual_rows(spark, edge, empty):
    items = [(1, "hello"), (1, "hello"), (2, None), (3, "!!!"), (None, "Words of ÿes"), (4, "unknownterm"), (5, "X" * 2_000_000)]
    asked = spark.createDataFrame([(*i, "s") for i in items], "item_id bigint, text string, score string")
    got = results(LS.search_index(LS.build_index(edge), asked))
    assert got == brute_search([(r[0], r[1]) for r in EDGE], items)
    assert any(key[:3] == (1, 3, 9_007_199_254_740_993) for key in got)  # identifiers keep all their digits
    assert LS.search_index(LS.build_index(empty), asked).count() == 0
    assert LS.search_index(LS.build_index(edge), asked.limit(0)).count() == 0
