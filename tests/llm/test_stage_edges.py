"""Nulls, repeats, clashing names, tiny sample rates and very long texts in operators and pipeline stages."""

from __future__ import annotations

from array import array
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from framescope.llm import packing, quality_pu, queries, url_filter
from framescope.llm.content_sort import content_groups, distinct_contents
from framescope.llm.language_id import fit_language_model, identify_languages
from framescope.llm.minhash_dedup import near_groups
from framescope.llm.mixing import mix_sources

SF = "/root/testdata/sf0.01"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
#: Names that an operator could use for columns of its own.
CLASHING = [
    "_id", "_sha", "_md5", "_source", "_rate", "_draw", "_copies", "row", "id", "sha", "md5", "name", "rate", "draw",
    "copies", "tie", "start", "length", "sequence_id", "score", "predicted", "kept", "text_md5", "head", "full",
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHING)
TEXT = " ".join(f"word{i}" for i in range(40))
ROWS = [
    (-1, TEXT, "en", "a", 1), (None, TEXT, "en", "a", 1), (None, TEXT, "en", None, 1), (5, TEXT + " more", "en", "b", 2),
    (5, TEXT + " more", "en", "b", 2), (None, "only here without an identifier", "en", "b", 3), (-1, "another text", "fr", "b", 4),
    (7, None, None, None, None), (8, "", "en", "a", 0), (None, "", "en", "a", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *[f"{c}-{i}" for c in CLASHING]) for i, r in enumerate(ROWS)], SCHEMA)


def whole(frame):
    return Counter(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("char", [" ", "\n", "\t", " "])
def test_long_runs_of_blanks(char):
    ids, library = packing.text_ids(BYTES), Tokenizer.from_file(BYTES)
    for text in (
        char * 1200, "word" + char * 1000 + "word", char * 700 + "a" + char * 501 + "\n" * 600, "x" + char * 800 + " y",
        "x " + char * 500 + "\x1c" * 3 + char * 500, "'s" + char * 999 + "'s", "a" + char * 499 + "b" + char * 500,
        (char + "\n ") * 400 + "z",
    ):
        assert ids.document(text) == array("I", library.encode(text, add_special_tokens=False).ids).tobytes()


@pytest.mark.parametrize("size", [1_000_000, 5_000_000, 20_000_000])
def test_very_long_texts_are_packed(spark, size):
    texts = [" " * size, "word" + "\n" * size, "ab" * (size // 2)] if size < 20_000_000 else [" " * size, "\n" * size + "x"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(len(texts))
    rows = packing.pack_documents(frame, BYTES).drop("row").collect()
    for doc_id, text in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["start"])
        assert [r["start"] for r in own] == [sum(r["length"] for r in own[:i]) for i in range(min(3, len(own)))] + [
            r["start"] for r in own[3:]
        ]
        assert sum(r["length"] for r in own) == own[0]["doc_tokens"] > len(text) // 20
    full = [r for r in rows if r["length"] == packing.CAPACITY]
    assert len({r["sequence_id"] for r in full}) == len(full) and all(r["offset"] == 0 for r in full)
    rest = {r["sequence_id"] for r in rows if r["length"] < packing.CAPACITY}
    assert not rest & {r["sequence_id"] for r in full}


def test_tiny_rates_still_learn(spark, docs):
    """However many rows there are of a kind, some are sampled and nothing crashes."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert quality_pu.draw_limit(1e-18) >= 1 and quality_pu.draw_limit(1.0) > quality_pu.draw_limit(0.5)
    assert quality_pu.draw_limit(6_000 / 6e10) / (1 << 60) == pytest.approx(1e-7)
    model = quality_pu.fit_quality(docs, labels, F.lit(True), fit_rows=60)
    assert model is not None
    scores = quality_pu.score_quality(docs, model, ["doc_id"]).agg(F.min("score"), F.max("score")).first()
    assert scores[0] < 0.3 <= scores[1]
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = url_filter.url_rows(pages, queries.URL_RULES)
    rows = url_filter.small_join(rows, url_filter.suffix_statistics(rows), "suffix")
    assert not isinstance(url_filter.fit_url_trees(rows, fit_urls=20), str)


def test_languages_of_rows_without_identifiers(spark, docs):
    unknown = docs.withColumn("doc_id", F.lit(None).cast("bigint"))
    model = fit_language_model(unknown, fit_texts=60)
    got = identify_languages(unknown.withColumn("doc_id", F.monotonically_increasing_id()), model, F.lit(False))
    truth = docs.select(F.monotonically_increasing_id().alias("doc_id"), "lang")
    right = got.join(truth, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.9


def test_missing_identifiers_stay_missing(odd):
    """-1 is an identifier like any other; a row without one is kept only where its group has no other."""
    for largest in (True, False):
        got = content_groups(odd, largest).collect()
        assert sum(r["doc_id"] is None for r in got) == 4 and len(got) == len(ROWS)
        same = [r for r in got if r["group_size"] == 3 and r["doc_id"] != 7]
        assert {r["keep_id"] for r in got if r["doc_id"] == -1 and r["group_size"] == 3} == {-1}
        assert sum(r["kept"] for r in got) == 5 and len(same) >= 3
        alone = [r for r in got if r["doc_id"] is None and r["group_size"] == 1]
        assert len(alone) == 1 and alone[0]["kept"] and alone[0]["keep_id"] is None
    near = near_groups(odd).collect()
    assert sum(r["doc_id"] is None for r in near) == 4
    group = [r for r in near if r["group_size"] == 5]
    assert len(group) == 5 and {r["group_id"] for r in group} == {-1}
    lonely = [r for r in near if r["doc_id"] is None and r["group_size"] == 1]
    assert len(lonely) == 1 and lonely[0]["kept"] and lonely[0]["group_id"] is None


def test_stages_return_all_columns_as_they_were(spark, odd):
    labels = spark.createDataFrame([(5, 1), (8, 0), (-1, 1)], "doc_id bigint, quality int")
    labels.write.mode("overwrite").parquet("/tmp/framescope-test-stages/labels.parquet")
    given = whole(odd)
    frame = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, "/tmp/framescope-test-stages")
        assert out.columns == odd.columns, name
        rows = whole(out)
        assert set(rows) <= set(given), name
        if name != "mixing":
            assert all(n <= given[r] for r, n in rows.items()), name
            frame = out
    assert whole(distinct_contents(odd, True)).total() == 5
    name, pack = corpus_pipeline.STAGES[-1]
    pieces = pack(spark, odd, "").collect()
    assert sum(r["start"] == 0 for r in pieces) == len(ROWS)


def test_stages_on_empty_tables_and_without_labels(spark, odd):
    spark.createDataFrame([], "doc_id bigint, quality int").write.mode("overwrite").parquet(
        "/tmp/framescope-test-unlabelled/labels.parquet"
    )
    empty = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/tmp/framescope-test-unlabelled").count() == 0, name
    _, keep = corpus_pipeline.STAGES[0]
    assert whole(keep(spark, odd, "/tmp/framescope-test-unlabelled")) == whole(odd)


def test_mixing_rows_without_identifiers(spark):
    """A third of all rows without an identifier, or with one in common, is repeated and spread like the others."""
    same = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(4)).otherwise(F.col("id"))
    frame = spark.range(6000).select(
        same.cast("bigint").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 1500).cast("string")).alias("text"), F.lit("s").alias("source")
    )
    mixed = mix_sources(frame.repartition(8))
    nulls = mixed.filter("doc_id IS NULL")
    assert nulls.select("position").distinct().count() > 0.99 * nulls.count() > 3000
    copies = Counter(r["count"] for r in mixed.filter("doc_id = 4").groupBy("text").count().collect())
    assert len(copies) > 3  # rows that share an identifier, but not the text, draw on their own
    equal = frame.limit(1).crossJoin(spark.range(5000)).drop("id").withColumn("doc_id", F.lit(9).cast("bigint"))
    parts = mix_sources(equal, spark.createDataFrame([("s", 3.0)], "source string, rate double"))
    spread = parts.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    total = sum(r["count"] for r in spread)
    assert total == 0 or len(spread) > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_mixing_splits_large_rates_like_its_sql(spark):
    rates = spark.createDataFrame([("tiny", 900.0), ("s", 1.0)], "source string, rate double")
    frame = spark.createDataFrame([(i, f"t{i}", "tiny" if i < 5 else "s") for i in range(50)], "doc_id bigint, text string, source string")
    counts = mix_sources(frame, rates).groupBy("source").count().collect()
    tiny = {r["source"]: r["count"] for r in counts}["tiny"]
    assert abs(tiny - 4500) < 5 * 4500**0.5


def test_mixing_sql_has_no_cap(spark, tmp_path):
    """A source with one byte has a rate in the thousands; the SQL gives the same rows."""
    import duckdb

    rows = [(0, "x", "tiny"), (1, None, None)] + [(i, "long text " * 4000, f"s{i % 3}") for i in range(2, 40)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_mixing(spark, str(tmp_path))
    assert got.filter("source = 'tiny'").count() > 745
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    result = connection.execute(queries.ORACLE["op10_mixing"])
    columns = [d[0] for d in result.description]
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(result.fetchall())


def test_token_counts_of_texts_without_a_cut():
    """Equal to the scan and to the library, and in proportion to the length."""
    import time

    import sentencepiece

    from framescope.llm.token_counts import piece_machine, piece_text

    model = public_tokenizers.path("piece_bpe_32k.model")
    machine, library = piece_machine(model), sentencepiece.SentencePieceProcessor(model_file=model)
    for text in ("ab" * 3000, "word " * 2000, "a" * 5000 + " b" * 500, "x"):
        for chunk in (7, 100, 1000, 10**6):
            got = machine.count(piece_text(text), chunk)
            assert got == machine.prefix_counts(piece_text(text), chunk)[-1] == len(library.encode(text))
    seconds = []
    for size in (100_000, 400_000):
        start = time.perf_counter()
        machine.count(piece_text("ab" * size))
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 8 * seconds[0] + 0.2


def url_pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1.0) for r in rows], "page_id bigint, url string, rule string, host string, features double")


def test_url_trees_judge_hosts_that_no_rule_names(spark):
    """Lexical signs learnt from the hosts of the rules hold on other hosts; the suffix says nothing here."""
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9)))

    def url(host, bad):
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randint(4, 12)))
        if bad:
            return f"http://{host}/{word()}{digits}?id={digits}&ref={word()}&sid={digits}"
        return f"http://{host}/{word()}/{word()}-{word()}" + rng.choice(["", f"?page={rng.randint(1, 9)}", "/"])

    rows, truth = [], {}
    hosts = {verdict: [f"{word()}.net" for _ in range(30)] for verdict in ("block", "allow")}
    for i in range(4000):
        bad = rng.random() < 0.5
        wrong = rng.random() < 0.03  # rules are right but for a few URLs
        host = rng.choice([rng.choice(hosts["block" if bad != wrong else "allow"]), f"{word()}.net"])
        truth[i] = "block" if bad else "allow"
        rows.append((i, url(host, bad)))
    rules = [url_filter.Rule(h, "/", verdict) for verdict, named in hosts.items() for h in named]
    got = url_filter.filter_urls(url_pages(spark, rows), rules).filter("rule IS NULL").collect()
    right = sum(r["verdict"] == truth[r["page_id"]] for r in got) / len(got)
    assert len(got) > 1500 and right > 0.97


def test_url_filter_of_unusual_rows(spark):
    """Repeated rows, very long URLs and columns of the same names; rules that show one verdict only."""
    urls = ["http://a.org/x", "http://a.org/x", None, "", "http://b.com/de/" + "a1-" * 200_000, "http://c.net/?" + "k=v&" * 50_000, "http://b.com/fr/"]
    pages = url_pages(spark, list(enumerate(urls)) + [(0, urls[0]), (None, urls[0])])
    got = url_filter.filter_urls(pages, queries.URL_RULES).collect()
    assert len(got) == 9 and all(r["verdict"] in ("allow", "block") for r in got)
    assert [r["verdict"] for r in got if r["host"] == "a.org"] == ["allow"] * 4
    one = url_filter.filter_urls(pages, [url_filter.Rule("org", "/", "block")]).collect()
    assert all(r["verdict"] == "block" for r in one)
    none = url_filter.filter_urls(pages, []).collect()
    assert all(r["verdict"] == "allow" and r["rule"] is None for r in none)


def test_vectors_with_clashing_columns_and_a_large_bucket(spark):
    """Names of the operator's own columns, and one dense group that fills several tiles with different vectors."""
    import numpy as np

    from framescope.llm.embedding_dedup import near_vectors

    rng = np.random.default_rng(11)
    centre = rng.normal(size=32)
    x = np.vstack([centre + 0.09 * rng.normal(size=(1400, 32)), rng.normal(size=(600, 32))]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0, *"abcdefg") for i, r in enumerate(x)]
    names = ["rep", "digest", "component", "members", "task", "code", "d"]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, " + ", ".join(f"{n} string" for n in names))
    got = {r["vec_id"]: r for r in near_vectors(frame).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = unit @ unit.T >= 0.98
    np.fill_diagonal(linked, False)
    found, real = sum(r["n_links"] for r in got.values()), int(linked.sum())
    assert real > 100_000 and 0.999 * real <= found <= real and len(got) == 2000


def test_stored_codes_survive_their_bytes():
    import numpy as np

    from framescope.llm import embedding_dedup as ED

    for d in (1, 5, 63, 64, 65, 200):
        unit = np.random.default_rng(d).normal(size=(20, d))
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        codes = ED.encode(unit)
        again = ED.Codes.of_blobs(codes.blobs(), d)
        for a, b in zip(ED.estimate_codes(codes, codes, 0.98), ED.estimate_codes(again, again, 0.98), strict=True):
            assert np.array_equal(a, b)
        value, half = ED.estimate_codes(codes, codes, 0.98)
        assert (np.abs(value - 1)[np.eye(20, dtype=bool)] <= half[np.eye(20, dtype=bool)] + 1e-9).all()
