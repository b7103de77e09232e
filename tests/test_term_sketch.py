"""Vocabularies from bucket sums, and terms matched as numbers: the same results as counting every n-gram."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framescope.functions import text as X
from framescope.functions.lookup import literal_lookup
from framescope.operators import term_sketch as S
from framescope.operators import tfidf as T

_WORDS = ["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op"]


def _rows(spark, n=60):
    texts = [" ".join(_WORDS[(i * i + j * (1 + i % 5)) % (2 + j % 7)] for j in range(i % 23)) for i in range(n)]
    texts += [None, "", "é ab AB cd", "rare " * 9, "rare2 rare2"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize(("low", "high", "limit"), [(1, 3, 12), (1, 3, 100_000), (2, 3, 5), (1, 1, 3)])
def test_vocabulary_is_that_of_all_counts(spark, low, high, limit):
    rows = _rows(spark)
    plain = T.vocabulary(T.term_counts(rows, low=low, high=high), rows.count(), 2, limit).collect()
    fitted = T.TfidfModel.fit(rows, "text", "doc_id", low, high, 2, limit)
    assert fitted.terms == tuple(sorted(r["term"] for r in plain))
    assert fitted.idf == tuple(r["idf"] for r in sorted(plain, key=lambda r: r["term"]))


def test_bound_is_lowered_until_no_other_term_can_be_kept(spark):
    """Terms in one row only fill the highest buckets; the ones kept are far below them."""
    rows = spark.createDataFrame(
        [(i, f"single{i} " * 50) for i in range(40)] + [(100 + i, "ab cd") for i in range(3)], "doc_id long, text string"
    )
    assert T.TfidfModel.fit(rows, "text", "doc_id", 1, 1, 2, 2).terms == ("ab", "cd")


def test_second_bound_is_the_last_and_counts_few_buckets(spark, monkeypatch):
    """Where other terms in their buckets make a first guess too high, the counts it gave are a bound that holds."""
    seen = []

    def crowded(tokens, low, high):
        rows, sums = S.term_sketch(tokens, low, high)
        return rows, np.where(sums == 20, 1000, sums)

    def spy(tokens, wanted, low, high):
        seen.append(int(wanted.sum()))
        return S.count_terms_in(tokens, wanted, low, high)

    monkeypatch.setattr(T, "term_sketch", crowded)
    monkeypatch.setattr(T, "count_terms_in", spy)
    kept = ["ab cd " * 20] * 3
    middle = [f"middle{i} " * 10 for i in range(10) for _ in range(2)]
    rare = [f"rare{i} " * 2 for i in range(100) for _ in range(2)]
    rows = spark.createDataFrame(list(enumerate(kept + middle + rare)), "doc_id long, text string")
    assert T.TfidfModel.fit(rows, "text", "doc_id", 1, 1, 2, 2).terms == ("ab", "cd")
    assert seen == [10, 12]


def test_rare_terms_are_not_shuffled(spark, monkeypatch):
    """Only what may be kept is counted by term, and so shuffled."""
    seen = []

    def spy(*args):
        seen.append(S.count_terms_in(*args).count())
        return S.count_terms_in(*args)

    monkeypatch.setattr(T, "count_terms_in", spy)
    rows = spark.createDataFrame(
        [(i, f"ab cd ef gh unique{i} other{i}") for i in range(300)], "doc_id long, text string"
    )
    assert T.TfidfModel.fit(rows, "text", "doc_id", 1, 1, 2, 4).terms == ("ab", "cd", "ef", "gh")
    assert max(seen) < 20


@pytest.mark.parametrize(("low", "high"), [(1, 3), (2, 3), (1, 1)])
def test_large_and_small_vocabularies_weigh_alike(spark, monkeypatch, low, high):
    rows = _rows(spark)
    model = T.TfidfModel.fit(rows, "text", "doc_id", low, high, 2, 40)
    small = {r[0]: r[1] for r in model.weigh(rows, "text").select("doc_id", "_weights").collect()}
    monkeypatch.setattr(T, "ROW_LOCAL_TERMS", 0)
    large = {r[0]: r[1] for r in model.weigh(rows, "text").select("doc_id", "_weights").collect()}
    assert large == small and any(small.values())


@pytest.mark.parametrize("limit", [6, 100_000])
def test_vocabularies_are_weighed_side_by_side(spark, monkeypatch, limit):
    """One Python pass, some rows at a time, gives the vectors that each vocabulary gives on its own."""
    monkeypatch.setattr(T, "WEIGHED_TOKENS", 7)
    split = _rows(spark).withColumn("fold", (F.col("doc_id") % 4).cast("int")).select("doc_id", "fold", X.vector_tokens("text").alias("tokens"))
    split = split.unionByName(spark.createDataFrame([(-1, 0, None), (-2, 1, [])], "doc_id long, fold int, tokens array<string>"))
    models = [*T.outside_vocabularies(split.select("fold", "tokens").filter("tokens IS NOT NULL"), 4, 1, 2, 2, limit), T.TfidfModel((), (), 1, 2)]
    together, width, views = T.weigh_side_by_side(split, "tokens", models)
    assert together._jdf.queryExecution().executedPlan().toString().count("InArrow") == 1
    found = {r["doc_id"]: r for r in together.collect()}
    assert len(found) == split.count() and all(len(r["terms"]["indices"]) <= width for r in found.values())
    for k, (model, (places, idf)) in enumerate(zip(models, views)):
        column = {int(place): i for i, place in enumerate(places)}
        for row in model.weigh_tokens(split, "tokens", "w").select("doc_id", "w").collect():
            _, _, indices, values = found[row["doc_id"]]["terms"]
            share = found[row["doc_id"]]["shares"][k]
            got = {column[i]: v * idf[column[i]] * share for i, v in zip(indices, values) if i in column}
            assert got == pytest.approx({w["index"]: w["weight"] for w in row["w"]}, rel=1e-12)


def test_lookup_has_empty_buckets(spark):
    words = {f"w{i}": i for i in range(50)}
    frame = spark.createDataFrame([(w,) for w in [*words, "absent", "", None]], "w string")
    found = [r[0] for r in frame.select(literal_lookup(words, "int")(F.col("w"))).collect()]
    assert found == [*words.values(), None, None, None]


def test_whitespace_and_sentences(spark):
    texts = [
        "", " \n ", " ", "\x1c\x85", "a", "  a b  ", "Dr. No. Yes!  Why? So\x1c", "x.\n\ny. \U0001d49c z.", ".  . a",
        "xDr. And (Dr. Who) went.", None,
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    known = "|".join(a.replace(".", r"\.") for a in X.ABBREVIATIONS)
    trim = F.regexp_replace(F.coalesce("text", F.lit("")), f"^[{X.WS}]+|(?<![{X.WS}])[{X.WS}]+$", "")
    plain = rf"(?<=[.!?])[{X.WS}]+"
    abbrev = rf"(?<=[.!?])(?<!(?<![{X.WORD}])(?:{known})\.)[{X.WS}]+"
    for row in frame.select(
        "i", X.strip("text").alias("a"), trim.alias("b"), X.is_blank("text").alias("c"), (trim == "").alias("d"),
        X.split_sentences("text").alias("e"), X.non_empty(F.split(trim, plain)).alias("f"),
        X.split_sentences_abbrev("text").alias("g"), X.non_empty(F.split(trim, abbrev)).alias("h"),
    ).collect():
        assert (row["a"], row["c"], row["e"], row["g"]) == (row["b"], row["d"], row["f"], row["h"])


@pytest.mark.parametrize("limit", [6, 100_000])
def test_vocabularies_of_folds_are_those_of_the_other_rows(spark, limit):
    rows = _rows(spark).withColumn("fold", (F.col("doc_id") % 4).cast("int"))
    split = rows.select("fold", X.vector_tokens("text").alias("tokens"))
    for k, found in enumerate(T.outside_vocabularies(split, 4, 1, 2, 2, limit)):
        assert found == T.TfidfModel.fit(rows.filter(F.col("fold") != k), "text", "doc_id", 1, 2, 2, limit)


def test_linear_score_does_not_shuffle_weighted_terms(spark, monkeypatch):
    """A small weight table is broadcast; a larger one is joined and gives the same scores."""
    weighted = spark.createDataFrame([(i, f"t{j}", 0.5 / (j + 1)) for i in range(6) for j in range(4)], "doc_id long, term string, weight double")
    weights = spark.createDataFrame([("t1", 2.0), ("t3", -1.0)], "term string, coefficient double")
    small = T.linear_score(weighted, weights, -0.5)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(term" not in plan
    monkeypatch.setattr(T, "MAX_BROADCAST_WEIGHTS", 1)
    large = T.linear_score(weighted, weights, -0.5)
    assert {r[0]: r[1] for r in small.collect()} == pytest.approx({r[0]: r[1] for r in large.collect()})


def test_large_batches_are_worked_on_in_slices(spark, monkeypatch):
    """Runs of rows hold at most so many tokens, and together are the batch; counts do not depend on them."""
    column = pa.array([["a"] * 3, [], ["b"] * 9, ["c"], ["d"] * 2, []], pa.list_(pa.string())).slice(1)
    monkeypatch.setattr(S, "SLICE_TOKENS", 4)
    parts = list(S._slices(column))
    assert [len(p.flatten()) for p in parts] == [0, 9, 3]
    assert sum((p.to_pylist() for p in parts), []) == column.to_pylist()
    assert [p.to_pylist() for p in S._slices(column.slice(0, 0))] == [[]]
