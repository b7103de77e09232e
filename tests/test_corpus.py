"""Corpus, ranking, TF-IDF, metric and model operators against brute force."""

from __future__ import annotations

import hashlib
import inspect
import math
import random
from collections import Counter, defaultdict
from unittest.mock import MagicMock

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from framescope.functions.lookup import MAX_LITERAL_ENTRIES, TooManyEntries, literal_lookup
from framescope.operators import corpus, explore, history, metrics, models, ranking
from framescope.operators.boosting import fit_boosted
from framescope.operators.tfidf import TfidfModel, tfidf
from framescope.plans.planted import labelled_documents, planted_documents
from framescope.session import materialize, scratch_path
from framescope.sources import corpora


def skewed_rows(n=3000, seed=1):
    """A third of all rows is one text, one label dominates, scores are tied heavily."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "The Same Hot Text here" if i % 3 == 0 else f"text number {rng.randrange(n)} of many"
        text = text.upper() if rng.random() < 0.3 else text
        score = 0.5 if i % 3 == 1 else round(rng.random(), 2)
        rows.append((i, text, int(rng.random() < 0.1 + 0.5 * score), score))
    return rows


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.createDataFrame(skewed_rows(), "row_id bigint, text string, label int, score double")


def test_dedup_keeps_first_row(skewed):
    frame = skewed.select("row_id", "text", "label").withColumn("source", F.lit("a"))
    low, high = frame.filter("row_id % 2 = 0"), frame.filter("row_id % 2 = 1")
    got = {(r["priority"], r["row_id"]) for r in corpus.build_corpus([high, low]).collect()}
    first = {}
    for row_id, text, _, _ in skewed_rows():
        place = (0 if row_id % 2 else 1, row_id)
        first[text.lower()] = min(first.get(text.lower(), place), place)
    assert got == set(first.values())


def test_hash_rank_equals_plain_order(skewed):
    got = {r["row_id"]: r["hash_rank"] for r in ranking.hash_rank(skewed, "label", "row_id").collect()}
    groups = defaultdict(list)
    for row_id, _, label, _ in skewed_rows():
        groups[label].append((hashlib.md5(f"42:{row_id}".encode()).hexdigest(), row_id))
    for members in groups.values():
        for rank, (_, row_id) in enumerate(sorted(members), 1):
            assert got[row_id] == rank


def test_split_and_folds_keep_ratio(skewed):
    split = corpus.stratified_split(skewed, key="row_id").groupBy("label", "split").count().collect()
    sizes = {(r["label"], r["split"]): r["count"] for r in split}
    for label in (0, 1):
        total = sizes[label, "train"] + sizes[label, "test"]
        assert sizes[label, "test"] == math.floor(total * 0.2 + 0.5)
    folds = corpus.stratified_folds(skewed, key="row_id").groupBy("label", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in folds if r["label"] == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_both_ways(spark, descending):
    rng = random.Random(5)
    # Two thirds of the values lie in one narrow range.
    values = {0.5 + rng.random() * 1e-6 for _ in range(800)} | {rng.random() for _ in range(400)}
    rows = [(v, rng.randrange(5)) for v in values]
    frame = materialize(spark.createDataFrame(rows, "score double, n bigint"), "sums")
    out = ranking.running_sums(frame, "score", ["n"], descending, 16).collect()
    before, expected = 0, {}
    for score, n in sorted(rows, reverse=descending):
        expected[score] = before
        before += n
    assert {r["score"]: r["n_before"] for r in out} == expected


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_place_null_and_nan(spark, descending):
    rows = [(None, 1), (0.5, 2), (0.25, 4), (float("nan"), 8)]
    frame = materialize(spark.createDataFrame(rows, "score double, n bigint"), "sums")
    out = {r["n"]: r["n_before"] for r in ranking.running_sums(frame, "score", ["n"], descending, 2).collect()}
    order = [8, 2, 4, 1] if descending else [1, 4, 2, 8]
    assert out == {n: sum(order[:i]) for i, n in enumerate(order)}


def test_running_sums_of_many_scores(spark):
    frame = materialize(spark.range(150_000).selectExpr("(id * 7919 % 150000) / 150000D AS score", "1L AS n"), "sums")
    wrong = ranking.running_sums(frame, "score", ["n"]).filter("n_before <> round(score * 150000)")
    assert wrong.count() == 0


def test_auc_leaves_out_missing_scores(spark):
    rows = [(1, 0.9), (0, 0.1), (1, None), (0, float("nan"))]
    row = metrics.roc_auc(spark.createDataFrame(rows, "label int, probability double")).first()
    assert (row["positives"], row["negatives"], row["roc_auc"]) == (1, 1, 1.0)


def test_history_means_skip_missing_scores(spark):
    rows = [("a", 0.8, 0.5), ("a", None, None), ("b", None, 0.1), ("c", 0.7, None), (None, 0.9, None)]
    log = spark.createDataFrame(rows, "source_label string, composite_score double, ml_probability double")
    log = log.selectExpr("*", "CAST(NULL AS DOUBLE) AS opinion_ratio", "CAST(NULL AS STRING) AS timestamp")
    ranking_rows = [(r["source_label"], r["mean_composite"]) for r in history.source_ranking(log).collect()]
    assert ranking_rows == [("a", 0.8), ("c", 0.7), ("b", None)]
    stats = history.summary_stats(log).first()
    assert (stats["total_analyses"], stats["most_biased_source"]) == (5, "a")
    assert (stats["avg_composite"], stats["avg_ml_prob"], stats["avg_opinion_ratio"]) == (0.8, 0.3, 0.0)


def test_auc_equals_pairs(skewed):
    scored = skewed.withColumnRenamed("score", "probability")
    rows = skewed_rows()
    positive, negative = (Counter(r[3] for r in rows if r[2] == c) for c in (1, 0))
    won = sum(
        (2 if p > q else 1 if p == q else 0) * a * b
        for p, a in positive.items() for q, b in negative.items()
    )
    row = metrics.roc_auc(scored).first()
    assert row["doubled_wins"] == won
    points = metrics.roc_pr_points(scored).orderBy(F.desc("threshold")).collect()
    assert points[-1]["tpr"] == points[-1]["fpr"] == 1.0
    assert all(a["tp"] <= b["tp"] for a, b in zip(points, points[1:], strict=False))


def test_reports_agree(skewed):
    scored = skewed.withColumnRenamed("score", "probability").withColumn(
        "prediction", F.when(F.col("probability") >= 0.5, 1).otherwise(0)
    )
    rows = {r["row"]: r for r in metrics.classification_report(scored).collect()}
    quick = metrics.summary_metrics(scored)
    assert math.isclose(quick["accuracy"], rows["accuracy"]["f1"])
    assert math.isclose(quick["f1"], rows["weighted"]["f1"])
    assert math.isclose(quick["f1_macro"], rows["macro"]["f1"])
    assert math.isclose(quick["precision"], rows["weighted"]["precision"])
    errors = metrics.error_analysis(scored).count()
    assert errors == round((1 - quick["accuracy"]) * scored.count())


def test_row_local_tfidf_equals_joined(spark):
    docs = planted_documents(spark, SMALL).select("doc_id", "text")
    model = TfidfModel.fit(docs, max_features=3000)
    assert model.size == 3000
    joined = {
        (r["doc_id"], r["term"]): r["weight"] for r in tfidf(docs, max_features=3000).collect()
    }
    rows = model.weigh(docs, "text", "w").select("doc_id", F.inline("w")).collect()
    assert len(rows) == len(joined)
    for r in rows:
        assert math.isclose(r["weight"], joined[r["doc_id"], model.terms[r["index"]]], rel_tol=1e-9)


def test_tfidf_by_hand(texts):
    docs = texts("red red blue", "red green", "blue sky blue")
    got = {(r["doc_id"], r["term"]): r["weight"] for r in tfidf(docs, high=1).collect()}
    idf = math.log(4 / 3) + 1
    red, blue = (1 + math.log(2)) * idf, idf
    assert set(got) == {(0, "red"), (0, "blue"), (1, "red"), (2, "blue")}
    assert math.isclose(got[0, "red"], red / math.hypot(red, blue))
    assert got[1, "red"] == got[2, "blue"] == 1.0


def test_literal_lookup(spark):
    lookup = literal_lookup({f"k{i}": i for i in range(500)}, "int")
    keys = spark.range(600).select(F.concat(F.lit("k"), F.col("id")).alias("k"), "id")
    rows = keys.select("id", lookup(F.col("k")).alias("v")).collect()
    assert all(r["v"] == (r["id"] if r["id"] < 500 else None) for r in rows)
    with pytest.raises(TooManyEntries):
        literal_lookup(dict.fromkeys(map(str, range(MAX_LITERAL_ENTRIES + 1)), 1), "int")


def test_csv_round_trip(spark, texts):
    values = ['say "x", then', "two\nlines", " padded ", "back\\slash", "", "comma,", 'ends "']
    frame = texts(*values).withColumn("label", F.lit("1")).withColumn("source", F.lit("s"))
    path = scratch_path(spark, "csv")
    corpora.write_corpus(frame, path)
    read = {r["doc_id"]: r["text"] for r in corpora.read_corpus_csv(spark, path).collect()}
    assert [read[i] or "" for i in range(len(values))] == values


def test_discover_columns(spark):
    frame = spark.createDataFrame([("a", "x", "Left")], "Title string, CONTENT string, Bias string")
    assert corpora.discover_columns(frame).first().asDict() == {"text": "x", "raw_label": "Left"}
    with pytest.raises(ValueError):
        corpora.discover_columns(frame.select("Title"))


def test_exclusive_vocabulary(spark):
    rows = [(1, "bad bad same")] * 5 + [(0, "good same")] * 5
    frame = spark.createDataFrame(rows, "label int, text string")
    got = {r["term"]: r["main_class"] for r in explore.exclusive_vocabulary(frame).collect()}
    assert got == {"bad": 1, "good": 0}


def planted_labels(spark, n=240):
    rows = []
    for i in range(n):
        rng = random.Random(i)
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "vote", "senate"]) for _ in range(20)]
        biased = i % 3 == 0
        words += ["vile", "corrupt"] if biased else ["report", "official"]
        rng.shuffle(words)
        rows.append((i, " ".join(words) + ".", int(biased)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, label int")


def test_models_learn_and_reload(spark):
    rows = planted_labels(spark)
    split = materialize(corpus.stratified_split(rows), "planted")
    train = split.filter("split = 'train'").drop("split")
    test = split.filter("split = 'test'").drop("split")
    plain = models.train_logistic(train, high=1)
    enhanced = models.train_enhanced(train, max_iter=30)
    boosted = models.train_boosted(train, rounds=3, depth=2)
    for name, model in (("plain", plain), ("enhanced", enhanced), ("boosted", boosted)):
        scored = models.predict_bias(test, {name: model})
        assert metrics.summary_metrics(scored)["roc_auc"] > 0.95, name
    # The column expression and the ML classifier are the same model.
    both = models.predict_bias(test, {"a": plain}).select("doc_id", F.col("probability").alias("p"))
    linear = models.predict_bias(test, {"b": plain.linear()})
    for r in both.join(linear, "doc_id").collect():
        assert abs(r["p"] - r["probability"]) <= 1e-4
    path = scratch_path(spark, "model")
    enhanced.save(spark, path)
    loaded = models.TextClassifier.load(spark, path)
    a = models.predict_bias(test, {"m": enhanced}).select("doc_id", "probability").collect()
    b = models.predict_bias(test, {"m": loaded}).select("doc_id", "probability").collect()
    assert sorted(a) == sorted(b)
    with pytest.raises(TypeError):
        enhanced.linear()
    blank = test.limit(1).withColumn("text", F.lit("  "))
    assert models.predict_bias(blank, {"m": plain}).first()["probability"] == 0.0


def test_labelled_documents_have_both_classes(spark):
    labels = {r["label"] for r in labelled_documents(spark, SMALL).select("label").collect()}
    assert labels == {0, 1}


def test_model_queries_train_at_full_strength(monkeypatch):
    """The registered queries leave terms, word lengths, rounds and iterations at the operators' values."""
    from framescope.plans import training_queries as T

    calls = {}
    session = MagicMock()
    session.sparkContext.applicationId = "none"
    monkeypatch.setattr(T, "_split", lambda *_: MagicMock())
    monkeypatch.setattr(T, "_sides", lambda *_: (None, None))
    monkeypatch.setattr(T, "_scored", lambda *_: None)
    monkeypatch.setattr(T, "_FRAMES", {})
    monkeypatch.setattr(T, "F", MagicMock())

    def record(name):
        def called(*_, **given):
            calls[name] = given
            return MagicMock()

        return called

    for name in ("train_logistic", "train_enhanced", "train_boosted", "cross_validate", "split_frames"):
        monkeypatch.setattr(T.ML, name, record(name))
    T.train_boosted(session, "x")
    T.predict_bias(session, "x")
    T.cross_validate(session, "x")
    T._frames(session, "x")
    assert set(calls) == {"train_logistic", "train_enhanced", "train_boosted", "cross_validate", "split_frames"}
    assert not any(calls.values())
    assert inspect.signature(fit_boosted).parameters["rounds"].default == 300
    assert inspect.signature(models.model_comparison).parameters["trees"].default == 100
