"""Boosted trees, side-by-side regressions, folds and the entity trie against plain computations."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark import RDD
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from framescope.operators import boosting, entities, metrics, models, stacked
from framescope.operators.corpus import stratified_folds, stratified_split
from framescope.operators.tfidf import TfidfModel, counted_terms, fold_vocabularies
from framescope.session import materialize, scratch_path, spread


def noisy_rows(n=600, seed=3):
    """The label depends on an interaction of two words and on one weak word, with noise."""
    rng = random.Random(seed)
    words = [f"w{chr(97 + i)}" for i in range(26)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(25)]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text += ["left"] * a + ["right"] * b
        label = int((a != b) if rng.random() < 0.95 else rng.random() < 0.5)
        rng.shuffle(text)
        rows.append((i, " ".join(text), label))
    return rows


@pytest.fixture(scope="module")
def sides(spark):
    rows = spark.createDataFrame(noisy_rows(), "doc_id bigint, text string, label int")
    split = materialize(stratified_split(rows), "noisy")
    return split.filter("split = 'train'").drop("split"), split.filter("split = 'test'").drop("split")


def test_boosted_trees_learn_an_interaction_and_reload(spark, sides):
    train, test = sides
    model = models.train_boosted(train, rounds=40, depth=3)
    assert len(model.trees) == 40
    scored = materialize(models.predict_bias(test, {"b": model}), "boosted")
    assert metrics.summary_metrics(scored)["roc_auc"] > 0.85
    # A linear model cannot see it.
    linear = models.predict_bias(test, {"a": models.train_logistic(train, high=1).linear()})
    assert metrics.summary_metrics(linear)["roc_auc"] < 0.75
    path = scratch_path(spark, "boosted")
    model.save(spark, path)
    loaded = boosting.BoostedTextModel.load(spark, path)
    again = models.predict_bias(test, {"b": loaded}).select("doc_id", "probability").collect()
    assert sorted(again) == sorted(scored.select("doc_id", "probability").collect())


def test_boosted_margins_equal_the_trees_on_values(spark, sides, monkeypatch):
    """Training on bins in many blocks and scoring on weights walk the same paths."""
    train, _ = sides
    tfidf = TfidfModel.fit(train, "text", "doc_id", 1, 2, 2, 500)
    whole = boosting.fit_boosted(train, tfidf, rounds=12, depth=4, renew=5, bins=8)
    monkeypatch.setattr(boosting, "BLOCK_ENTRIES", 900)
    monkeypatch.setattr(boosting, "DENSE_CELLS", 10)
    monkeypatch.setattr(boosting, "SMALL_ROWS", 60)  # large nodes level by level, small ones by one task
    parts = boosting.fit_boosted(train, tfidf, rounds=12, depth=4, renew=3, bins=8)
    monkeypatch.setattr(boosting, "SMALL_ROWS", 0)
    levels = boosting.fit_boosted(train, tfidf, rounds=4, depth=4, renew=3, bins=8)
    assert [len(t[0]) for t in levels.trees] == [len(t[0]) for t in whole.trees[:4]]
    a = {r["doc_id"]: r["probability"] for r in whole.score(train).collect()}
    b = {r["doc_id"]: r["probability"] for r in parts.score(train).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9
    # By hand: margins from the trees on each row's weights.
    rows = tfidf.weigh(train, "text").select("doc_id", "_weights").collect()
    for r in rows[:40]:
        value = {w["index"]: w["weight"] for w in r["_weights"]}
        margin = whole.base
        for column, threshold, left, leaf in whole.trees:
            node = 0
            while column[node] >= 0:
                node = left[node] + (value.get(column[node], 0.0) > threshold[node])
            margin += leaf[node]
        assert a[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-12)


def test_first_split_is_the_best_one_by_hand(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(3)), 0) for i in range(200)]
    rows = [(i, t, int("bb" in t if rng.random() < 0.9 else rng.random() < 0.5)) for i, t, _ in rows]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    tfidf = TfidfModel.fit(train, "text", "doc_id", 1, 1, 1, 10)
    model = boosting.fit_boosted(train, tfidf, rounds=1, depth=1, row_share=1.0, column_share=1.0)
    column, threshold, _, leaf = model.trees[0]
    weights = {r["doc_id"]: {w["index"]: w["weight"] for w in r["_weights"]} for r in tfidf.weigh(train, "text").collect()}
    label = np.array([r[2] for r in rows], float)
    share = label.mean()
    g, h = share - label, np.full(len(label), share * (1 - share))
    best = None
    for c in range(tfidf.size):
        values = np.array([weights[i].get(c, 0.0) for i in range(len(rows))])
        for t in np.unique(values)[:-1]:
            right = values > t
            if min(h[right].sum(), h[~right].sum()) < 1:
                continue
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (right, ~right))
            best = max(best or (gain, c, t, right), (gain, c, t, right), key=lambda x: x[0])
    assert column[0] == best[1] and threshold[0] == pytest.approx(best[2])
    assert leaf[1] == pytest.approx(-0.1 * g[~best[3]].sum() / (h[~best[3]].sum() + 1))


def test_small_tables_are_boosted_by_one_task(spark, sides, monkeypatch):
    """Many trees a job, the same ones as level by level over all tasks."""
    train, _ = sides
    tfidf = TfidfModel.fit(train, "text", "doc_id", 1, 2, 2, 500)
    jobs = []
    collect = RDD.collect

    def spy(rdd):
        jobs.append(1)
        return collect(rdd)

    monkeypatch.setattr(RDD, "collect", spy)
    monkeypatch.setattr(boosting, "TREES_A_JOB", 7)
    whole = boosting.fit_boosted(train, tfidf, rounds=12, depth=4, bins=8)
    assert len(jobs) == 2
    monkeypatch.setattr(boosting, "WHOLE_BLOCKS", 0)
    monkeypatch.setattr(boosting, "BLOCK_ENTRIES", 900)
    monkeypatch.setattr(boosting, "SMALL_ROWS", 0)
    levels = boosting.fit_boosted(train, tfidf, rounds=12, depth=4, bins=8)
    assert len(jobs) > 14
    for one, other in zip(whole.trees, levels.trees, strict=True):
        assert all(np.array_equal(a, b) for a, b in zip(one[:3], other[:3], strict=True))
        assert one[3] == pytest.approx(other[3], rel=1e-9, abs=1e-12)


def test_boosted_on_unusual_tables(spark):
    tfidf = TfidfModel(("aa", "bb"), (1.0, 1.0), 1, 1)
    empty = spark.createDataFrame([], "doc_id bigint, text string, label int")
    one = spark.createDataFrame([(1, "aa", 1), (2, None, 1), (3, "", None)], "doc_id bigint, text string, label int")
    assert boosting.fit_boosted(empty, tfidf, rounds=3).trees == ()
    model = boosting.fit_boosted(one, tfidf, rounds=3)
    scores = [r["probability"] for r in model.score(one).collect()]
    assert len(scores) == 3 and all(0 <= s <= 1 for s in scores)


@pytest.fixture(scope="module")
def frames(sides):
    train, test = sides
    tfidf = TfidfModel.fit(train, "text", "doc_id", 1, 2, 2, 300)
    return models.training_frame(train, tfidf), models.training_frame(test, tfidf), tfidf.size


def test_forest_partitions_are_bounded(spark, monkeypatch):
    """A forest keeps four bytes a column and row, and a task reads a partition of that whole."""
    monkeypatch.setattr(models, "FOREST_PARTITION", 4 * 1000 * 10)
    rows = [(float(i % 2), Vectors.sparse(1000, [i % 1000], [1.0])) for i in range(95)]
    train = spark.createDataFrame(rows, ["label", "features"]).coalesce(1)
    dealt = models.forest_rows(train, 95)
    sizes = [n for n in dealt.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
    assert len(sizes) == 10 and max(sizes) <= 12 and sum(sizes) == 95
    assert models.forest_rows(train, 9).rdd.getNumPartitions() == 1


def test_few_uneven_scan_tasks_become_even(spark, tmp_path):
    """A file of one row group is read by one task, however many splits it has."""
    spark.range(4000).selectExpr("id AS doc_id", "repeat(md5(CAST(id AS STRING)), 200) AS text").coalesce(1).write.option("compression", "none").parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    conf = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    try:
        table = spark.read.parquet(str(tmp_path / "t"))
        assert spark.sparkContext.defaultParallelism <= table.rdd.getNumPartitions() < 24
        sizes = spread(table, "doc_id").rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", conf)
    assert sum(sizes) == 4000 and max(sizes) < 1000


def test_driver_gets_one_sum_whatever_the_tasks(spark):
    """Partial sums of all tasks are added by tasks; only the slices of their sum reach the driver."""
    parts = spark.sparkContext.parallelize(range(200), 50).map(lambda i: np.arange(1003.0) + i)
    empty = parts.filter(lambda a: a[0] >= 150)
    collected = []
    collect = RDD.collect

    def spy(rdd):
        collected.append(collect(rdd))
        return collected[-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(RDD, "collect", spy)
        total, rest = stacked.sum_of_arrays(parts), stacked.sum_of_arrays(empty)
    assert np.array_equal(total, 200 * np.arange(1003.0) + 19_900)
    assert np.array_equal(rest, 50 * np.arange(1003.0) + sum(range(150, 200)))
    assert [sum(len(part) for _, part in c) for c in collected] == [1003, 1003]


def test_stacked_regressions_equal_single_ones(frames):
    train, _, size = frames
    rows = train.count()
    strengths = (0.01, 0.3, 5.0)
    penalties = [models.regularisation(c, rows) for c in strengths]
    weighted = train.withColumn("weights", F.array(*[F.col("weight")] * 3))
    fits = stacked.fit_stacked(weighted, ["features"] * 3, [size] * 3, penalties, tolerance=1e-9, max_iter=500)
    for c, fit in zip(strengths, fits, strict=True):
        single = models.logistic(c, rows, 500).setTol(1e-9).fit(train)
        assert np.abs(fit.coefficients - single.coefficients.toArray()).max() < 2e-3
        assert fit.intercept == pytest.approx(single.intercept, abs=2e-3)


def test_left_out_rows_and_other_features_do_not_count(spark):
    rows = [(i % 2, Vectors.sparse(2, [0], [float(i % 2)]), Vectors.sparse(3, [2], [1.0 - i % 2])) for i in range(40)]
    frame = spark.createDataFrame([(*r, [1.0, 1.0, float(r[0] == 0)]) for r in rows], ["label", "a", "b", "weights"])
    fits = stacked.fit_stacked(frame, ["a", "b", "a"], [2, 3, 2], [0.01] * 3)
    assert fits[0].coefficients[0] > 1 and fits[1].coefficients[2] < -1
    assert abs(fits[2].coefficients[0]) < 1e-6 and fits[2].intercept < -3
    got = stacked.predict_stacked(frame, ["a", "b", "a"], fits).collect()
    assert len(got) == 120 and {r["problem"] for r in got} == {0, 1, 2}


def test_problems_that_share_a_matrix_equal_those_with_their_own(spark):
    """Each problem sees its columns of the one stored vector, scaled by column and row."""
    rng = np.random.default_rng(3)
    shared, views = rng.random((60, 5)), [stacked.View(np.array([0, 3]), np.array([2.0, 0.5])), stacked.View(np.array([4, 1, 2]), np.ones(3))]
    shares = rng.random((60, 2))
    rows = []
    for i, (row, share) in enumerate(zip(shared, shares, strict=True)):
        own = [Vectors.sparse(len(v.place), range(len(v.place)), row[v.place] * v.scale * s) for v, s in zip(views, share, strict=True)]
        rows.append((int(row[0] + row[1] > 1), Vectors.sparse(5, range(5), row), share.tolist(), [1.0, 2.0], [i % 2 == 0, True], *own))
    frame = spark.createDataFrame(rows, ["label", "t", "shares", "weights", "held", "a", "b"])
    own = stacked.fit_stacked(frame, ["a", "b"], [2, 3], [0.01] * 2)
    given = {"views": views, "width": 5, "shares": "shares"}
    fits = stacked.fit_stacked(frame, ["t", "t"], [2, 3], [0.01] * 2, **given)
    for one, other in zip(own, fits, strict=True):
        assert one.coefficients == pytest.approx(other.coefficients) and one.intercept == pytest.approx(other.intercept)
    want = sorted(map(tuple, stacked.predict_stacked(frame, ["a", "b"], own, held="held").collect()))
    got = sorted(map(tuple, stacked.predict_stacked(frame, ["t", "t"], fits, held="held", **given).collect()))
    assert len(got) == 90 and [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want])


def test_sweeps_report_every_model(frames):
    train, test, _ = frames
    sweep = models.regularization_sweep(train, test, (0.01, 1.0)).collect()
    assert [r["c"] for r in sweep] == [0.01, 1.0]
    curve = models.learning_curve(train, test, (0.5, 1.0)).collect()
    whole = models.evaluate(models.logistic(1.5, train.count()).fit(train), test)
    assert curve[1]["roc_auc"] == pytest.approx(whole["roc_auc"], abs=0.02)
    assert all(0 <= r["accuracy"] <= 1 and r["accuracy"] == pytest.approx(r["recall"]) for r in [*sweep, *curve])


def test_fold_vocabularies_are_those_of_the_other_rows(sides):
    train, _ = sides
    folded = materialize(stratified_folds(train, "label", "doc_id", 3), "test-folds")
    counted = materialize(folded.select("fold", counted_terms("text", 1, 2).alias("terms")), "test-counted")
    for limit in (40, 10_000):
        by_subtraction = fold_vocabularies(counted, 3, 1, 2, 2, limit)
        for k in range(3):
            direct = TfidfModel.fit(folded.filter(F.col("fold") != k), "text", "doc_id", 1, 2, 2, limit)
            assert by_subtraction[k].terms == direct.terms
            assert by_subtraction[k].idf == pytest.approx(direct.idf)
    model = by_subtraction[0]
    one = model.weigh(folded, "text").select("doc_id", "_weights").collect()
    counted_rows = folded.withColumn("terms", counted_terms("text", 1, 2))
    two = counted_rows.select("doc_id", model.weigh_counted("terms").alias("_weights")).collect()
    assert sorted(one) == sorted(two)


def test_cross_validation_learns_and_counts(sides):
    train, test = sides
    rows = train.unionByName(test).withColumn("text", F.when(F.col("label") == 1, F.concat("text", F.lit(" biased"))).otherwise(F.col("text")))
    folds = models.cross_validate(rows, folds=4, high=1).collect()
    assert sum(r["rows"] for r in folds) == 600 and all(r["f1_macro"] > 0.95 and r["roc_auc"] > 0.98 for r in folds)
    summary = models.cross_validation_summary(models.cross_validate(rows, folds=4, high=1)).first()
    assert summary["f1_macro_mean"] > 0.95


NAMES = [
    ("New Delhi", "GPE"), ("New Delhi Times", "ORG"), ("New", "NORP"), ("Delhi", "GPE"), ("Delhi", "ORG"),
    ("lower case", "ORG"), (" Spaced", "ORG"), ("Two  Blanks", "ORG"), ("Élan Vital", "ORG"), ("New Delhi", "GPE"),
    ("A", "PERSON"), (None, "ORG"), ("Odd", "NOTYPE"),
]


def test_trie_and_join_find_the_same(spark, monkeypatch):
    texts = [
        "New Delhi Times of New Delhi. Delhi won! A corrupt New plan in lower case.", "", None,
        "Élan Vital and  Spaced Two  Blanks; Odd New", "New New Delhi Delhi New Delhi Times Times", "nothing",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    names = spark.createDataFrame(NAMES, "surface string, entity_type string")
    small = [tuple(r) for r in entities.entity_mentions(docs, names).collect()]
    summary = sorted(entities.gazetteer_summary(docs, names).collect())
    limited = [tuple(r) for r in entities.entity_mentions(docs, names, max_words=1).collect()]
    monkeypatch.setattr(entities, "MAX_LITERAL_ENTRIES", 3)
    large = [tuple(r) for r in entities.entity_mentions(docs, names).collect()]
    assert sorted(small) == sorted(large) and len(small) == len(set(small)) + sum(s[3] == "New Delhi" for s in set(small))
    assert sorted(entities.gazetteer_summary(docs, names).collect()) == summary
    assert sorted(limited) == sorted(tuple(r) for r in entities.entity_mentions(docs, names, max_words=1).collect())
    found = {(s[0], s[3], s[4]) for s in small}
    assert (0, "New Delhi Times", "ORG") in found and (3, "Élan Vital", "ORG") in found and (0, "Delhi", "ORG") in found
    assert not any(s[3] in ("lower case", "Odd") for s in small)
    assert len(summary) == len(texts)


def test_large_tables_give_the_scores_of_small_ones(spark, monkeypatch):
    """Word tables and vocabularies above the literal limit: same values, neighbours included."""
    from framescope import constants as C
    from framescope.functions import lookup
    from framescope.operators import sentiment

    texts = [
        "not very good", "VERY good but slightly shameful!!", "It isn't heroic. true heroic", "", None, "plain words only",
        "good bad GOOD no! never good", "absolutely corrupt, barely true?",
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    words = C.SENTIMENT_WORDS | {"good": (1.9, 0.6), "bad": (-2.5, 0.66), "no": (-1.2, 0.3)}
    padded = words | {f"zz{i}": (1.0, 1.0) for i in range(200_000)}
    small = sentiment.auxiliary_scores(frame, "text", words)
    large = sentiment.auxiliary_scores(frame, "text", padded)
    assert small.columns == large.columns
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    one = sentiment.subjectivity(sentiment.emotion_intensity(frame, words=padded), words=padded)
    columns = ["doc_id", "compound", "subjectivity", "polarity"]
    assert sorted(one.select(columns).collect()) == sorted(small.select(columns).collect())
    tfidf = TfidfModel.fit(frame, "text", "doc_id", 1, 2, 1, 100)
    wide = TfidfModel(
        tfidf.terms + tuple(f"zz{i}" for i in range(200_000)), tfidf.idf + (1.0,) * 200_000, 1, 2
    )
    assert wide.size > lookup.MAX_LITERAL_ENTRIES
    a, b = (m.weigh(frame, "text").select("doc_id", "_weights").collect() for m in (tfidf, wide))
    assert sorted(a) == sorted(b)
    monkeypatch.setattr(lookup, "MAX_SHARED_ENTRIES", 10)
    with pytest.raises(lookup.TooManyEntries):
        sentiment.auxiliary_scores(frame, "text", padded)


@pytest.mark.parametrize("dense", [True, False])
def test_splits_by_slabs_are_those_of_all_sums(monkeypatch, dense):
    """Sums of several tasks, cut by ranges of columns, give the splits of their total; ties go to the first column."""
    if not dense:
        monkeypatch.setattr(boosting, "DENSE_CELLS", 1)
    rng = np.random.default_rng(5)
    bins = boosting.Bins(np.arange(6), np.array([0, 3, 4, 9, 9, 14, 17]), np.full(17, np.inf))
    nodes, parts = 3, []
    for _ in range(4):
        cells = np.sort(rng.choice(nodes * 17, 30, replace=False))
        # Multiples of 1/8 add up exactly in any order.
        gradient, curvature, rows = (rng.integers(a, b, 30) / 8 for a, b in ((-40, 40), (1, 16), (8, 80)))
        parts.append((np.full((3, nodes), [[1.0], [30.0], [500.0]]), cells, gradient, curvature, rows))
    whole = boosting._added(parts, nodes * 17)
    expected = [b and b[1] for b in boosting._best_splits(whole, bins, 17, 1.0, 1.0)]
    assert sum(b is not None for b in expected) > 1
    for count in (1, 2, 4, 9):
        slabs = boosting.Slabs.of(bins, count)
        shares = [list(slabs.cut(p)) for p in parts]
        bests = []
        for s in range(len(slabs.border) - 1):
            met = boosting._added([share[s][1] for share in shares], slabs.size(s, nodes))
            assert (met[0] == whole[0]).all()
            bests.append(boosting._best_splits(slabs.joined(s, met), bins, 17, 1.0, 1.0))
        assert boosting._chosen(bests) == expected
