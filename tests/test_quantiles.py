"""Exact quantiles against numpy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framescope.operators.explore import feature_quantiles, text_length_stats
from framescope.operators.quantiles import exact_quantiles

SHARES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)


def groups_of(seed=2):
    rng = random.Random(seed)
    return {
        "uniform": [rng.random() for _ in range(3000)],
        "one value": [0.25] * 1500,
        "a third equal": [0.5 if rng.random() < 0.4 else rng.random() for _ in range(2000)],
        "scales": [10.0 ** rng.randint(-300, 300) * rng.choice([-1, 1]) for _ in range(800)],
        "neighbours": [float(np.nextafter(1.0, 2.0)) if rng.random() < 0.5 else 1.0 for _ in range(101)],
        "extremes": [1.7e308, -1.7e308, 0.0, 5e-324, -5e-324],
        "single": [3.5],
        "two": [1.0, 2.0],
    }


@pytest.mark.parametrize("buckets", [1024, 40])
def test_quantiles_equal_numpy(spark, buckets):
    groups = groups_of()
    rows = [(g, v) for g, values in groups.items() for v in values]
    rows += [("uniform", None), ("uniform", float("nan")), ("empty", None), (None, 7.0)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "kind string, v double").repartition(7)
    got = {r["kind"]: r for r in exact_quantiles(frame, ["kind"], "v", SHARES, buckets).collect()}
    assert set(got) == {*groups, "empty", None}
    assert [got["empty"][f"q{i}"] for i in range(len(SHARES))] == [None] * len(SHARES)
    assert got[None]["q3"] == 7.0
    for kind, values in groups.items():
        ordered = sorted(values)
        for i, p in enumerate(SHARES):
            place = p * (len(ordered) - 1)
            low, high = ordered[math.floor(place)], ordered[math.ceil(place)]
            want = low if low == high else low + (high - low) * (place - math.floor(place))
            assert got[kind][f"q{i}"] == want or (math.isinf(want) and math.isinf(got[kind][f"q{i}"])), (kind, p)


def test_feature_quartiles_are_not_rounded(spark):
    frame = spark.createDataFrame([(i % 2, i / 7e7, 1.0) for i in range(501)], "label int, a double, b double")
    got = {(r["label"], r["feature"]): r for r in feature_quantiles(frame, ["a", "b"]).collect()}
    for label in (0, 1):
        values = [i / 7e7 for i in range(501) if i % 2 == label]
        for name, p in (("q1", 25), ("median", 50), ("q3", 75)):
            assert got[label, "a"][name] == pytest.approx(np.percentile(values, p), rel=1e-12)
            assert got[label, "b"][name] == 1.0


def test_length_quartiles_by_sketch_and_exactly(spark):
    frame = spark.range(1000).select(
        F.when(F.col("id") < 999, F.col("id") % 2).alias("label"), *[F.col("id").alias(c) for c in ("chars", "words", "sentences")],
        F.lit(4.0).alias("avg_word_length"),
    )
    exact = {r["label"]: r for r in text_length_stats(frame).collect()}
    sketch = {r["label"]: r for r in text_length_stats(frame, exact=False).collect()}
    assert set(exact) == {0, 1, None} == set(sketch) and exact[None]["words_median"] == 999.0
    for label in (0, 1):
        assert exact[label]["words_median"] == np.median([i for i in range(999) if i % 2 == label])
        assert abs(sketch[label]["words_median"] - exact[label]["words_median"]) <= 2
