"""Exact quantiles of any number of values by repeated narrowing.

Each round counts the values of the ranges that still hold a wanted rank in a fixed number of buckets, with
the least and the largest value of each; the bucket of a rank is its next range. A range of one value
answers its ranks, and a range with no more values than buckets is counted value by value. A round is one pass with partial aggregation, and its state is bounded by groups, ranks and
buckets, however many values there are or how many of them differ.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1024


def exact_quantiles(
    values: DataFrame, group: Sequence[str], value: str, probabilities: Sequence[float], buckets: int = BUCKETS
) -> DataFrame:
    """(group columns, q0, q1, ...): one row per group, a column per probability, linearly interpolated.

    ``values`` is read once a round and should be a stored table; its groups are few (classes, features).
    Nulls and NaN are left out; a group without any other value has null quantiles. Infinities count as
    the largest finite numbers.
    """
    spark = values.sparkSession
    largest = 1.7976931348623157e308
    number = F.greatest(F.lit(-largest), F.least(F.lit(largest), F.col(value).cast("double")))
    kept = F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")), number)
    rows = values.select(F.struct(*group).alias("_group"), kept.alias("_value"))
    first = rows.groupBy("_group").agg(F.count("_value").alias("n"), F.min("_value").alias("low"), F.max("_value").alias("high")).collect()
    groups = [r["_group"] for r in first]
    known: list[dict[int, float]] = [{} for _ in first]
    # Per open range: group, its ends, the rank of its least value, the wanted ranks inside, its number of values.
    open_: list[tuple[int, float, float, int, set[int], int]] = []
    for g, r in enumerate(first):
        wanted = {k for p in probabilities for k in (math.floor(p * (r["n"] - 1)), math.ceil(p * (r["n"] - 1)))}
        if r["n"]:
            open_.append((g, r["low"], r["high"], 0, wanted, r["n"]))
    schema = T.StructType(
        [values.schema[c] for c in group]
        + [T.StructField("_range", T.IntegerType()), T.StructField("_few", T.BooleanType())]
        + [T.StructField("_low", T.DoubleType()), T.StructField("_high", T.DoubleType())]
    )
    while open_:
        settled = [o for o in open_ if o[1] == o[2]]
        for g, low, _, _, ranks, _ in settled:
            known[g].update(dict.fromkeys(ranks, low))
        open_ = [o for o in open_ if o[1] < o[2]]
        if not open_:
            break
        listed = [(*groups[g], i, n <= buckets, low, high) for i, (g, low, high, _, _, n) in enumerate(open_)]
        table = spark.createDataFrame(listed, schema)
        ranges = F.broadcast(table.select(F.struct(*group).alias("_group"), "_range", "_few", "_low", "_high"))
        inside = rows.join(ranges, rows["_group"].eqNullSafe(ranges["_group"])).filter("_value BETWEEN _low AND _high")
        # Halves, so that the width of a range never overflows; of the smallest numbers they are equal.
        share = F.try_divide(F.col("_value") / 2 - F.col("_low") / 2, F.col("_high") / 2 - F.col("_low") / 2)
        place = F.coalesce(F.least(F.floor(share * buckets), F.lit(buckets - 1)), F.lit(buckets - 1))
        bucket = F.when(F.col("_value") == F.col("_low"), 0).otherwise(place).alias("_bucket")
        single = F.when(F.col("_few"), F.col("_value")).alias("_single")
        counted = inside.groupBy("_range", bucket, single).agg(F.count("*").alias("n"), F.min("_value").alias("low"), F.max("_value").alias("high"))
        found: dict[int, list] = {}
        for r in counted.collect():
            found.setdefault(r["_range"], []).append(r)
        narrowed = []
        for i, (g, _, _, rank, ranks, _) in enumerate(open_):
            for r in sorted(found[i], key=lambda r: r["low"]):
                here = {k for k in ranks if rank <= k < rank + r["n"]}
                if here:
                    narrowed.append((g, r["low"], r["high"], rank, here, r["n"]))
                rank += r["n"]
        open_ = narrowed
    out = []
    for g, r in enumerate(first):
        quantiles = []
        for p in probabilities:
            if not r["n"]:
                quantiles.append(None)
                continue
            place = p * (r["n"] - 1)
            below, above = known[g][math.floor(place)], known[g][math.ceil(place)]
            quantiles.append(below if below == above else below + (above - below) * (place - math.floor(place)))
        out.append((*groups[g], *quantiles))
    columns = [T.StructField(f"q{i}", T.DoubleType()) for i in range(len(probabilities))]
    return spark.createDataFrame(out, T.StructType([*[values.schema[c] for c in group], *columns]))
