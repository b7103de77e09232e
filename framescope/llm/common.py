"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are held apart as hot are at most this many, whatever the input: see ``attach``.
HOT_KEYS = 1024
#: Largest table, in rows, that is broadcast after its rows have been counted.
SMALL_ROWS = 10_000

#: Number of values a sampling draw can take.
DRAWS = 1 << 60
#: Stands for a missing identifier while rows are compared, above or below all others.
NONE_HIGH, NONE_LOW = (1 << 63) - 1, -(1 << 63)


def draw_limit(rate: float) -> int:
    """Draws below this are taken at a rate; fine enough that no rate of any table is rounded to none."""
    return max(1, int(rate * DRAWS))


def draw(*parts: Column | str) -> Column:
    """A number below ``DRAWS`` that depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(DRAWS))


def known_id(none: int) -> Column:
    """The identifier, a missing one as the given number."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(none))


def or_null(identifier: str, none: int) -> Column:
    """The identifier back, missing ones as null."""
    return F.when(F.col(identifier) != none, F.col(identifier))


def whole_text(name: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_bucket(identifier: str, buckets: int) -> Column:
    """crc32 of the identifier's digits modulo a count; a null identifier gives -1."""
    return F.coalesce(F.crc32(F.col(identifier).cast("string")) % buckets, F.lit(-1))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone: 52 bits of their SHA-256."""
    digits = F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def slices(batches: Iterator[pa.RecordBatch], text: str, budget: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``budget`` bytes of text, one row at least."""
    for batch in batches:
        sizes = np.cumsum(batch.column(text).to_pandas().str.len().fillna(0).to_numpy())
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + budget, "right")))
            yield batch.slice(start, end - start)
            start = end


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after another, and where each text starts (with the end at last)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return codes, starts


def small_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join to a table that is expected to be small; it is broadcast only once counted.

    Up to ``SMALL_ROWS`` rows go to every task. A larger table is joined by a shuffle instead, where
    adaptive execution splits hot keys.
    """
    rows = right.limit(SMALL_ROWS + 1).collect()
    if len(rows) > SMALL_ROWS:
        return left.join(right, key, "left")
    local = right.sparkSession.createDataFrame(rows, right.schema)
    return left.join(F.broadcast(local), key, "left")


def attach(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join of many rows to one row per key, safe for keys that hold a large part of the rows.

    ``weight`` is the number of left rows of a key, ``total`` at least the sum of the weights. Keys
    with over ``total / HOT_KEYS`` rows are fewer than ``HOT_KEYS``: they are broadcast. The rest
    is joined by a shuffle, in which rows with a hot key or none carry a spread substitute key.
    """
    values = [c for c in right.columns if c != key]
    is_hot = F.col(weight) > total / HOT_KEYS
    hot = right.filter(is_hot).select(key, F.struct(*values).alias("_hot"))
    cold = right.filter(~is_hot).select(F.col(key).cast("string").alias("_cold_key"), F.struct(*values).alias("_cold"))
    spread = F.concat(F.lit("~"), F.xxhash64(*left.columns).cast("string"))
    joined = left.join(F.broadcast(hot), key, "left").withColumn(
        "_cold_key", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.col(key).cast("string")).otherwise(spread)
    )
    joined = joined.join(cold, "_cold_key", "left")
    picked = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.select(*left.columns, *[picked[v].alias(v) for v in values])


def whole_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole tasks of a range sorted by task; a task has two tiles at most."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        task = batch.column("task").to_numpy()
        last = int(np.searchsorted(task == task[-1], True)) if (task[0] != task[-1]) else 0
        if held and held[-1].column("task")[-1].as_py() != task[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)
