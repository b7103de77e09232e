"""Dictionaries applied to words, by their size.

A Spark map is searched linearly, so a dictionary of up to ``MAX_LITERAL_ENTRIES`` is stored as an array of
small maps indexed by ``crc32(key) % buckets``. The literal is folded once and travels with the task
binary: no join, no shuffle. A larger one is broadcast once per executor, after its size was
checked, as Arrow arrays; word arrays are matched with it batch by batch and keep their order, so rules that
look at neighbouring words work the same.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LITERAL_ENTRIES = 50_000
#: Largest dictionary that is broadcast: some 150 MB of words and values.
MAX_SHARED_ENTRIES = 5_000_000
_KINDS = {"int": (pa.int32(), T.IntegerType()), "double": (pa.float64(), T.DoubleType())}


class TooManyEntries(ValueError):
    """The dictionary is too large for a literal; join it instead."""


def fits_literal(entries: Mapping[str, object]) -> bool:
    return len(entries) <= MAX_LITERAL_ENTRIES


def literal_lookup(entries: Mapping[str, object], value_type: str):
    """Return ``key column -> value column`` (null when the key is absent)."""
    if len(entries) > MAX_LITERAL_ENTRIES:
        raise TooManyEntries(f"{len(entries)} entries; use the joined form of this operator")
    # Most words are absent: they mostly meet a bucket without a map, so no key is compared.
    buckets = max(1, len(entries) * 4)
    table: list[dict[str, object] | None] = [None] * buckets
    for key, value in entries.items():
        slot = zlib.crc32(key.encode("utf-8")) % buckets
        table[slot] = (table[slot] or {}) | {key: value}
    literal = F.from_json(
        F.lit(json.dumps(table, ensure_ascii=False)), f"array<map<string,{value_type}>>"
    )

    def lookup(key: Column) -> Column:
        slot = F.pmod(F.crc32(key), F.lit(buckets)).cast("int")
        return F.get(literal, slot)[key]

    return lookup


def shared_lookup(
    df: DataFrame, keys: Column, tables: Mapping[str, tuple[Mapping[str, object], str]]
) -> DataFrame:
    """Add, for each name in ``tables``, the values of a word array's elements, null where a word is absent.

    ``tables`` maps names to (dictionary, ``int`` or ``double``); all must have the same keys. An array that
    is null gives an empty one.
    """
    first, _ = next(iter(tables.values()))
    if len(first) > MAX_SHARED_ENTRIES:
        raise TooManyEntries(f"{len(first)} entries; at most {MAX_SHARED_ENTRIES} are shared")
    words = pa.array(list(first), pa.string())
    columns = {n: pa.array([t[w] for w in first], _KINDS[kind][0]) for n, (t, kind) in tables.items()}
    shared = df.sparkSession.sparkContext.broadcast((words, columns))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = shared.value
        for batch in batches:
            arrays = batch.column("_keys")
            place = pc.index_in(arrays.flatten(), value_set=known)
            offsets = arrays.offsets.to_numpy()
            offsets = pa.array(offsets - offsets[0], pa.int32())
            added = [pa.ListArray.from_arrays(offsets, values[n].take(place)) for n in values]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *added], [*names, *values])

    lists = [T.StructField(n, T.ArrayType(_KINDS[kind][1])) for n, (_, kind) in tables.items()]
    # A null array would leave its offsets undefined.
    empty = F.array().cast("array<string>")
    keyed = df.select(*names, F.coalesce(keys, empty).alias("_keys"))
    return keyed.mapInArrow(run, T.StructType([*df.schema.fields, *lists]))
