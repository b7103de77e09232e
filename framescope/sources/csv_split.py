"""Records of CSV files with line ends inside quotes, read in splits.

A file is read as physical lines, in as many splits as Spark makes of it. Whether a line starts a record or
is inside a quoted field follows from all lines before it, but a split needs no more than one bit of them.
A first pass finds for each split how it ends if it starts in either way; these maps, one short row a
split, are composed in order, and the second pass knows how its splits start. Records that cross a border
leave one piece in each split; these few pieces are put together by record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLOSING = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')
_MAPS = "file string, start bigint, outside boolean, inside boolean, closes boolean"
_PIECES = "record string, header boolean, file string, owner bigint, place bigint"


def open_after(line: str, inside: bool) -> bool:
    """Whether a line leaves a quoted field open, given whether it starts inside of one.

    A quote opens a field only as its first character; two quotes inside are one.
    """
    if not inside and '"' not in line:
        return False
    at = 0
    while True:
        if inside or line.startswith('"', at):
            closed = _CLOSING.match(line, at if inside else at + 1)
            if closed is None:
                return True
            at, inside = closed.end(), False
        comma = line.find(",", at)
        if comma < 0:
            return False
        at = comma + 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line): every physical line with the split it is in, in order within a split."""
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    return spark.read.option("lineSep", "\n").text(path).select(*split, F.col("value").alias("line"))


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each split ends for both ways to start, and whether one that starts inside a field ever closes it."""
    splits: dict[tuple[str, int], list[bool]] = {}
    for batch in batches:
        for file, start, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            state = splits.setdefault((file, start), [False, True, False])
            met = state[0] == state[1]
            state[0] = open_after(line, state[0])
            state[1] = state[0] if met else open_after(line, state[1])
            state[2] |= not state[1]
    rows = [(*key, *state) for key, state in splits.items()]
    names = ["file", "start", "outside", "inside", "closes"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _starts(maps: list) -> dict[tuple[str, int], tuple[bool, int]]:
    """For each split whether it starts inside a field, and the split in which that record began."""
    starts: dict[tuple[str, int], tuple[bool, int]] = {}
    inside, owner, file = False, 0, None
    for r in sorted(maps, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            inside, file = False, r["file"]
        starts[file, r["start"]] = inside, owner
        # What is open at the end began here, unless this split is all inside one record.
        if not inside or r["closes"]:
            owner = r["start"]
        inside = r["inside"] if inside else r["outside"]
    return starts


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, header): every record of the files under a path as text; ``header`` marks the first of a file.

    Quotes are doubled inside quoted fields, fields are separated by commas, encoding is UTF-8. Blank records are
    left out; a file that ends inside a quoted field gives what there is of its last record. Order is not kept.
    """
    lines = _lines(spark, path)
    # One row a split; a split holds up to spark.sql.files.maxPartitionBytes.
    shared = spark.sparkContext.broadcast(_starts(lines.mapInArrow(_maps, _MAPS).collect()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple[str, int] | None = None
        held: list[str] = []
        crossing = open_ = False
        number, out = 0, []

        def piece() -> tuple:
            """The lines held, as part of a record that crosses a border of this split."""
            owner = shared.value[here][1] if crossing else here[1]
            header = not crossing and here[1] == number == 0
            return "\n".join(held), header, here[0], owner, 2 * here[1] + (not crossing)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            names = ["record", "header", "file", "owner", "place"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for file, start, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, start) != here:
                    if held:
                        out.append(piece())
                    here, held, number = (file, start), [], 0
                    crossing = open_ = shared.value[here][0]
                held.append(line)
                open_ = open_after(line, open_)
                if open_:
                    continue
                record = "\n".join(held).removesuffix("\r")
                if crossing:
                    out.append(piece())
                elif record:
                    out.append((record, start == number == 0, None, None, None))
                    number += 1
                crossing, held = False, []
            yield batch_of(out)
            out = []
        if held:
            yield batch_of([piece()])

    found = lines.mapInArrow(cut, _PIECES)
    whole = found.filter("file IS NULL").select("record", "header")
    # At most two pieces a split; a record that fills many splits is put together in one row, as it must be.
    parts = found.filter("file IS NOT NULL").groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("place", "record"))).alias("pieces"), F.max("header").alias("header")
    )
    joined = F.array_join(F.transform("pieces", lambda p: p["record"]), "\n")
    return whole.unionByName(parts.select(F.regexp_replace(joined, "\r$", "").alias("record"), "header"))
