"""Exact deduplication by sorting the contents.

Rows are range-partitioned at sampled splitters and sorted; equal texts become neighbours, and each
row is compared in full with the row before it. The sort key starts with a bounded head of the
bytes and a digest, which keeps sampled splitters small, and ends with the identifier, so a group of
any size is cut into as many ranges as it needs. Only the first and the last run of a range can go on
in another range; these few are merged by digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm.common import NONE_HIGH, NONE_LOW, known_id, or_null, slices, whole_text
from framescope.session import materialize

HEAD_CHARS = 24
RUN_SCHEMA = "doc_id bigint, text_sha256 string, run_keep bigint, run_size bigint, edge boolean, leads boolean, repeats boolean"


def _runs(keep_largest: bool):  # noqa: ANN202
    """Compares neighbours of a sorted range: for each row its run's size and the row that stays."""

    def emit(ids: np.ndarray, digests: pa.Array, bounds: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(bounds)
        best = np.maximum.reduceat if keep_largest else np.minimum.reduceat
        leads = np.zeros(len(ids), bool)
        leads[bounds[:-1]] = True
        repeats = np.append(False, ids[1:] == ids[:-1]) & ~leads
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids),
                digests,
                pa.array(np.repeat(best(ids, bounds[:-1]), sizes)),
                pa.array(np.repeat(sizes, sizes)),
                pa.array(np.repeat(edges, sizes)),
                pa.array(leads),
                pa.array(repeats),
            ],
            ["doc_id", "text_sha256", "run_keep", "run_size", "edge", "leads", "repeats"],
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The open run is kept as identifiers and one text: a range holds a bounded share of a group.
        ids, digests, last_text, first = [], [], None, True
        for batch in slices(batches, "text", 8_000_000):
            texts = batch.column("text").to_pylist()
            new = np.array([text != before for text, before in zip(texts, [last_text, *texts], strict=False)])
            last_text = texts[-1]
            ids.append(batch.column("doc_id").to_numpy())
            digests.append(batch.column("text_sha256"))
            starts = np.flatnonzero(new) + sum(map(len, ids[:-1]))
            if not len(starts) or starts[-1] == 0:
                continue  # still the same run
            done = int(starts[-1])
            all_ids, all_digests = np.concatenate(ids), pa.chunked_array(digests).combine_chunks()
            bounds = np.append(np.unique(np.append(0, starts[:-1])), done)
            edges = np.zeros(len(bounds) - 1, bool)
            edges[0], first = first, False
            yield emit(all_ids[:done], all_digests[:done], bounds, edges)
            ids, digests = [all_ids[done:]], [all_digests[done:]]
        if ids:
            all_ids, all_digests = np.concatenate(ids), pa.chunked_array(digests).combine_chunks()
            yield emit(all_ids, all_digests, np.array([0, len(all_ids)]), np.array([True]))

    return compare


def content_groups(docs: DataFrame, keep_largest: bool = False) -> DataFrame:
    """Groups of equal whole texts: (doc_id, keep_id, group_size, kept, text_sha256), a row per row.

    A null text counts as an empty one. Of each group the row with the smallest identifier stays, or
    with the largest; one row, even if rows repeat that identifier with the same text. A row without an
    identifier stays only where its whole group has none; its identifier stays null. Other columns are not read.

    One shuffle of the texts. The merged runs are broadcast: at most two for each range.
    """
    none = NONE_LOW if keep_largest else NONE_HIGH
    groups = _groups(docs, keep_largest, none)
    return groups.withColumns({c: or_null(c, none) for c in ("doc_id", "keep_id")})


def _groups(docs: DataFrame, keep_largest: bool, none: int) -> DataFrame:
    """As ``content_groups``, with ``none`` for missing identifiers."""
    rows = docs.select(
        known_id(none).alias("doc_id"),
        whole_text().alias("text"),
        F.sha2(whole_text(), 256).alias("text_sha256"),
        F.substring(whole_text(), 1, HEAD_CHARS).alias("head"),
    )
    keys = ["head", "text_sha256", "doc_id"]
    ranges = rows.repartitionByRange(*keys).sortWithinPartitions("head", "text_sha256", "text", "doc_id")
    compared = ranges.select("doc_id", "text", "text_sha256").mapInArrow(_runs(keep_largest), RUN_SCHEMA)
    runs = materialize(compared, "content-runs")
    best = F.max if keep_largest else F.min
    merged = (
        runs.filter("edge and leads")
        .groupBy("text_sha256")
        .agg(best("run_keep").alias("_keep"), F.sum("run_size").alias("_size"))
    )
    joined = runs.join(F.broadcast(merged), "text_sha256", "left")
    inner = ~F.col("edge")
    keep = F.when(inner, F.col("run_keep")).otherwise(F.col("_keep"))
    size = F.when(inner, F.col("run_size")).otherwise(F.col("_size"))
    kept = (F.col("doc_id") == keep) & ~F.col("repeats")
    return joined.select(
        "doc_id", keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), "text_sha256"
    )


def distinct_contents(docs: DataFrame, keep_largest: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that are kept: one for each text (see ``content_groups``).

    Of rows that repeat identifier and text any one stays. An empty table stays empty.
    """
    none = NONE_LOW if keep_largest else NONE_HIGH
    dropped = _groups(docs, keep_largest, none).filter(F.col("doc_id") != F.col("keep_id"))
    # The row travels as one struct, so no column of the input can clash with the keys.
    keyed = docs.select(F.struct("*").alias("row"), known_id(none).alias("id"), F.sha2(whole_text(), 256).alias("sha"))
    losers = dropped.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).distinct()
    return keyed.join(losers, ["id", "sha"], "left_anti").dropDuplicates(["id", "sha"]).select("row.*")
