"""Several logistic regressions fitted side by side: each step reads the rows once for all of them.

The problems differ in row weights (a weight of 0 leaves a row out), in penalty, or in the feature vectors
they use. Rows are packed once into blocks of sparse matrices. A pass evaluates loss and gradient of every
unfinished problem at its own point. Partial sums are cut into slices that meet in as many tasks, so the driver
gets one sum a pass, bounded by columns times problems, however many tasks there are. Each problem has its own
limited-memory quasi-Newton search.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ENTRIES = 1_000_000
MEMORY = 10
#: Partial sums that one task adds up, as long as there are no more than ``MAX_SLICES`` such tasks.
PARTS_A_SLICE = 16
MAX_SLICES = 16


@dataclass
class Sparse:
    """A sparse matrix by rows: of every entry the row, the column and the value."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(vectors: pa.StructArray) -> Sparse:
        indices, values = vectors.field("indices"), vectors.field("values")
        counts = np.diff(indices.offsets.to_numpy())
        row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        return Sparse(row, indices.flatten().to_numpy(), values.flatten().to_numpy())

    def times(self, coefficients: np.ndarray, rows: int) -> np.ndarray:
        return np.bincount(self.row, self.value * coefficients[self.column], rows)

    def transposed_times(self, residual: np.ndarray, columns: int) -> np.ndarray:
        return np.bincount(self.column, self.value * residual[self.row], columns)


@dataclass(frozen=True)
class View:
    """The columns of a shared matrix that a problem uses, in its order, and what each is multiplied by."""

    place: np.ndarray
    scale: np.ndarray


@dataclass(frozen=True)
class LinearFit:
    """Coefficients, intercept and the number of passes it took."""

    coefficients: np.ndarray
    intercept: float
    passes: int


def search(start: np.ndarray, max_iter: int, tolerance: float) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Quasi-Newton descent as a dialogue: yields points, is sent loss and gradient, returns the lowest point."""
    x = start
    loss, gradient = yield x
    pairs: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=MEMORY)
    for _ in range(max_iter):
        direction = -gradient
        if pairs:
            kept = []
            for s, y in reversed(pairs):
                a = s @ direction / (s @ y)
                direction = direction - a * y
                kept.append(a)
            s, y = pairs[-1]
            direction = direction * (s @ y) / (y @ y)
            for (s, y), a in zip(pairs, reversed(kept), strict=True):
                direction = direction + s * (a - y @ direction / (s @ y))
        slope = gradient @ direction
        if slope >= 0:
            pairs.clear()
            direction, slope = -gradient, -(gradient @ gradient)
        if slope == 0:
            return x
        step = 1.0 if pairs else min(1.0, 1.0 / np.sqrt(-slope))
        while True:
            point = x + step * direction
            new_loss, new_gradient = yield point
            if new_loss <= loss + 1e-4 * step * slope:
                break
            step /= 2
            if step < 1e-12:
                return x
        moved, turned = point - x, new_gradient - gradient
        if moved @ turned > 1e-12 * (turned @ turned):
            pairs.append((moved, turned))
        done = loss - new_loss <= tolerance * max(abs(loss), abs(new_loss), 1e-12)
        x, loss, gradient = point, new_loss, new_gradient
        if done:
            break
    return x


def _margin(matrix: Sparse, x: np.ndarray, rows: int, view: View | None, shares: np.ndarray | None, width: int) -> np.ndarray:
    """What a point (coefficients and intercept) gives each row; ``width`` is the number of columns of a shared matrix."""
    if view is None:
        return matrix.times(x[:-1], rows) + x[-1]
    spread = np.zeros(width)
    spread[view.place] = x[:-1] * view.scale
    return matrix.times(spread, rows) * shares + x[-1]


def _packed(frame: DataFrame, features: Sequence[str], label: str, weights: str, shares: str | None) -> RDD:
    """Blocks (labels, weights and shares by problem, matrices by feature column) in memory or on the executors' disks."""
    names = sorted(set(features))
    arrays = ["_weights"] if shares is None else ["_weights", "_shares"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(np.diff(batch.column(c).field("indices").offsets.to_numpy()) for c in names)
            start = 0
            while start < batch.num_rows:
                rows = max(1, int(np.searchsorted(np.cumsum(sizes[start:]), BLOCK_ENTRIES, "right")))
                part = batch.slice(start, rows)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])
                start += rows

    def unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, dict[str, Sparse]]:  # noqa: ANN001
        batch = pa.ipc.open_stream(row["block"]).read_next_batch()
        flat = [batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in arrays]
        return batch.column("_label").to_numpy(), flat[0], flat[1] if flat[1:] else None, {c: Sparse.of(batch.column(c)) for c in names}

    given = [F.col(c).alias(a) for c, a in zip((weights, shares), arrays)]
    chosen = frame.select(F.col(label).cast("double").alias("_label"), *given, *names)
    return chosen.mapInArrow(pack, "block binary").rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)


def sum_of_arrays(parts: RDD) -> np.ndarray:
    """The sum of an RDD of arrays of one length: added within a task, then slice by slice, each by one task."""
    slices = max(1, min(MAX_SLICES, parts.getNumPartitions() // PARTS_A_SLICE))

    def cut(arrays: Iterator[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        whole: np.ndarray | None = None
        for array in arrays:
            whole = array.copy() if whole is None else np.add(whole, array, out=whole)
        return enumerate([] if whole is None else np.array_split(whole, slices))

    summed = parts.mapPartitions(cut).reduceByKey(np.add, slices, lambda k: k).collect()
    return np.concatenate([part for _, part in sorted(summed, key=lambda s: s[0])])


def fit_stacked(
    frame: DataFrame,
    features: Sequence[str],
    columns: Sequence[int],
    penalties: Sequence[float],
    label: str = "label",
    weights: str = "weights",
    max_iter: int = 100,
    tolerance: float = 1e-6,
    views: Sequence[View] | None = None,
    width: int = 0,
    shares: str | None = None,
) -> list[LinearFit]:
    """One fit per problem: mean weighted log loss plus half the penalty times the squared coefficients.

    ``features[p]`` names the sparse vector column (of ``columns[p]`` columns) of problem p, and the array
    column ``weights`` holds a row's weight in every problem. The intercept is not penalised. ``frame``
    should be stored; rows need a label of 0 or 1.

    With ``views`` the problems share a vector column of ``width`` columns, which is stored once: problem p uses the
    columns of ``views[p]``, and its rows are multiplied by their numbers in the array column ``shares``.
    """
    blocks = _packed(frame, features, label, weights, shares)
    seen = frame.sparkSession.sparkContext.broadcast(views)

    def evaluate(points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, float]]:
        def at_block(block: tuple) -> np.ndarray:
            labels, weight, share, matrices = block
            out = []
            for p, x in points.items():
                matrix = matrices[features[p]]
                view, of_rows = (None, None) if share is None else (seen.value[p], share[:, p])
                margin = _margin(matrix, x, len(labels), view, of_rows, width)
                w = weight[:, p]
                # log(1 + e^m) - y m, without overflow
                loss = np.maximum(margin, 0) + np.log1p(np.exp(-np.abs(margin))) - labels * margin
                residual = w * (1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500))) - labels)
                if view is None:
                    gradient = matrix.transposed_times(residual, len(x) - 1)
                else:
                    gradient = matrix.transposed_times(residual * of_rows, width)[view.place] * view.scale
                out += [gradient, [residual.sum(), w @ loss, w.sum()]]
            return np.concatenate(out)

        ends = np.cumsum([len(x) + 2 for x in points.values()])
        parts = np.split(sum_of_arrays(blocks.map(at_block)), ends[:-1])
        return {p: (float(s[-2]), s[:-2], float(s[-1])) for p, s in zip(points, parts, strict=True)}

    searches = {p: search(np.zeros(columns[p] + 1), max_iter, tolerance) for p in range(len(penalties))}
    points = {p: next(s) for p, s in searches.items()}
    passes = dict.fromkeys(points, 0)
    fits: dict[int, LinearFit] = {}
    while points:
        moved = {}
        for p, (loss, gradient, total) in evaluate(points).items():
            x, scale = points[p], 1.0 / total if total else 0.0
            penalised = np.append(penalties[p] * x[:-1], 0.0)
            passes[p] += 1
            try:
                moved[p] = searches[p].send((loss * scale + penalised @ x / 2, gradient * scale + penalised))
            except StopIteration as end:
                fits[p] = LinearFit(end.value[:-1], float(end.value[-1]), passes[p])
        points = moved
    blocks.unpersist()
    return [fits[p] for p in sorted(fits)]


def predict_stacked(
    frame: DataFrame,
    features: Sequence[str],
    fits: Sequence[LinearFit],
    label: str = "label",
    held: str | None = None,
    views: Sequence[View] | None = None,
    width: int = 0,
    shares: str | None = None,
) -> DataFrame:
    """(problem, label, probability) of every row and problem; with ``held`` only where that array column is true.

    ``views``, ``width`` and ``shares`` are those of ``fit_stacked``.
    """
    names = sorted(set(features))
    models = [np.append(f.coefficients, f.intercept) for f in fits]
    scaled = shares is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrices = {c: Sparse.of(batch.column(c)) for c in names}
            labels = batch.column("_label").to_numpy()
            wanted = batch.column("_held").flatten().to_numpy(zero_copy_only=False).reshape(len(labels), -1)
            share = batch.column("_shares").flatten().to_numpy().reshape(len(labels), -1) if scaled else None
            for p, x in enumerate(models):
                rows = np.flatnonzero(wanted[:, p])
                view, of_rows = (None, None) if share is None else (views[p], share[:, p])
                margin = _margin(matrices[features[p]], x, len(labels), view, of_rows, width)[rows]
                probability = 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))
                columns = [np.full(len(rows), p, np.int32), labels[rows], probability]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["problem", "label", "probability"])

    every = F.array(*[F.lit(True)] * len(models))
    more = [F.col(shares).alias("_shares")] if scaled else []
    chosen = frame.select(
        F.col(label).cast("bigint").alias("_label"), (every if held is None else F.col(held)).alias("_held"), *more, *names
    )
    return chosen.mapInArrow(run, "problem int, label bigint, probability double")
