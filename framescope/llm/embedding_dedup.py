"""Near-duplicate vectors by randomly rotated binary codes.

Every vector is rotated at random and reduced to the signs of its coordinates, with a correction
factor (the inner product of the vector with its code, RaBitQ: Gao and Long, 2024). Beside the code it
keeps its rotated coordinates at a few bits each, rounded at random. All of this is computed once a
vector and stored. From the code of one vector and the rounded coordinates of another, counts of common
bits give an unbiased estimate of their cosine with a confidence bound. Only vectors in a pair whose
bound reaches the threshold are fetched, and the pair is recomputed in double precision.

Pairs to look at share a band of code bits, of any of several rotations. The number of bits of a
band follows from the number of vectors of the label, and the number of bands from the bits, so that a
pair at the threshold is missed with a stated probability and the work stays near-linear.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm.common import attach, small_join, whole_tasks
from framescope.llm.components import components
from framescope.session import materialize

#: Probability of missing a pair at the threshold, in all bands together.
MISS = 1e-4
#: Vectors of a bucket that one task compares with one another at most; larger buckets are tiled.
TILE = 512
#: Width of the confidence interval in standard deviations of the estimate.
SIGMAS = 4.5
#: Mean number of vectors of a bucket that the number of bits aims at.
BUCKET = 16
#: Number of the rotation that estimates use, apart from those of the bands.
ESTIMATE_ROTATION = 1 << 20
#: Bits of a rounded coordinate.
PLANES = 5


def band_count(bits: int, threshold: float, miss: float = MISS) -> int:
    """Bands of so many bits that a pair at the threshold misses with probability ``miss``."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log1p(-agree))


@lru_cache(maxsize=512)
def rotation(dimensions: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    normal = np.random.default_rng((dimensions, number)).normal(size=(dimensions, dimensions))
    q, r = np.linalg.qr(normal)
    return q * np.sign(np.diag(r))


def band_keys(unit: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Code bits of each band as a number: (vectors, bands). Bits run on over the rotations."""
    rows, d = unit.shape
    signs = [unit @ rotation(d, k).T > 0 for k in range(math.ceil(bits * bands / d))]
    taken = np.hstack(signs)[:, : bits * bands].reshape(rows, bands, bits)
    return taken @ (1 << np.arange(bits, dtype=np.int64))


@dataclass
class Codes:
    """Stored codes of some vectors of d dimensions, one row each, bits packed into 64-bit words."""

    d: int
    sign: np.ndarray
    factor: np.ndarray
    low: np.ndarray
    step: np.ndarray
    planes: np.ndarray

    def at(self, rows: np.ndarray) -> Codes:
        return Codes(self.d, *(x[rows] for x in (self.sign, self.factor, self.low, self.step, self.planes)))

    def blobs(self) -> list[bytes]:
        """Each row's code as bytes: factor, low end, step, signs, planes."""
        numbers = np.stack([self.factor, self.low, self.step], axis=1).astype("<f8")
        bits = np.concatenate([self.sign[:, None], self.planes], axis=1).astype("<u8")
        return [a.tobytes() + b.tobytes() for a, b in zip(numbers, bits, strict=True)]

    @staticmethod
    def of_blobs(blobs: list[bytes], d: int) -> Codes:
        raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
        numbers = raw[:, :24].copy().view("<f8")
        bits = raw[:, 24:].copy().view("<u8").reshape(len(blobs), 1 + PLANES, -1)
        return Codes(d, bits[:, 0], *numbers.T, bits[:, 1:])


def _words(bits: np.ndarray) -> np.ndarray:
    """Booleans of the last axis as 64-bit words."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    missing = -packed.shape[-1] % 8
    padded = np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, missing)])
    return np.ascontiguousarray(padded).view("<u8")


def encode(unit: np.ndarray) -> Codes:
    """Codes of unit vectors: signs after a rotation, correction factor, coordinates in ``PLANES`` bits.

    Coordinates are rounded up or down at random with the mean where it was, so estimates stay unbiased.
    """
    d = unit.shape[1]
    turned = unit @ rotation(d, ESTIMATE_ROTATION).T
    factor = np.abs(turned).sum(axis=1) / math.sqrt(d)
    low = turned.min(axis=1)
    step = np.maximum(turned.max(axis=1) - low, 1e-12) / (2**PLANES - 1)
    noise = np.random.default_rng((d, ESTIMATE_ROTATION)).random(d)
    level = np.floor((turned - low[:, None]) / step[:, None] + noise).clip(0, 2**PLANES - 1).astype(np.int64)
    planes = np.stack([_words((level >> k) & 1 == 1) for k in range(PLANES)], axis=1)
    return Codes(d, _words(turned > 0), factor, low, step, planes)


def estimate_codes(codes: Codes, others: Codes, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of all inner products of two sets of vectors from their codes, and their half widths.

    ``codes`` is seen through signs and factors, ``others`` through rounded coordinates. The half width is
    that of an inner product at the threshold: the closer two vectors, the smaller the error.
    """
    d, weights = codes.d, 2.0 ** np.arange(PLANES)
    common = np.zeros((len(codes.sign), len(others.sign)))
    for k in range(PLANES):
        bits = np.bitwise_count(codes.sign[:, None] & others.planes[None, :, k]).sum(axis=2)
        common += weights[k] * bits
    ones = np.bitwise_count(codes.sign).sum(axis=1).astype(float)
    level = np.bitwise_count(others.planes).sum(axis=2) @ weights
    positive = others.low * ones[:, None] + others.step * common
    whole = others.low * d + others.step * level
    value = (2 * positive - whole) / math.sqrt(d) / codes.factor[:, None]
    spread = np.maximum(1 - codes.factor**2, 0) / max(d - 1, 1) * (1 - threshold**2)
    half = SIGMAS * np.sqrt(spread[:, None] + others.step**2 / 4) / codes.factor[:, None]
    return value, half


def estimate(unit: np.ndarray, other: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """``estimate_codes`` of two sets of unit vectors."""
    return estimate_codes(encode(unit), encode(other), threshold)


def undecided(codes: Codes, left: np.ndarray, right: np.ndarray | None, threshold: float) -> np.ndarray:
    """Which pairs of the rows ``left`` (among themselves if ``right`` is None, else with those) may reach the threshold."""
    if right is None:
        value, half = estimate_codes(codes.at(left), codes.at(left), threshold)
        maybe = value + half >= threshold
        return np.triu(maybe | maybe.T, 1)
    value, half = estimate_codes(codes.at(left), codes.at(right), threshold)
    return value + half >= threshold


def compare_tiles(
    unit: np.ndarray, codes: Codes, keys: np.ndarray | None, left: np.ndarray, right: np.ndarray | None, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of the rows ``left`` (among themselves if ``right`` is None, else with those).

    ``keys`` holds the earlier bands: a pair that shares one of them was found there.
    """
    i, j = np.nonzero(undecided(codes, left, right, threshold))
    i, j = left[i], (left if right is None else right)[j]
    if keys is not None:
        fresh = ~(keys[i] == keys[j]).any(axis=1)
        i, j = i[fresh], j[fresh]
    linked = np.zeros(len(i), bool)
    for part in range(0, len(i), 65536):
        rows = slice(part, part + 65536)
        linked[rows] = (unit[i[rows]] * unit[j[rows]]).sum(axis=1) >= threshold
    return i[linked], j[linked]


def spanning_links(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member to the smallest member of its group within one comparison."""
    low = ids.copy()
    while True:  # at most as many rounds as the longest shortest path, in a few hundred rows
        after = low.copy()
        np.minimum.at(after, i, low[j])
        np.minimum.at(after, j, low[i])
        if (after == low).all():
            break
        low = after
    moved = np.flatnonzero(low != ids)
    return ids[moved], low[moved]


def unit_rows(values: pa.Array) -> np.ndarray:
    """Vectors of one length, at length one."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(values), -1)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Links and components of (vec_id, embedding, label): (vec_id, n_links, component_id, kept).

    Vectors are compared if their labels are equal and not null and their lengths agree. A vector
    that is null, empty, all zero or holds a null or non-finite component links with nothing, and is
    its own component. Equal vectors are one class with a number of members: its members are linked
    with one another, and a link to the class counts once for each. Rows that repeat an identifier, or
    have none, are members of their own; a component is named by its smallest identifier that is not
    null, and by null if it has none: its rows are all kept. Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint"), "label", "embedding")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    numbers = F.concat_ws(",", F.transform("embedding", lambda v: (v.cast("double") + 0.0).cast("string")))
    content = F.concat_ws("|", F.col("label").cast("string"), numbers)
    rows = rows.withColumn("digest", F.when(sound, F.sha2(content, 256)))
    # A class is known by a number of its digest: identifiers may be null or repeat.
    classes = materialize(
        rows.filter("digest is not null")
        .groupBy("digest")
        .agg(F.min("vec_id").alias("least_id"), F.count("*").alias("members"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
        .withColumn("rep", F.xxhash64("digest"))
        .withColumn("d", F.size("embedding")),
        "vector-classes",
    )
    sizes = classes.groupBy("label", "d").agg(F.count("*").alias("n"), F.sum("members").alias("rows"))
    found = _class_links(classes, sizes, threshold)
    counted = found.filter("kind = 0").groupBy(F.col("u").alias("rep")).agg(F.sum("v").alias("links"))
    groups = components(found.filter("kind = 1").select("u", "v")).withColumnRenamed("id", "rep")
    grouped = classes.select("digest", "rep", "least_id", "members").join(groups, "rep", "left").join(counted, "rep", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "rep").cast("string"))
    least = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("classes"))
    total = sum(r["rows"] for r in sizes.select(F.sum("rows").alias("rows")).collect() if r["rows"])
    result = attach(grouped, least, "component", "classes", total).select(
        "digest",
        "members",
        (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"),
        "component_id",
    )
    out = attach(rows.select("vec_id", "digest"), result, "digest", "members", total)
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _class_links(classes: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Rows (kind, u, v): kind 0, class u has links to v members of other classes; kind 1, u links v."""
    bits = F.greatest(F.lit(6), F.least(F.lit(60), F.round(F.log2(F.col("n") / BUCKET + 1)))).cast("int")
    sized = small_join(
        classes.withColumn("block", F.concat_ws("|", F.col("label").cast("string"), "d")),
        sizes.select(F.concat_ws("|", F.col("label").cast("string"), "d").alias("block"), bits.alias("bits")),
        "block",
    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, dims = batch.column("bits").to_numpy(), batch.column("d").to_numpy()
            for width, d in set(zip(widths.tolist(), dims.tolist(), strict=True)):
                rows = np.flatnonzero((widths == width) & (dims == d))
                part = batch.take(pa.array(rows))
                for piece in (part.slice(s, 2048) for s in range(0, part.num_rows, 2048)):
                    unit = unit_rows(piece.column("embedding"))
                    keys = band_keys(unit, width, band_count(width, threshold))
                    offsets = pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("rep"), piece.column("block"), piece.column("d"),
                         pa.array(encode(unit).blobs(), pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))],
                        ["rep", "block", "d", "code", "buckets"],
                    )

    # Codes, factors and bands of every class, computed once.
    codes = materialize(
        sized.select("rep", "block", "d", "bits", "embedding").mapInArrow(
            encoded, "rep bigint, block string, d int, code binary, buckets array<bigint>"
        ),
        "vector-codes",
    )
    # Buckets with two members or more; large ones in tiles, every tile meeting every other once.
    keyed = codes.select("rep", "block", F.posexplode("buckets").alias("band", "bucket"))
    keyed = keyed.select("rep", F.xxhash64("block", "band", "bucket").alias("place"), "band")
    shared = materialize(keyed.groupBy("place").agg(F.count("*").alias("n")).filter("n > 1"), "vector-buckets")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    placed = keyed.join(shared.withColumn("tiles", tiles), "place")
    own = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    task = F.xxhash64("place", F.least("own", "other"), F.greatest("own", "other"))
    placed = placed.select("rep", "band", "own", "other", task.alias("task"))
    # First the codes alone: what is in no undecided pair of a task drops out.
    coded = placed.join(codes.select("rep", "d", "code"), "rep")
    screened = materialize(
        coded.repartition("task").sortWithinPartitions("task", "rep").mapInArrow(
            lambda batches: screen(batches, threshold), "task bigint, rep bigint, band int, own int, other int, code binary"
        ),
        "vector-undecided",
    )
    wide = screened.join(sized.select("rep", "members", "bits", "embedding"), "rep")
    ordered = wide.repartition("task").sortWithinPartitions("task", "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tasks(batches):
            yield from compare_task(table, threshold)

    return materialize(
        ordered.select("task", "rep", "band", "own", "other", "members", "bits", "embedding", "code").mapInArrow(
            compare, "kind int, u bigint, v bigint"
        ),
        "vector-links",
    )


def _sides(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray | None] | None:
    """The rows of a task's two tiles; None for the second if there is one, None if one of two is missing."""
    low = min(own.min(), other.min())
    left, right = np.flatnonzero(own == low), np.flatnonzero(own != low)
    if not (own != other).any():
        return np.arange(len(own)), None
    return (left, right) if len(left) and len(right) else None


def screen(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The rows of each task that are in a pair whose estimate may reach the threshold."""
    for table in whole_tasks(batches):
        task = table.column("task").to_numpy()
        own, other, dims = (table.column(c).to_numpy() for c in ("own", "other", "d"))
        blobs = table.column("code").to_pylist()
        bounds = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
        kept = np.zeros(len(task), bool)
        for start, end in zip(bounds, np.append(bounds[1:], len(task)), strict=True):
            if end - start < 2 or len(set(dims[start:end])) > 1:
                continue
            sides = _sides(own[start:end], other[start:end])
            if sides is None:
                continue
            left, right = sides
            maybe = undecided(Codes.of_blobs(blobs[start:end], int(dims[start])), left, right, threshold)
            second = left if right is None else right
            kept[start + left[maybe.any(axis=1)]] = True
            kept[start + second[maybe.any(axis=0)]] = True
        names = ["task", "rep", "band", "own", "other", "code"]
        yield from table.select(names).filter(pa.array(kept)).combine_chunks().to_batches()


def compare_task(table: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of all tasks of a table, as counts of members and as links to the smallest."""
    task = table.column("task").to_numpy()
    get = {c: table.column(c).to_numpy() for c in ("rep", "band", "own", "other", "members", "bits")}
    vectors = table.column("embedding").combine_chunks()
    blobs = table.column("code").to_pylist()
    lengths = vectors.value_lengths().to_numpy()
    bounds = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
    rows_u, rows_v, links_u, links_v = [], [], [], []
    for start, end in zip(bounds, np.append(bounds[1:], len(task)), strict=True):
        if end - start < 2 or len(set(lengths[start:end])) > 1:
            continue
        unit = unit_rows(vectors.slice(start, end - start))
        codes = Codes.of_blobs(blobs[start:end], unit.shape[1])
        width, band = int(get["bits"][start]), int(get["band"][start])
        keys = band_keys(unit, width, band) if band else None
        sides = _sides(get["own"][start:end], get["other"][start:end])
        if sides is None:
            continue
        i, j = compare_tiles(unit, codes, keys, *sides, threshold)
        ids, members = get["rep"][start:end], get["members"][start:end]
        links = np.bincount(i, members[j], len(ids)) + np.bincount(j, members[i], len(ids))
        hit = np.flatnonzero(links)
        rows_u.append(ids[hit])
        rows_v.append(links[hit].astype(np.int64))
        u, v = spanning_links(ids, i, j)
        links_u.append(u)
        links_v.append(v)
    if not rows_u:
        return
    u, v = np.concatenate([*rows_u, *links_u]), np.concatenate([*rows_v, *links_v])
    kind = np.repeat(np.array([0, 1], np.int32), [sum(map(len, rows_u)), sum(map(len, links_u))])
    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(u), pa.array(v)], ["kind", "u", "v"])
