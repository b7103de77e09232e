"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A paragraph is a line of a text, cut further behind words that a hash of their last letters selects, so that
also a text of one line has many and an edit changes only those around it. Each paragraph, told
apart from equal ones before it by its occurrence, has a 64-bit digest. A sketch is a small table of
cells; a digest is added to one cell of each of three parts: the cell counts it, and takes it and
its check sum by exclusive or. The sketch of one version subtracted from that of another holds only the
digests in which they differ, and cells with a single one left give them back (peeling). When a sketch
is too small for the difference, the same is done with sketches four times as large, and so on until
peeling succeeds. The fingerprint is the smallest sketch.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.llm.common import slices, whole_text
from framescope.session import materialize

#: Cells of a fingerprint: three parts of four. A larger sketch has four times as many.
CELLS = 12
GROWTH = 4
PARTS = 3
#: One in so many words ends a paragraph.
WORDS = 8
#: Letters before a blank whose hash decides.
TAIL = 6
#: Cells of all sketches that are held at once.
HELD_CELLS = 2_000_000
TEXT_BYTES = 4_000_000
# Blanks and line ends of Unicode above U+00FF.
_BLANK = np.array([0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_LINE = np.array([0x2028, 0x2029], np.uint32)
_CELL = np.dtype([("count", "<i4"), ("digest", "<u8"), ("check", "<u4")])


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def paragraphs(texts: list[str]) -> list[list[bytes]]:
    """The paragraphs of each text, as UTF-32, without the blanks around them."""
    raw = "\n".join(texts).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(raw, np.uint32)
    blank = (codes <= 32) | (codes == 0x85) | (codes == 0xA0)
    line = ((codes >= 10) & (codes <= 13)) | (codes == 0x85)
    if codes.max(initial=0) >= _BLANK[0]:
        blank |= np.isin(codes, _BLANK)
        line |= np.isin(codes, _LINE)
    # Words: where a letter has no letter before, or behind.
    first = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    last = np.flatnonzero(~blank & np.append(blank[1:], True))
    out: list[list[bytes]] = [[] for _ in texts]
    if not len(first):
        return out
    tail = np.zeros(len(last), np.uint64)
    for back in range(TAIL):
        code = np.where(last - back >= first, codes[np.maximum(last - back, 0)], 0).astype(np.uint64)
        tail = tail * np.uint64(0x100000001B3) + code
    breaks = np.flatnonzero(line)
    ends = (_mixed(tail, 7) % np.uint64(WORDS)) == 0
    ends[:-1] |= np.searchsorted(breaks, first[1:]) != np.searchsorted(breaks, last[:-1])
    ends[-1] = True
    stop = np.flatnonzero(ends)
    start = first[np.append(0, stop[:-1] + 1)]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(bounds, start, "right")
    for i, a, b in zip(owner.tolist(), start.tolist(), (last[stop] + 1).tolist(), strict=True):
        out[i].append(raw[4 * a : 4 * b])
    return out


def digests(texts: list[str]) -> list[np.ndarray]:
    """For each text distinct 64-bit digests: of each paragraph and how often it occurred before."""
    sets = []
    for parts in paragraphs(texts):
        seen: dict[bytes, int] = {}
        values = []
        for part in parts:
            before = seen.get(part, 0)
            seen[part] = before + 1
            values.append(xxhash.xxh64_intdigest(part, before))
        sets.append(np.array(values, np.uint64))
    return sets


class Sketches:
    """Sketches of several sets of digests, all with the same number of cells."""

    def __init__(self, number: int, cells: int):
        self.number, self.cells = number, cells
        self.count = np.zeros(number * cells, np.int64)
        self.digest = np.zeros(number * cells, np.uint64)
        self.check = np.zeros(number * cells, np.uint64)

    def add(self, owner: np.ndarray, digest: np.ndarray, sign: np.ndarray | int) -> np.ndarray:
        """Add digests (or take them away, with a sign of -1); returns the cells they are in."""
        part = self.cells // PARTS
        check = _mixed(digest, 1) >> np.uint64(32)
        touched = []
        for i in range(PARTS):
            cell = (_mixed(digest, 11 + i + self.cells) % np.uint64(part)).astype(np.int64) + i * part + owner * self.cells
            np.add.at(self.count, cell, sign)
            np.bitwise_xor.at(self.digest, cell, digest)
            np.bitwise_xor.at(self.check, cell, check)
            touched.append(cell)
        return np.concatenate(touched)

    def minus(self, other: Sketches) -> Sketches:
        left = Sketches(self.number, self.cells)
        left.count = self.count - other.count
        left.digest = self.digest ^ other.digest
        left.check = self.check ^ other.check
        return left

    def strings(self) -> list[str]:
        """Each sketch in base 64: of every cell the count, the digests and the check sums, little-endian."""
        packed = np.zeros(len(self.count), _CELL)
        packed["count"], packed["digest"], packed["check"] = self.count, self.digest, self.check
        raw, size = packed.tobytes(), self.cells * _CELL.itemsize
        return [base64.b64encode(raw[i * size : (i + 1) * size]).decode() for i in range(self.number)]

    @staticmethod
    def of_strings(texts: list[str]) -> Sketches:
        raw = [base64.b64decode(t) for t in texts]
        sketches = Sketches(len(raw), len(raw[0]) // _CELL.itemsize if raw else CELLS)
        packed = np.frombuffer(b"".join(raw), _CELL)
        sketches.count, sketches.digest = packed["count"].astype(np.int64), packed["digest"].astype(np.uint64)
        sketches.check = packed["check"].astype(np.uint64)
        return sketches

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(decoded, owner, digest, sign): which sketches emptied, and all digests that came out.

        Peels until no cell with a single digest is left; a sketch is decoded if all its cells are empty.
        """
        owners, found, signs = [], [], []
        cells = np.arange(len(self.count))
        while len(cells):
            pure = cells[np.abs(self.count[cells]) == 1]
            pure = pure[(_mixed(self.digest[pure], 1) >> np.uint64(32)) == self.check[pure]]
            owner, digest, sign = pure // self.cells, self.digest[pure], self.count[pure]
            order = np.lexsort((digest, owner))
            owner, digest, sign = owner[order], digest[order], sign[order]
            new = np.ones(len(order), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1])
            owner, digest, sign = owner[new], digest[new], sign[new]
            if not len(owner):
                break
            owners.append(owner)
            found.append(digest)
            signs.append(sign)
            cells = np.unique(self.add(owner, digest, -sign))
        left = (self.count != 0) | (self.digest != 0) | (self.check != 0)
        decoded = ~left.reshape(self.number, self.cells).any(axis=1)
        if not owners:
            return decoded, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return decoded, np.concatenate(owners), np.concatenate(found), np.concatenate(signs)


def _sketch(sets: list[np.ndarray], cells: int) -> Sketches:
    sketches = Sketches(len(sets), cells)
    if sets:
        sketches.add(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets), 1)
    return sketches


def differences(before: list[np.ndarray], after: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each pair of digest sets: digests only in the first, only in the second, cells it took.

    Pairs whose difference does not come out of the sketches of one size are tried again with larger
    ones. The smallest are those of the fingerprints.
    """
    out: list[tuple[np.ndarray, np.ndarray, int] | None] = [None] * len(before)
    open_pairs, cells = np.arange(len(before)), CELLS
    while len(open_pairs):
        failed = []
        step = max(1, HELD_CELLS // cells)
        for at in range(0, len(open_pairs), step):
            part = open_pairs[at : at + step]
            left = _sketch([before[i] for i in part], cells).minus(_sketch([after[i] for i in part], cells))
            decoded, owner, digest, sign = left.peel()
            order = np.argsort(owner, kind="stable")
            owner, digest, sign = owner[order], digest[order], sign[order]
            bounds = np.searchsorted(owner, np.arange(len(part) + 1))
            for j, i in enumerate(part):
                mine = slice(bounds[j], bounds[j + 1])
                if decoded[j]:
                    out[i] = digest[mine][sign[mine] > 0], digest[mine][sign[mine] < 0], cells
                else:
                    failed.append(i)
        open_pairs, cells = np.array(failed, np.int64), cells * GROWTH
    return out


def likeness(n_before: int, n_after: int, differing: int) -> float:
    """Share of the paragraphs of both that they have in common; 1 if neither has any."""
    both = n_before + n_after
    return (both - differing) / both if both else 1.0


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, fingerprint) of every whole text, a row per row.

    Null texts are empty; texts without a letter have no paragraph and an empty sketch. Equal
    texts have equal fingerprints. A null identifier stays null. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            sets = digests(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(_sketch(sets, CELLS).strings())],
                ["doc_id", "n_paragraphs", "fingerprint"],
            )

    rows = docs.select("doc_id", whole_text().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_paragraphs bigint, fingerprint string")


def compare_versions(versions: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, removed, added, cells, likeness) of two text columns, a row per row.

    ``removed`` and ``added`` are the digests of the paragraphs in which the versions differ, as the
    sketches give them back, ``cells`` the size of sketch it took. Null texts are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "before", TEXT_BYTES // 2):
            first = digests(batch.column("before").to_pylist())
            second = digests(batch.column("after").to_pylist())
            found = differences(first, second)
            like = [likeness(len(a), len(b), len(d[0]) + len(d[1])) for a, b, d in zip(first, second, found, strict=True)]
            sides = [pa.array([np.sort(d[i].view(np.int64)) for d in found], pa.list_(pa.int64())) for i in (0, 1)]
            cells = pa.array([d[2] for d in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *sides, cells, pa.array(like, pa.float64())], [key, "removed", "added", "cells", "likeness"]
            )

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = versions.select(F.col(key), text(before).alias("before"), text(after).alias("after"))
    kind = versions.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind}, removed array<bigint>, added array<bigint>, cells bigint, likeness double")


def half_replaced(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_COMPARED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary,"
    " near_edited double, near_next double"
)


def _compare(ids: pa.Array, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """The columns of ``_COMPARED`` for texts and the texts that follow them; sketches as bytes."""
    edited = [half_replaced(a, b) for a, b in zip(texts, following, strict=True)]
    distinct = list(dict.fromkeys([*texts, *following]))
    known = dict(zip(distinct, digests(distinct), strict=True))
    own, after, changed = [known[t] for t in texts], [known[t] for t in following], digests(edited)
    near = [
        [likeness(len(a), len(b), len(d[0]) + len(d[1])) for a, b, d in zip(own, other, differences(own, other), strict=True)]
        for other in (changed, after)
    ]
    prints = [[base64.b64decode(s) for s in _sketch(sets, CELLS).strings()] for sets in (own, changed)]
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in edited]),
            *[pa.array(p, pa.binary()) for p in prints],
            *[pa.array(n, pa.float64()) for n in near],
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row of a sorted range with the next one.

    The last row of a range has none: it is passed on with its text, and so is the first, which some
    other range's last row needs.
    """
    context = TaskContext.get()
    task = context.partitionId() if context else 0
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]

    def edge(side: str, doc_id: int | None, text: str) -> pa.RecordBatch:
        columns = [pa.array([doc_id], kinds[0]), *[pa.nulls(1, k) for k in kinds[1:]]]
        columns += [pa.array([task], pa.int64()), pa.array([side]), pa.array([text])]
        return pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    names += ["task", "side", "text"]
    held: tuple[int | None, str] | None = None
    for batch in slices(batches, "text", TEXT_BYTES):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        if held is None:
            yield edge("first", ids[0], texts[0])
        else:
            ids, texts = [held[0], *ids], [held[1], *texts]
        held = ids[-1], texts[-1]
        if len(ids) > 1:
            rows = _compare(pa.array(ids[:-1], pa.int64()), texts[:-1], texts[1:])
            size = rows.num_rows
            extra = [pa.nulls(size, pa.int64()), pa.nulls(size, pa.string()), pa.nulls(size, pa.string())]
            yield pa.RecordBatch.from_arrays([*rows.columns, *extra], names)
    if held is not None:
        yield edge("last", *held)


def _compare_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", TEXT_BYTES):
        yield _compare(batch.column("doc_id"), batch.column("text").to_pylist(), batch.column("following").to_pylist())


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document, in descending identifiers, against the next one and against its half-replaced version.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row per row.
    The document after the last is the first. Null texts are empty. Null identifiers come last and stay null; rows with equal
    identifiers follow each other by a hash of the text, then by the text. Other columns are not read.

    One shuffle of the texts into sorted ranges; rows that share an identifier, or are equal, may lie in several. Only
    the first and last row of each range meet another range's rows, in a join by range number.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), whole_text().alias("text"), F.monotonically_increasing_id().alias("row"))
    order: list[Column] = [F.desc_nulls_last("doc_id"), F.xxhash64("text").asc()]
    ranges = rows.repartitionByRange(*order, "row").sortWithinPartitions(*order, "text").select("doc_id", "text")
    walked = materialize(ranges.mapInArrow(_walk, f"{_COMPARED}, task bigint, side string, text string"), "fingerprints")
    # Two rows a range at most; range numbers alone are put in order in one task.
    sides = walked.filter("side IS NOT NULL")
    first = sides.filter("side = 'first'").select(F.col("task").alias("next"), F.col("text").alias("following"))
    numbers = sorted(r["task"] for r in sides.filter("side = 'first'").select("task").collect())
    onward = docs.sparkSession.createDataFrame(
        list(zip(numbers, [*numbers[1:], *numbers[:1]], strict=True)), "task bigint, next bigint"
    )
    edges = sides.filter("side = 'last'").join(onward, "task").join(first, "next").select("doc_id", "text", "following")
    done = walked.filter("side IS NULL").drop("task", "side", "text").unionByName(edges.mapInArrow(_compare_edges, _COMPARED))
    return done.withColumns({c: F.base64(c) for c in ("fingerprint", "edited_fingerprint")})
