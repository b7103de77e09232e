"""Near-duplicate documents by ProbMinHash over weighted word shingles.

Each distinct shingle of a text is an element whose weight is the number of times it occurs. Its
arrivals form a Poisson process with that rate, each falling on one register; a register keeps the
element that arrives first, and a text is done once every pending arrival is later than all registers
(Ertl, 2020). Two texts agree in a register with the probability Jaccard similarity of their weights.

Bands of registers give buckets. In every bucket each text is first compared with one centre, the text
that meets most others. Where a bucket then still holds several components, the texts outside its
largest one are compared with all its texts of other components. For this, the texts of all buckets
with the same largest component come together, in tiles of bounded size, and a tile's similarities
follow from products of matrices; no list of pairs is made. Every comparison is exact, on whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm.common import NONE_HIGH, attach, known_id, or_null, slices, whole_tasks, whole_text
from framescope.llm.components import components
from framescope.session import materialize

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: A pair at similarity 0.8 is in no common bucket with a probability of 5e-5.
BANDS, REGISTERS_PER_BAND = 26, 5
MAX_WORDS = 500_000
#: Texts of a tile, and columns of a block of the matrices that compare tiles.
TILE, COLUMNS = 512, 4096
_WORD = re.compile(r"\w+")


class _WordHashes(dict):
    """64-bit hash of each word, in a bounded table."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of the distinct shingles of each text, by text and hash.

    Words are runs of letters, digits and underscores in lower case. A text with fewer words than a
    shingle is one shingle; one without words has none.
    """
    look_up, lengths, values = _HASHES.__getitem__, [], []
    for text in texts:
        found = _WORD.findall(text.lower())
        lengths.append(len(found))
        values.extend(map(look_up, found))
    sizes = np.array(lengths, np.int64)
    hashes = np.array(values, np.uint64)
    ends = np.cumsum(sizes)
    prime = np.uint64(0x9E3779B97F4A7C15)
    n = max(len(hashes) - words + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled = rolled * prime + hashes[k : k + n]
    owner = np.repeat(np.arange(len(texts)), sizes)
    valid = np.flatnonzero(np.arange(n) + words <= ends[owner[:n]]) if n else np.zeros(0, np.int64)
    owners, values = owner[valid], rolled[valid]
    short = np.flatnonzero((sizes > 0) & (sizes < words))
    whole = np.zeros(len(short), np.uint64)
    for k, i in enumerate(short):
        for h in hashes[ends[i] - sizes[i] : ends[i]]:
            whole[k : k + 1] = whole[k : k + 1] * prime + h + np.uint64(1)
    owners, values = np.append(owners, short), mix(np.append(values, whole))
    order = np.lexsort((values, owners))
    owners, values = owners[order], values[order]
    first = np.flatnonzero(np.append(True, (values[1:] != values[:-1]) | (owners[1:] != owners[:-1]))[: len(values)])
    weight = np.diff(np.append(first, len(values)))
    return owners[first], values[first], weight.astype(np.float64)


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """ProbMinHash of weighted elements: (texts, registers), the element that arrives first."""
    earliest = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    time = np.zeros(len(owner))
    active = np.arange(len(owner))
    turn = 0
    while len(active):
        turn += 1
        draw = mix(element[active] + np.uint64(turn * 0xD1342543DE82EF95 % (1 << 64)))
        time[active] -= np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight[active]
        register = (mix(draw) % np.uint64(registers)).astype(np.int64)
        cell, now = owner[active] * registers + register, time[active]
        sooner = np.flatnonzero(now < earliest[cell])
        late_first = sooner[np.argsort(-now[sooner], kind="stable")]  # of several the soonest is written last
        earliest[cell[late_first]] = now[late_first]
        winner[cell[late_first]] = element[active[late_first]]
        last = earliest.reshape(texts, registers).max(axis=1)
        active = active[now < last[owner[active]]]
    return winner.reshape(texts, registers)


def bucket_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key of each band, different for different bands."""
    texts, registers = signature.shape
    rows = signature.reshape(texts, bands, registers // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (texts, bands))
    for k in range(registers // bands):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return key.astype(np.int64)


def probability_jaccard(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two sets of (sorted elements, weights); 0 if one is empty.

    With equal weights it is the plain Jaccard similarity, if both texts have the same weight.
    """
    both = np.union1d(left[0], right[0])
    if not len(left[0]) or not len(right[0]):
        return 0.0
    x, y = np.zeros(len(both)), np.zeros(len(both))
    x[np.searchsorted(both, left[0])] = left[1]
    y[np.searchsorted(both, right[0])] = right[1]
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio)
    ratio, x, y = ratio[order], x[order], y[order]
    # For a common element with ratio t: the sum over all of max(x, t y), elements of equal ratio alike.
    y_below, x_rest = np.append(0, np.cumsum(y)), np.append(np.cumsum(x[::-1])[::-1], 0)
    at = np.searchsorted(ratio, ratio)
    common = (x > 0) & (y > 0)
    t, place = ratio[common], at[common]
    return float((x[common] / (x_rest[place] + t * y_below[place])).sum())


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE_WORDS) -> DataFrame:
    """Groups of near-duplicate whole texts: (doc_id, text_md5, group_id, group_size, kept).

    Two texts are linked if the probability Jaccard similarity of their shingles is ``similarity`` or
    more; a group is what links connect, and equal texts are one member of it for all their rows.
    ``group_id`` is the smallest identifier of the group, whose row is kept: one row, unless the
    table repeats that identifier with the same text. A null identifier stays null and is kept only
    where the whole group has none. Texts without
    words, null and empty ones included, are linked with nothing but their equals. Other columns are
    not read. No bucket is cut, and no list of a bucket's pairs is made.
    """
    groups = _groups(docs, similarity, words)
    return groups.withColumns({c: or_null(c, NONE_HIGH) for c in ("doc_id", "group_id")})


def _groups(docs: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE_WORDS) -> DataFrame:
    """As ``near_groups``, with ``NONE_HIGH`` for missing identifiers."""
    registers = BANDS * REGISTERS_PER_BAND

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            owner, element, weight = shingles(batch.column("text").to_pylist(), words)
            n = batch.num_rows
            keys = bucket_keys(signatures(owner, element, weight, n, registers))
            filled = np.bincount(owner, minlength=n) > 0
            offsets = np.append(0, np.cumsum(np.where(filled, BANDS, 0))).astype(np.int32)
            buckets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[filled].ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_md5"), buckets], ["doc_id", "text_md5", "buckets"]
            )

    rows = docs.select(
        known_id(NONE_HIGH).alias("doc_id"),
        F.md5(whole_text()).alias("text_md5"),
        whole_text().alias("text"),
    )
    sketched = materialize(
        rows.mapInArrow(sketch, "doc_id bigint, text_md5 string, buckets array<bigint>"), "sketches"
    )
    # One member for all rows of a text.
    members = materialize(
        sketched.groupBy("text_md5").agg(
            F.min("doc_id").alias("lowest"), F.count("*").alias("rows"), F.min_by("buckets", "doc_id").alias("buckets")
        ),
        "members",
    )
    placed = members.select("text_md5", F.explode("buckets").alias("bucket"))
    shared = materialize(
        placed.join(placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "bucket"), "buckets"
    )
    met = shared.groupBy("text_md5").agg(F.sum("n").alias("met"))
    centres = shared.join(met, "text_md5").groupBy("bucket").agg(F.max(F.struct("met", "text_md5"))["text_md5"].alias("centre"))
    stars = materialize(
        shared.join(centres, "bucket")
        .filter("text_md5 <> centre")
        .select(F.col("text_md5").alias("u"), F.col("centre").alias("v"))
        .distinct(),
        "pairs",
    )
    texts = _texts_of(rows, shared.select("text_md5").distinct())
    links = materialize(_linked(stars, texts, similarity, words), "links")
    between = materialize(_links_between(shared, components(links), texts, similarity, words), "links")
    links = links.union(between)

    grouped = members.drop("buckets").join(components(links).withColumnRenamed("id", "text_md5"), "text_md5", "left")
    grouped = materialize(grouped.withColumn("component", F.coalesce("component", "text_md5")), "grouped")
    heads = grouped.groupBy("component").agg(
        F.min(F.struct("lowest", "text_md5")).alias("head"), F.sum("rows").alias("group_size"), F.count("*").alias("texts")
    )
    total = sketched.count()
    named = attach(grouped, heads, "component", "texts", total).select("text_md5", "rows", "head", "group_size")
    out = attach(sketched.select("doc_id", "text_md5"), named, "text_md5", "rows", total)
    head = F.col("head")
    return out.select(
        "doc_id",
        "text_md5",
        head["lowest"].alias("group_id"),
        "group_size",
        ((F.col("doc_id") == head["lowest"]) & (F.col("text_md5") == head["text_md5"])).alias("kept"),
    )


def _texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text for each of the wanted digests."""
    # Copies are combined before the shuffle, so a text with very many of them is no hot key.
    distinct = rows.groupBy("text_md5").agg(F.min("text").alias("text"))
    return materialize(distinct.join(wanted, "text_md5", "left_semi"), "texts")


def _linked(pairs: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """The pairs (u, v) whose texts are similar enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, tuple] | None = None
        for batch in slices(batches, "u_text", 4_000_000):
            us, vs = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            left, right = batch.column("u_text").to_pylist(), batch.column("v_text").to_pylist()
            similar = []
            for v, u_text, v_text in zip(vs, left, right, strict=True):
                if held is None or held[0] != v:  # pairs of one centre often follow one another
                    held = (v, shingles([v_text], words)[1:])
                similar.append(probability_jaccard(shingles([u_text], words)[1:], held[1]) >= similarity)
            keep = pa.array(similar)
            yield pa.RecordBatch.from_arrays([pa.array(us).filter(keep), pa.array(vs).filter(keep)], ["u", "v"])

    u = texts.select(F.col("text_md5").alias("u"), F.col("text").alias("u_text"))
    v = texts.select(F.col("text_md5").alias("v"), F.col("text").alias("v_text"))
    return pairs.join(u, "u").join(v, "v").select("u", "v", "u_text", "v_text").mapInArrow(verify, "u string, v string")


def _links_between(shared: DataFrame, found: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """Links (u, v) between texts of one bucket that are in different components so far."""
    placed = shared.select("bucket", "text_md5").join(found.withColumnRenamed("id", "text_md5"), "text_md5", "left")
    placed = placed.withColumn("component", F.coalesce("component", "text_md5"))
    sizes = materialize(placed.groupBy("bucket", "component").count(), "bucket-components")
    mixed = sizes.groupBy("bucket").agg(
        F.count("*").alias("components"), F.max(F.struct("count", "component"))["component"].alias("largest")
    )
    # Once for each largest component, however many buckets its texts share.
    groups = placed.join(mixed.filter("components > 1"), "bucket").select("largest", "text_md5", "component").distinct()
    groups = materialize(groups, "mixed")
    members = F.count("*")
    tiles = groups.groupBy("largest").agg(F.ceil(members / TILE).cast("int").alias("tiles"), members.alias("members"))
    tiled = attach(groups, tiles, "largest", "members", groups.count()).drop("members").withColumn("own", F.pmod(F.xxhash64("text_md5"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    task = F.xxhash64("largest", F.least("own", "other"), F.greatest("own", "other"))
    full = tiled.select("largest", "text_md5", "component", "own", "other", task.alias("task")).join(texts, "text_md5")
    ordered = full.repartition("task").sortWithinPartitions("task", "text_md5")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tasks(batches):
            task = table.column("task").to_numpy()
            bounds = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
            u, v = [], []
            for start, end in zip(bounds, np.append(bounds[1:], len(task)), strict=True):
                part = table.slice(start, end - start)
                names = part.column("text_md5").to_pylist()
                for i, j in tile_links(part, similarity, words):
                    u.append(names[i])
                    v.append(names[j])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(v, pa.string())], ["u", "v"])

    return ordered.mapInArrow(compare, "u string, v string")


def tile_links(part: pa.Table, similarity: float, words: int) -> list[tuple[int, int]]:
    """Enough links between the texts of one task to connect what is similar, at most one less than texts.

    Looks at the pairs with different components of which one is outside the largest; in a task of
    two tiles, at those across them.
    """
    component = np.array(part.column("component").to_pylist(), object)
    own, other = part.column("own").to_numpy(), part.column("other").to_numpy()
    outside = component != np.array(part.column("largest").to_pylist(), object)
    n = len(component)
    if not outside.any() or n < 2:
        return []
    owner, element, weight = shingles(part.column("text").to_pylist(), words)
    total = np.bincount(owner, weight, n)
    plain = np.bincount(owner, weight != 1, n) == 0
    _, column, count = np.unique(element, return_inverse=True, return_counts=True)
    asked = np.zeros(len(count), bool)
    asked[column[outside[owner]]] = True
    number = np.cumsum(asked & (count > 1)) - 1
    used = np.flatnonzero((asked & (count > 1))[column])
    rows, columns, share = owner[used], number[column[used]], (weight[used] / total[owner[used]]).astype(np.float32)
    order = np.argsort(columns, kind="stable")
    rows, columns, share = rows[order], columns[order], share[order]
    left = np.flatnonzero(outside)
    # Of the weight of each text, the share in shingles of the other; columns are taken in blocks.
    mine, theirs = np.zeros((len(left), n), np.float32), np.zeros((len(left), n), np.float32)
    for block in range(0, int(columns[-1]) + 1 if len(columns) else 0, COLUMNS):
        a, b = np.searchsorted(columns, [block, block + COLUMNS])
        p = np.zeros((n, COLUMNS), np.float32)
        p[rows[a:b], columns[a:b] - block] = share[a:b]
        has = (p > 0).astype(np.float32)
        mine += p[left] @ has.T
        theirs += has[left] @ p.T
    # Both bound the similarity; without repeated shingles they give it.
    common = mine * total[left][:, None]
    exact = plain[left][:, None] & plain[None]
    least = np.where(exact, common / (total[left][:, None] + total[None] - common), np.minimum(mine, theirs))
    wanted = (least >= similarity - 1e-4) & (component[left][:, None] != component[None])
    wanted &= ~outside[None] | (left[:, None] < np.arange(n)[None])
    if (own != other).any():
        wanted &= own[left][:, None] != own[None]
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ends = np.searchsorted(owner, np.arange(n + 1))
    sets = [(element[a:b], weight[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    links = []
    for i, j in zip(left[np.nonzero(wanted)[0]].tolist(), np.nonzero(wanted)[1].tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b and probability_jaccard(sets[i], sets[j]) >= similarity:
            root[max(a, b)] = min(a, b)
            links.append((i, j))
    return links


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, less all but one of each group (see ``near_groups``).

    Of rows that repeat identifier and text any one stays. An empty table stays empty.
    """
    losers = _groups(docs).filter("not kept").select(F.col("doc_id").alias("id"), F.col("text_md5").alias("md5"))
    # The row travels as one struct, so no column of the input can clash with the keys.
    keyed = docs.select(F.struct("*").alias("row"), known_id(NONE_HIGH).alias("id"), F.md5(whole_text()).alias("md5"))
    kept = keyed.join(losers.distinct(), ["id", "md5"], "left_anti")
    return kept.dropDuplicates(["id", "md5"]).select("row.*")
