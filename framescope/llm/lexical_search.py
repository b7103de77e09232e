"""Ranked lexical search over a length-stratified inverted index.

A document's score for a query is the sum over the query's terms of ``w * impact(tf, m)``, where m grows
with the document's length. All documents with the same m form a stratum, and inside a stratum a posting
contributes by its tf alone, so an impact is computed once per tf. The largest tf of each term in
a stratum bounds what any document there can score; strata are visited in the order of these bounds, and
a query leaves out each stratum whose bound is below its k-th best score so far.

The index is sharded by length: a first pass counts texts and characters by number of terms, from which ranges
of lengths with equal amounts of text follow; a task cuts its range into shards of bounded text. A hot
length is dealt to as many ranges as it needs. A shard is searched
whole, by one task, for a block of queries; shards give at most k rows a query (equal scores
by identifier), and these are ranked together.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framescope.llm.common import slices, whole_text
from framescope.session import materialize

#: Characters that are in no term: ASCII other than letters and digits. A fixed value of the definition.
GAPS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Bounds of a shard: text in characters, and documents.
SHARD_CHARS = 4_000_000
SHARD_DOCS = 4096
#: Text of a range of lengths, in characters.
RANGE_CHARS = 24_000_000
#: Lengths are counted one by one up to this one, then in 64 steps for each doubling.
EXACT_LENGTH = 4096
#: Query terms and queries searched in one pass over the index: a block is sent to every task.
BLOCK_TERMS = 50_000
BLOCK_QUERIES = 1000
#: Cells (queries x documents of a stratum, or postings x queries that use them) that are held at once.
CELLS = 1_000_000
_TERM = re.compile(b"[0-9a-z\x80-\xff]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_INDEX = "shard bigint, term string, tfs array<int>, rows array<int>, ids array<bigint>, lengths array<bigint>"


def terms_of(text: str) -> list[bytes]:
    """Terms of a text in UTF-8: runs of ASCII letters, digits and all other characters, A-Z lower-cased."""
    return _TERM.findall(text.encode("utf-8", "replace").translate(_LOWER))


@dataclass(frozen=True)
class LexicalIndex:
    """A written index: ``postings`` as in ``build_index``, documents with a term, and all their terms."""

    postings: DataFrame
    documents: int
    terms: int

    def normaliser(self, length: np.ndarray) -> np.ndarray:
        """m of documents of so many terms, in exact integers."""
        values, back = np.unique(length, return_inverse=True)
        return np.array([10 + 90 * int(n) * self.documents // self.terms for n in values], np.int64)[back]


def _bucket(length: np.ndarray) -> np.ndarray:
    """Ascending buckets of lengths, a few thousand whatever the texts."""
    long = np.maximum(length, EXACT_LENGTH) / EXACT_LENGTH
    return np.where(length < EXACT_LENGTH, length, EXACT_LENGTH + np.floor(64 * np.log2(long))).astype(np.int64)


def _lengths(texts: list[str]) -> np.ndarray:
    return np.array([len(terms_of(t)) for t in texts], np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, documents, terms, chars) of each batch."""
    for batch in slices(batches, "text", SHARD_CHARS):
        texts = batch.column("text").to_pylist()
        length, chars = _lengths(texts), np.array([len(t) for t in texts])
        bucket, back = np.unique(_bucket(length), return_inverse=True)
        sums = [np.bincount(back, w, len(bucket)).astype(np.int64) for w in (length > 0, length, chars)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (bucket, *sums)], ["bucket", "documents", "terms", "chars"])


def _ranged(start: dict[int, tuple[int, int]]):  # noqa: ANN202
    """Adds the number of terms and the range: where a text's bucket starts among all characters, plus a share of it."""
    known = np.array(sorted(start), np.int64)
    first = np.array([start[b][0] for b in known.tolist()], float)
    chars = np.array([start[b][1] for b in known.tolist()], float)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SHARD_CHARS):
            length = _lengths(batch.column("text").to_pylist())
            at = np.searchsorted(known, _bucket(length)).clip(max=len(known) - 1)
            part = ((first[at] + batch.column("share").to_numpy() * chars[at]) // RANGE_CHARS).astype(np.int32)
            columns = [batch.column("doc_id"), batch.column("text"), pa.array(length), pa.array(part)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "length", "part"])

    return add


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, int, Counter]]]:
    """Documents of a range in its order, counted, in lists of bounded size."""
    held, chars = [], 0
    for batch in slices(batches, "text", SHARD_CHARS):
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "length", "text"))
        for doc_id, length, text in zip(*columns, strict=True):
            if not length:
                continue
            if held and (chars + len(text) > SHARD_CHARS or len(held) == SHARD_DOCS):
                yield held
                held, chars = [], 0
            held.append((doc_id, length, Counter(terms_of(text))))
            chars += len(text)
    if held:
        yield held


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per term of a shard, its postings by length, tf and row; one row without a term: the documents."""
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    names = ["shard", "term", "tfs", "rows", "ids", "lengths"]
    for docs in _shards(batches):
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        term = np.array([numbers[t] for _, _, counts in docs for t in counts], np.int64)
        tf = np.array([n for _, _, counts in docs for n in counts.values()], np.int32)
        row = np.repeat(np.arange(len(docs), dtype=np.int32), [len(counts) for _, _, counts in docs])
        length = np.array([d[1] for d in docs], np.int64)
        order = np.lexsort((row, tf, length[row], term))
        # The documents' row comes first, without postings.
        offsets = pa.array(np.append([0, 0], np.cumsum(np.bincount(term, minlength=len(numbers)))), pa.int32())
        directory = pa.array(np.append(0, np.full(len(numbers) + 1, len(docs))), pa.int32())
        columns = [
            pa.array(np.full(len(numbers) + 1, number)),
            pa.array([None, *[t.decode("utf-8", "replace") for t in numbers]], pa.string()),
            pa.ListArray.from_arrays(offsets, pa.array(tf[order])),
            pa.ListArray.from_arrays(offsets, pa.array(row[order])),
            pa.ListArray.from_arrays(directory, pa.array([d[0] for d in docs], pa.int64())),
            pa.ListArray.from_arrays(directory, pa.array(length)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names)
        number += 1


def build_index(docs: DataFrame) -> LexicalIndex:
    """Index of every row and whole text of (doc_id, text), written to the shared scratch folder.

    Texts are shuffled once. Null and empty texts, and others without a term, are not indexed and count in no
    figure. Rows that repeat an identifier, or have none, are documents of their own. Other columns are
    not read.
    """
    texts = docs.select(whole_text().alias("text"))
    counted = texts.mapInArrow(_counted, "bucket bigint, documents bigint, terms bigint, chars bigint")
    sums = sorted(counted.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("documents", "terms", "chars")]).collect())
    start, chars = {}, 0
    for r in sums:
        start[r["bucket"]] = chars, r["chars"]
        chars += r["chars"]
    # The share deals a length that very many documents have to several ranges.
    share = (F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1 << 30)) / float(1 << 30)).alias("share")
    rows = docs.select(F.col("doc_id").cast("bigint"), whole_text().alias("text"), share)
    ranged = rows.mapInArrow(_ranged(start), "doc_id bigint, text string, length bigint, part int")
    ranges = ranged.repartitionById(chars // RANGE_CHARS + 1, "part").sortWithinPartitions("length")
    index = ranges.select("doc_id", "length", "text").mapInArrow(_index_rows, _INDEX)
    return LexicalIndex(materialize(index, "lexical-index"), sum(r["documents"] for r in sums), sum(r["terms"] for r in sums))


class ShardSearch:
    """Search of one shard for a block of queries.

    ``queries`` holds, for each query of the block, the set of its terms; ``weights`` the weight of a term.
    """

    def __init__(self, index: LexicalIndex, queries: Sequence[Sequence[str]], weights: dict[str, int], k: int):
        self.documents, self.terms, self.count, self.k = index.documents, index.terms, len(queries), k
        users: dict[str, list[int]] = {}
        for q, terms in enumerate(queries):
            for term in terms:
                if weights.get(term, 0) > 0:
                    users.setdefault(term, []).append(q)
        self.users = {t: np.array(q, np.int64) for t, q in users.items()}
        self.weights = weights

    def normaliser(self, length: np.ndarray) -> np.ndarray:
        return LexicalIndex(None, self.documents, self.terms).normaliser(length)

    def __call__(self, ids: np.ndarray, lengths: np.ndarray, postings: list[tuple[str, np.ndarray, np.ndarray]]):
        """(query, row, score) of the k best rows of each query, equal scores by ascending ``ids``.

        Rows are ascending in length, so a stratum is a range of rows.
        """
        postings = [p for p in postings if p[0] in self.users]
        nothing = (np.zeros(0, np.int64),) * 3
        if not postings or not self.count:
            return nothing
        m = self.normaliser(lengths)
        starts = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
        ends = np.append(starts[1:], len(m))
        term = np.repeat(np.arange(len(postings)), [len(p[1]) for p in postings])
        tf = np.concatenate([p[1] for p in postings]).astype(np.int64)
        row = np.concatenate([p[2] for p in postings]).astype(np.int64)
        stratum = np.searchsorted(starts, row, "right") - 1
        order = np.lexsort((term, stratum))
        term, tf, row, stratum = term[order], tf[order], row[order], stratum[order]
        borders = np.searchsorted(stratum, np.arange(len(starts) + 1))
        weight = np.array([self.weights[p[0]] for p in postings], np.int64)
        user_count = np.array([len(self.users[p[0]]) for p in postings])
        users = np.concatenate([self.users[p[0]] for p in postings])
        user_start = np.cumsum(user_count) - user_count

        def spread(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """For each query that uses each of the terms: the place in ``terms`` and the query."""
            n = user_count[terms]
            place = np.repeat(np.arange(len(terms)), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            return place, users[user_start[terms[place]] + within]

        def impacts(tf: np.ndarray, m: int) -> np.ndarray:
            """Impacts of a stratum, each computed once per tf."""
            values, back = np.unique(tf, return_inverse=True)
            return ((1_000_000_000 * values) // (1000 * values + 8 * m))[back]

        # The most that a document of the stratum can score: each term with its largest tf there.
        bound = np.zeros((len(starts), self.count), np.int64)
        for s in range(len(starts)):
            a, b = borders[s], borders[s + 1]
            if a == b:
                continue
            first = a + np.flatnonzero(np.append(True, term[a + 1 : b] != term[a : b - 1]))
            most = np.maximum.reduceat(tf[a:b], first - a)
            place, query = spread(term[first])
            np.add.at(bound[s], query, (weight[term[first]] * impacts(most, int(m[starts[s]])))[place])
        best = np.zeros((self.count, self.k), np.int64)  # the k best scores of a query, lowest first
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for s in np.argsort(-bound.max(axis=1), kind="stable"):
            # Equal scores are settled by identifier, so a bound that equals the k-th score counts.
            active = np.flatnonzero((bound[s] > 0) & (bound[s] >= best[:, 0]))
            if not len(active):
                continue
            a, b, size = borders[s], borders[s + 1], int(ends[s] - starts[s])
            add = weight[term[a:b]] * impacts(tf[a:b], int(m[starts[s]]))
            column = row[a:b] - starts[s]
            piece = np.cumsum(user_count[term[a:b]]) // CELLS
            cuts = np.flatnonzero(np.append(True, piece[1:] != piece[:-1])).tolist()
            step = max(1, CELLS // size)
            for at in range(0, len(active), step):
                part = active[at : at + step]
                slot = np.full(self.count, -1, np.int64)
                slot[part] = np.arange(len(part))
                scores = np.zeros((len(part), size), np.int64)
                for x, y in zip(cuts, [*cuts[1:], b - a], strict=True):
                    place, query = spread(term[a + x : a + y])
                    chosen = slot[query] >= 0
                    place = place[chosen] + x
                    np.add.at(scores.reshape(-1), slot[query[chosen]] * size + column[place], add[place])
                q, d = np.nonzero((scores > 0) & (scores >= best[part, :1]))
                found.append((part[q], d + starts[s], scores[q, d]))
                width = min(self.k, size)
                top = np.partition(scores, size - width, axis=1)[:, size - width :]
                best[part] = np.sort(np.concatenate([best[part], top], axis=1), axis=1)[:, -self.k :]
        if not found:
            return nothing
        query, where, score = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = score >= best[query, 0]
        query, where, score = query[keep], where[keep], score[keep]
        order = np.lexsort((where, ids[where], -score, query))
        query, where, score = query[order], where[order], score[order]
        first = np.searchsorted(query, query)
        kept = np.arange(len(query)) - first < self.k
        return query[kept], where[kept], score[kept]


def query_terms(queries: DataFrame, key: str) -> DataFrame:
    """(key, terms): the distinct terms of each query; a null text has none."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted({t.decode("utf-8", "replace") for t in terms_of(x)}) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(terms, pa.list_(pa.string()))], [key, "terms"])

    schema = f"{key} bigint, terms array<string>"
    return queries.select(F.col(key).cast("bigint").alias(key), whole_text().alias("text")).mapInArrow(distinct, schema)


def _blocks(rows: Iterator) -> Iterator[list]:
    """Rows in lists of a bounded number of rows and terms, or of one row."""
    held, size = [], 0
    for row in rows:
        if held and (size + len(row["terms"]) > BLOCK_TERMS or len(held) == BLOCK_QUERIES):
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row["terms"])
    if held:
        yield held


def _search_block(index: LexicalIndex, block: list, key: str, k: int) -> DataFrame:
    spark = index.postings.sparkSession
    terms = sorted({t for row in block for t in row["terms"]})
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string"))
    # The weights of the block's terms: as many rows as the block has terms.
    frequency = (
        index.postings.select("term", F.size("rows").alias("n")).join(wanted, "term").groupBy("term").agg(F.sum("n").alias("df"))
    )
    n = index.documents
    weights = {r["term"]: math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1))) for r in frequency.collect()}
    search = ShardSearch(index, [row["terms"] for row in block], weights, k)
    keys = [row[key] for row in block]
    number = {t: i for i, t in enumerate(terms)}

    def run(table: pa.Table) -> pa.Table:
        names = table.column("term").to_pylist()
        directory = names.index(None)
        listed = table.column("ids")[directory].values
        ids = listed.fill_null((1 << 63) - 1).to_numpy()  # missing identifiers last
        lengths = table.column("lengths")[directory].values.to_numpy()
        postings = [
            (names[i], table.column("tfs")[i].values.to_numpy(), table.column("rows")[i].values.to_numpy())
            for i in range(len(names))
            if i != directory and names[i] in number
        ]
        query, row, score = search(ids, lengths, postings)
        return pa.table(
            {
                "query": pa.array(query),
                "doc_id": listed.take(pa.array(row)),
                "score": pa.array(score),
                key: pa.array([keys[q] for q in query], pa.int64()),
            }
        )

    matched = index.postings.join(wanted, "term", "left_semi").unionByName(index.postings.filter("term IS NULL"))
    return matched.groupBy("shard").applyInArrow(run, f"query bigint, doc_id bigint, score bigint, {key} bigint")


def search_index(index: LexicalIndex, queries: DataFrame, key: str = "item_id", k: int = 10) -> DataFrame:
    """(key, rank, doc_id, score): the k best documents with a score above 0 of each row of (key, text).

    Equal scores go by ascending identifier, a missing one last. Rows of ``queries`` are searched each on their own,
    also with equal keys. Queries without a term, and an empty index, give no rows. Queries are
    searched in blocks of a bounded number of terms, each in one pass over the written index.
    """
    empty = f"{key} bigint, rank int, doc_id bigint, score bigint"
    found = []
    if index.documents:
        asked = query_terms(queries, key).filter(F.size("terms") > 0)
        for block in _blocks(asked.toLocalIterator()):
            best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            ranked = _search_block(index, block, key, k).withColumn("rank", F.row_number().over(best))
            found.append(ranked.filter(F.col("rank") <= k).select(key, "rank", "doc_id", "score"))
    if not found:
        return queries.sparkSession.createDataFrame([], empty)
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result
