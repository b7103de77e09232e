"""Counts of hashed word n-grams, and exact counts of the n-grams in chosen buckets.

Tokens come as arrays of the row; n-grams are built as numbers, batch by batch, so only the terms that are
asked for become strings and only sums leave a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.functions.binding import settle

BITS = 22
BUCKETS = 1 << BITS
#: Buckets that travel in one row.
BLOCK = 1 << 13
#: Tokens that are worked on at once, whatever the size of a batch.
SLICE_TOKENS = 2_000_000


def runs_of_rows(column: pa.ListArray, tokens: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of at most so many tokens, or of one row; an empty batch is one run."""
    offsets, start = column.offsets.to_numpy(), 0
    while True:
        end = int(np.searchsorted(offsets, offsets[start] + tokens, "right")) - 1
        end = min(max(end, start + 1), len(column))
        yield start, end - start
        start = end
        if start >= len(column):
            return


def _slices(column: pa.ListArray) -> Iterator[pa.ListArray]:
    """The rows of a batch in runs of at most ``SLICE_TOKENS`` tokens."""
    return (column.slice(start, rows) for start, rows in runs_of_rows(column, SLICE_TOKENS))


def _tokens_of(column: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the word of every token and the row of every token."""
    encoded = column.flatten().dictionary_encode()
    rows = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    return encoded.dictionary, encoded.indices.to_numpy().astype(np.int64), rows


def _gram_buckets(
    words: pa.Array, codes: np.ndarray, rows: np.ndarray, low: int, high: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order: n, the first tokens of its n-grams, and their buckets."""
    hashed = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)[codes] if len(codes) else np.zeros(0, np.uint64)
    state = np.zeros(len(codes), np.uint64)
    for n in range(1, high + 1):
        length = max(len(codes) - n + 1, 0)
        state = (state[:length] ^ hashed[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        state ^= state >> np.uint64(29)
        if n >= low:
            places = np.flatnonzero(rows[:length] == rows[n - 1 :])
            mixed = state[places] * np.uint64(0xBF58476D1CE4E5B9)
            yield n, places, (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def term_sketch(tokens: DataFrame, low: int, high: int) -> tuple[int, np.ndarray]:
    """Number of rows, and the occurrences of all n-grams by bucket of their hash.

    ``tokens`` has one column of word arrays. The sums have a fixed size, whatever the corpus; they come to the
    driver compressed and are kept in half the space where they fit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = 0, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            rows += batch.num_rows
            for column in _slices(batch.column(0)):
                for _, _, buckets in _gram_buckets(*_tokens_of(column), low, high):
                    sums += np.bincount(buckets, minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"block": pa.array([-1], pa.int32()), "sums": [np.array([rows], np.int64).tobytes()]})
        for block, part in enumerate(sums.reshape(-1, BLOCK)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "sums": [part.tobytes()]})

    def total(parts: pa.Table) -> pa.Table:
        added = sum(np.frombuffer(part.as_py(), np.int64) for part in parts.column("sums"))
        return pa.table({"block": parts.column("block").slice(0, 1), "sums": [zlib.compress(added.tobytes(), 1)]})

    schema = "block int, sums binary"
    rows, sums = 0, np.zeros((BUCKETS // BLOCK, BLOCK), np.uint32)
    for block, packed in tokens.mapInArrow(run, schema).groupBy("block").applyInArrow(total, schema).collect():
        part = np.frombuffer(zlib.decompress(packed), np.int64)
        if block < 0:
            rows = int(part[0])
        else:
            if part.max() > np.iinfo(sums.dtype).max:
                sums = sums.astype(np.int64)
            sums[block] = part
    return rows, sums.reshape(-1)


def threshold_at(sums: np.ndarray, rank: int) -> int:
    """The sum at a rank, from the highest; 0 beyond the last bucket."""
    return int(np.partition(sums, -rank)[-rank]) if rank < len(sums) else 0


def count_terms_in(tokens: DataFrame, wanted: np.ndarray, low: int, high: int) -> DataFrame:
    """(term, df, total) of all n-grams whose bucket is ``wanted``."""
    shared = tokens.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = np.unpackbits(shared.value).astype(bool)
        for column in (c for batch in batches for c in _slices(batch.column(0))):
            words, codes, rows = _tokens_of(column)
            for n, places, buckets in _gram_buckets(words, codes, rows, low, high):
                places = places[inside[buckets]]
                if not len(places):
                    continue
                # Words are added one by one; ranks keep the numbers small at every length.
                keys = codes[places]
                for k in range(1, n):
                    keys = np.unique(keys, return_inverse=True)[1] * len(words) + codes[places + k]
                order = np.argsort(keys, kind="stable")
                keys, places = keys[order], places[order]
                new_term = np.concatenate([[True], keys[1:] != keys[:-1]])
                new_row = new_term | np.concatenate([[True], rows[places[1:]] != rows[places[:-1]]])
                starts = np.flatnonzero(new_term)
                first = places[starts]
                terms = [words.take(pa.array(codes[first + k])) for k in range(n)]
                yield pa.RecordBatch.from_pydict({
                    "term": pc.binary_join_element_wise(*terms, " ") if n > 1 else terms[0],
                    "df": np.add.reduceat(new_row.astype(np.int64), starts),
                    "total": np.diff(np.append(starts, len(keys))),
                })

    found = tokens.mapInArrow(run, "term string, df bigint, total bigint")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def term_tree(terms: Sequence[str], high: int) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """The words of a vocabulary, and for each length the sorted beginnings of terms with their place.

    A beginning is the place of the one that is a word shorter, times the number of words, plus its last word; a
    place is that of the term in the vocabulary, or -1 where only longer terms begin so.
    """
    split = [(term.split(" "), place) for place, term in enumerate(terms)]
    words = sorted({word for parts, _ in split for word in parts})
    codes = {word: code for code, word in enumerate(words)}
    before: dict[tuple[int, ...], int] = {(): 0}
    levels = []
    for n in range(1, high + 1):
        starts = {tuple(codes[w] for w in parts[:n]) for parts, _ in split if len(parts) >= n}
        ordered = sorted((before[start[:-1]] * len(words) + start[-1], start) for start in starts)
        before = {start: node for node, (_, start) in enumerate(ordered)}
        places = np.full(len(ordered), -1, np.int64)
        for parts, place in split:
            if len(parts) == n:
                places[before[tuple(codes[w] for w in parts)]] = place
        levels.append((np.array([key for key, _ in ordered], np.int64), places))
    return words, levels


def known_counts(
    column: pa.ListArray, vocabulary: pa.Array, levels: list[tuple[np.ndarray, np.ndarray]], size: int, low: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in a vocabulary of ``size`` terms and number of every known term of word arrays, in this order."""
    words, codes, rows = _tokens_of(column)
    word = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
    places, nodes, hits = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
    for n, (keys, ids) in enumerate(levels, 1):
        inside = places + (n - 1) < len(codes)
        places, nodes = places[inside], nodes[inside]
        last = word[places + (n - 1)]
        same = (last >= 0) & (rows[places] == rows[places + (n - 1)])
        places, wanted = places[same], nodes[same] * len(vocabulary) + last[same]
        nodes = np.searchsorted(keys, wanted)
        found = nodes < len(keys)
        found[found] = keys[nodes[found]] == wanted[found]
        places, nodes = places[found], nodes[found]
        if n >= low:
            term = ids[nodes] >= 0
            hits.append(rows[places[term]] * size + ids[nodes[term]])
    found, n_found = np.unique(np.concatenate(hits), return_counts=True)
    return found // size, found % size, n_found


def count_known_terms(
    df: DataFrame, tokens: Column, terms: Sequence[str], low: int, high: int, output: str
) -> DataFrame:
    """Add the terms of a vocabulary in each row's word array: (value, n), by place in the vocabulary.

    A null array counts as empty. Words are compared as words, so the counts are exact.
    """
    known, levels = term_tree(terms, high)
    shared = df.sparkSession.sparkContext.broadcast((pa.array(known, pa.string()), levels))
    size = max(len(terms), 1)

    def counts(column: pa.ListArray, vocabulary: pa.Array, levels: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
        rows, places, n_found = known_counts(column, vocabulary, levels, size, low)
        ends = np.cumsum(np.bincount(rows, minlength=len(column)))
        counted = pa.StructArray.from_arrays(
            [pa.array(places, pa.int32()), pa.array(n_found, pa.int32())], names=["value", "n"]
        )
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), counted)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary, levels = shared.value
        for column in columns:
            yield pa.concat_arrays([counts(part, vocabulary, levels) for part in _slices(column)])

    pair = T.StructType([T.StructField("value", T.IntegerType()), T.StructField("n", T.IntegerType())])
    # Only the words travel to Python: the other columns of a row, its text above all, wait for the counts.
    counted = F.arrow_udf(run, T.ArrayType(pair))
    # A null array would leave its offsets undefined.
    words = F.coalesce(tokens, F.array().cast("array<string>"))
    # Settled, as a filter on the counts would otherwise count once more.
    return settle(df.withColumn(output, counted(words)), output)
