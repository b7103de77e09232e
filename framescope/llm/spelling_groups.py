"""Grouping of spelling variants by one-edit neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols, which turns the vocabulary into a smaller one of reduced words. Of
every distinct reduced word the full one-edit neighbourhood is generated (every deletion, replacement
and insertion of a symbol, and the word itself) and joined with the reduced vocabulary: two words
one edit apart have reduced words at most one edit apart, so no near pair is missed. Candidates are then
verified on the original strings. Neighbours are not spelled out: the polynomial hash of each follows
from the prefix sums of the reduced word's own hash, so a word of L letters costs O(L), however long.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm.common import code_points, slices, whole_text
from framescope.session import materialize

#: Symbols of the reduced alphabet: fewer give more candidates to verify, more give larger neighbourhoods.
SYMBOLS = 6
#: Seed of the letter hash; with it the letters of common Latin-script text fill the symbols evenly.
SEED = 281
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Neighbours in one Arrow batch.
BATCH_ROWS = 400_000
#: Distinct words held before counts are passed on.
HELD_WORDS = 300_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def document_words(docs: DataFrame, typo_every: int = 0, min_length: int = 5) -> DataFrame:
    """(word, n): occurrences of the words of all whole texts, of so many code points at least.

    Words are maximal runs of Latin letters up to U+00FF, A-Z lower-cased and no other letter. With
    ``typo_every`` a run loses a letter where that number divides the crc32 h of "<doc_id>:<run>": the one
    at h modulo its length. Null and empty texts have no words; a null identifier reads as "null".
    Repeated rows count each. Other columns are not read.
    """
    run = re.compile(b"[a-z\xc0-\xff]{%d,}" % min_length)

    def flush(held: Counter) -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in held]
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in slices(batches, "text", 8_000_000):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for doc_id, text in zip(ids, texts, strict=True):
                # Every letter of a run is one byte of Latin-1; all other characters become "?".
                found = Counter(run.findall(text.encode("latin-1", "replace").translate(_LOWER)))
                if not typo_every:
                    held.update(found)
                    continue
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, n in found.items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if h % typo_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_length:
                            continue
                    held[word] += n
            if len(held) > HELD_WORDS:
                yield flush(held)
                held = Counter()
        if held:
            yield flush(held)

    identifier = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc_id")
    counted = docs.select(identifier, whole_text().alias("text")).mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


class Reduced:
    """Words over the reduced alphabet with the hashes of themselves and of their neighbours."""

    def __init__(self, words: list[str], symbols: int = SYMBOLS, already: bool = False):
        codes, self.starts = code_points(words)
        if already:
            self.symbol = codes.astype(np.int64) - 97
        else:
            self.symbol = (mixed(codes.astype(np.uint64) + np.uint64(SEED << 32)) % np.uint64(symbols)).astype(np.int64)
        self.length = np.diff(self.starts)
        self.value = mixed(np.arange(1, symbols + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
        longest = int(self.length.max(initial=0))
        power = np.full(longest + 1, BASE, np.uint64)
        power[0] = 1
        self.power = np.cumprod(power, dtype=np.uint64)
        self.place = np.arange(len(codes)) - np.repeat(self.starts[:-1], self.length)
        self.term = self.value[self.symbol] * self.power[self.place]
        sums = np.append(np.uint64(0), np.cumsum(self.term, dtype=np.uint64))
        self.total = sums[self.starts[1:]] - sums[self.starts[:-1]]
        self.before = sums[:-1] - np.repeat(sums[self.starts[:-1]], self.length)

    def strings(self) -> list[str]:
        text = (self.symbol + 97).astype(np.uint8).tobytes().decode("ascii")
        return [text[a:b] for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)]

    def hashes(self) -> np.ndarray:
        return self._finished(self.total, self.length)

    @staticmethod
    def _finished(total: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mixed(total + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)

    def neighbours(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place of the word, hash) of every distinct string at most one edit away.

        Deleting any symbol of a run of equal ones, or inserting one into it, gives the same string; only
        the first deletion and the insertion behind the run are generated.
        """
        word = np.repeat(np.arange(len(self.length)), self.length)
        total, length = self.total[word], self.length[word]
        yield np.arange(len(self.length)), self.hashes()
        first = np.ones(len(word), bool)
        first[1:] = (self.symbol[1:] != self.symbol[:-1]) | (self.place[1:] == 0)
        shifted = self.before + (total - self.before - self.term) * np.uint64(INVERSE)
        yield word[first], self._finished(shifted[first], length[first] - 1)
        end_power = self.power[self.length] if len(self.length) else self.total
        for symbol, value in enumerate(self.value):
            other = self.symbol != symbol
            at = self.power[self.place[other]]
            replaced = total[other] - self.term[other] + value * at
            yield word[other], self._finished(replaced, length[other])
            inserted = self.before[other] + value * at + (total - self.before)[other] * np.uint64(BASE)
            yield word[other], self._finished(inserted, length[other] + 1)
            yield np.arange(len(self.length)), self._finished(self.total + value * end_power, self.length + 1)


def _chunks(words: list[str], letters: int) -> Iterator[list[str]]:
    held, size = [], 0
    for word in words:
        held.append(word)
        size += len(word)
        if size >= letters:
            yield held
            held, size = [], 0
    if held:
        yield held


def reduce_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """Add the reduced word and its hash to (word, n)."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Reduced(batch.column("word").to_pylist(), symbols)
            columns = [*batch.columns, pa.array(words.strings(), pa.string()), pa.array(words.hashes())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n", "reduced", "code"])

    return vocabulary.mapInArrow(reduce, "word string, n bigint, reduced string, code bigint")


def neighbourhoods(reduced: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(own, code): the hash of each distinct reduced word and of every string in its neighbourhood."""

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in _chunks(batch.column("reduced").to_pylist(), BATCH_ROWS // (2 * symbols)):
                chunk = Reduced(words, symbols, already=True)
                own = chunk.hashes()
                for word, code in chunk.neighbours():
                    for a in range(0, len(word), BATCH_ROWS):
                        part = slice(a, a + BATCH_ROWS)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(own[word[part]]), pa.array(code[part])], ["own", "code"]
                        )

    return reduced.select("reduced").distinct().mapInArrow(generate, "own bigint, code bigint")


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words that are exactly one edit apart.

    ``vocabulary`` is (word, n) with distinct words and is read several times. The neighbourhoods are
    shuffled once, the reduced vocabulary once; reduced words that many words share are split by adaptive
    execution. Nothing is broadcast: Spark sizes neighbourhoods by the words they come from, of which they are
    many times as many, and stored words by their compressed files. Nothing is capped. Two reduced words with
    the same hash only add candidates.
    """
    words = materialize(reduce_words(vocabulary, symbols), "reduced-words")
    others = words.select("code", F.col("word").alias("near"), F.col("n").alias("near_n"))
    reached = neighbourhoods(words, symbols).hint("merge").join(others, "code").select(F.col("own").alias("code"), "near", "near_n")
    candidates = reached.hint("merge").join(words.select("code", "word", "n"), "code")
    return candidates.filter(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def spelling_groups(vocabulary: DataFrame, symbols: int = SYMBOLS, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of (word, n).

    ``form`` is the near word with the largest n, the lowest in code-point order among equals, if that n
    is at least ``factor`` times the word's own; else null. ``root`` follows forms to the last one: n at
    least doubles with each, so a chain is no longer than the logarithm of the largest n, and halving it
    takes a handful of rounds. A word's near words are bounded by its neighbourhood, whatever the size of
    the vocabulary. An empty vocabulary gives no rows.
    """
    pairs = near_words(vocabulary, symbols)
    alone = vocabulary.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("bigint").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near"))).alias("best")
    grouped = (
        alone.unionByName(pairs)
        .groupBy("word")
        .agg(F.max("n").alias("n"), F.size(F.collect_set("near")).cast("bigint").alias("n_near"), best)
    )
    more = -F.col("best.less") >= F.lit(factor) * F.col("n")
    formed = grouped.select(
        "word", "n", "n_near", F.when(more, F.col("best.near")).alias("form"), F.when(more, -F.col("best.less")).alias("form_n")
    )
    return _with_roots(materialize(formed, "forms"))


def _with_roots(formed: DataFrame) -> DataFrame:
    """Follow forms by pointer doubling over the words that have one; joins are shuffled, whatever size Spark sees."""
    steps = materialize(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = materialize(
            steps.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "roots",
        )
        steps = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            break
    return formed.join(steps.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
