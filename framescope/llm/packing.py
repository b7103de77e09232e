"""Packing of tokenized documents into sequences by Karmarkar-Karp multiway differencing.

A document is cut into full sequences and a rest, the rest into pieces that are short against a
sequence. Pieces are dealt evenly, by a hash, to groups of a bounded size. A group is one differencing
problem: every piece starts as a partial partition into k windows with one window filled; the two
partitions with the largest imbalance are merged, the fullest window of one with the emptiest of the
other, until one is left. Its windows are nearly equal. If one exceeds the capacity, k rises.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from array import array
from bisect import insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framescope.llm.common import slices, whole_text
from framescope.session import materialize

CAPACITY = 2048
END_ID = 1
#: Longest piece of a document's rest.
PIECE = 256
#: Mean number of pieces of a group.
GROUP_PIECES = 2000
# The blanks of Unicode, in runs that are split by hand.
LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{500,}")
# The splitting step of the vocabularies that the fast path is for.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


class TextIds:
    """Ids of texts as little-endian 32-bit numbers, as ``tokenizers`` gives them for a file.

    Merging is done by ``tiktoken`` with ranks taken from that same file: the same ids in less than
    half of the time. That holds for a byte-level vocabulary whose ids follow the order of its
    merges, which is checked; any other file, and any text with a special string, goes to the library.
    """

    def __init__(self, tokenizer_file: str):
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._ranked()

    def _ranked(self) -> tiktoken.Encoding | None:
        state = json.loads(self.tokenizer.to_str())
        vocabulary, merges = state["model"]["vocab"], state["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        ordered = all(vocabulary[a + b] == 256 + i for i, (a, b) in enumerate(pairs))
        if state["normalizer"] is not None or state["pre_tokenizer"] != BYTE_LEVEL or not ordered:
            return None
        byte_of = {char: value for value, char in enumerate(byte_chars())}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in self.special}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def document(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        ids, start = array("I"), 0
        # The splitting step would need a stack as deep as a run of blanks is long. Of such a run all but
        # the last blank are one piece, at the end of a text the last one too.
        for run in LONG_BLANKS.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids.extend(self.fast.encode_ordinary(text[start : run.start()]))
            ids.extend(self.fast._encode_single_piece(text[run.start() : end]))
            start = end
        ids.extend(self.fast.encode_ordinary(text[start:]))
        return ids.tobytes()


def byte_chars() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in visible]
    shown = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [shown[b] for b in range(256)]


@lru_cache(maxsize=2)
def text_ids(tokenizer_file: str) -> TextIds:
    return TextIds(tokenizer_file)


def cuts(tokens: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full sequences, then short pieces of the rest.

    All but the last are equally long; the last has any length, which lets windows come out even.
    """
    rest = tokens - tokens % capacity
    starts = [*range(0, rest, capacity), *range(rest, tokens, piece)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], tokens], strict=True)]


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp differencing of items into so many windows; items by their place.

    A partition is the ascending list of (sum, number, items) of its filled windows; empty windows
    are not stored. Ties are broken by the order in which partitions arose.
    """
    heap = [(-length, i, [(length, i, [i])]) for i, length in enumerate(lengths)]
    if windows == 1 or not heap:
        return [list(range(len(lengths)))]
    heapq.heapify(heap)
    number = len(lengths)
    while len(heap) > 1:
        _, _, first = heapq.heappop(heap)
        _, _, second = heapq.heappop(heap)
        if len(first) < len(second):
            first, second = second, first
        joined = len(first) + len(second) - windows
        if joined <= 0:
            for window in second:
                insort(first, window)
            merged = first
        else:
            # The emptiest windows of one take the fullest of the other; what is left meets empty ones.
            pairs = zip(first[:joined], reversed(second[-joined:]), strict=True)
            merged = [(a[0] + b[0], a[1], a[2] + b[2]) for a, b in pairs]
            merged = sorted(merged + first[joined:] + second[:-joined])
        spread = merged[-1][0] - (merged[0][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, number, merged))
        number += 1
    return [items for _, _, items in heap[0][2]]


def pack_group(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of near-equal sums, none above the capacity, in as few tries as it takes."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        packed = difference(lengths, windows)
        most = max(sum(lengths[i] for i in items) for items in packed)
        if most <= capacity:
            return packed
        windows += 1


def document_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of every whole text: (doc_id, row, start, length, ids_crc32, doc_tokens, full).

    The ids are the tokenizer's, then id 1, so a null or empty text has one id. ``row`` tells rows
    apart that repeat an identifier; ``full`` numbers the pieces that fill a sequence and is null for others.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = text_ids(tokenizer_file)
        end = np.array([END_ID], "<u4").tobytes()
        context = TaskContext.get()
        filled = (context.partitionId() if context else 0) << 34
        for batch in slices(batches, "text", 4_000_000):
            row, start, length, crc, total, full = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = tokenizer.document(text) + end
                tokens = len(ids) // 4
                for a, n in cuts(tokens, capacity):
                    row.append(i)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * a : 4 * (a + n)]))
                    total.append(tokens)
                    full.append(filled if n == capacity else None)
                    filled += n == capacity
            rows = pa.array(row, pa.int64())
            numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total, full)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("row").take(rows), *numbers],
                ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", "full"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.monotonically_increasing_id().alias("row"), whole_text().alias("text"))
    schema = "doc_id bigint, row bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, full bigint"
    return rows.mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces of all documents with their places: document_pieces and (sequence_id, offset).

    Every id of every row is in exactly one piece; a sequence's pieces lie in it without a gap from
    0. ``sequence_id`` is unique, not gapless. Null texts are empty, null identifiers stay null, rows
    that repeat an identifier are packed each on their own; other columns are not read. Texts are
    tokenized once; what is shuffled is a few numbers a piece, and only of pieces shorter than a sequence:
    full ones get a sequence of their own where they are (odd numbers; groups have even ones). A document or
    source of any size is dealt to all groups.
    """
    pieces = materialize(document_pieces(docs, tokenizer_file, capacity), "pieces")
    names = ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"]
    alone = pieces.filter("full IS NOT NULL").select(
        *names, (F.col("full") * 2 + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    short = pieces.filter("full IS NULL").drop("full")
    groups = max(1, round(short.count() / group_pieces))
    dealt = short.withColumn("_group", F.pmod(F.xxhash64("doc_id", "row", "start"), F.lit(groups)))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "row", "start"], ascending=[False, True, True, True], ignore_index=True)
        lengths = frame["length"].tolist()
        packed = pack_group(lengths, capacity)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for number, items in enumerate(packed):
            at = 0
            for i in items:
                sequence[i], offset[i] = number, at
                at += lengths[i]
        frame["sequence_id"] = ((frame["_group"].to_numpy(np.int64) << 28) + sequence) * 2
        frame["offset"] = offset
        return frame.drop(columns="_group")

    schema = ", ".join(f"{c} bigint" for c in (*names, "sequence_id", "offset"))
    return alone.unionByName(dealt.groupBy("_group").applyInPandas(place, schema))
