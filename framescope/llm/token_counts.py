"""Token counts by a compiled finite-state transducer.

A byte-pair vocabulary is turned into a deterministic transducer over characters. After each prefix
of a text, the last token of the prefix's own tokenization is unique, and it follows from the last
tokens of the few shorter prefixes at which a longer piece may still have begun. Those, with their
distance in tokens, are the state; a transition carries by how much the token count changes. Summed
over a text the changes are the number of tokens, exactly. Transitions are compiled when first
taken and kept in a bounded table.

A text is cut into chunks. Where two characters meet that no piece holds side by side, no merge can
cross, so the state there does not depend on what came before. A chunk's state map is therefore its
head up to the first such place, run from whatever state comes in, and a constant end state with
the tokens of the rest. Maps are associative and are composed by a prefix scan. Words, which a
vocabulary of this kind never joins to the word before, are such chunks too: what the transducer
emits over a word is kept in a bounded table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm.common import slices, whole_text

CHUNK_CHARS = 16_384
MAX_STATES = 120_000
MAX_WORDS = 400_000
SPACE = "▁"
WORDS = re.compile(f"^[^{SPACE}]+|{SPACE}+[^{SPACE}]*")


class State(dict):
    """Transitions taken so far: character -> (next state, change of the token count)."""

    __slots__ = ("machine", "entries", "last")

    def __init__(self, machine: TokenMachine, entries: tuple, last: str):
        super().__init__()
        self.machine, self.entries, self.last = machine, entries, last

    def __missing__(self, char: str) -> tuple[State, int]:
        step = self[char] = self.machine.compile_step(self, char)
        return step


class WordTokens(dict):
    """What the machine emits from its start state over a word."""

    def __init__(self, machine: TokenMachine):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        tokens = self[word] = self.machine.run(self.machine.start, word)[1]
        return tokens


class StateMap(NamedTuple):
    """What a chunk does to any incoming state: run ``head``; then, if known, end in ``end``."""

    head: str
    end: State | None
    tokens: int


class TokenMachine:
    """The transducer of one vocabulary: piece -> rank, lower ranks merge first."""

    def __init__(self, ranks: dict[str, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.pairs = {p[i : i + 2] for p in ranks for i in range(len(p) - 1)}
        self.chars = {c for p in ranks for c in p}
        self.child: dict[tuple[int, str], int] = {}
        self.piece: list[str | None] = [None]
        for piece in [*ranks, *self.chars]:
            node = 0
            for char in piece:
                node = self.child.setdefault((node, char), len(self.piece))
                if node == len(self.piece):
                    self.piece.append(None)
            self.piece[node] = piece
        self.grows = {node for node, _ in self.child}
        self.fitting: dict[tuple[str | None, str], bool] = {}
        self.states: dict[tuple, State] = {}
        self.start = State(self, ((0, None, 0),), "")
        self.words = WordTokens(self)
        self.joins_words = any(p[1] == SPACE and p[0] != SPACE for p in self.pairs)

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging of a short text: best rank first, leftmost among equals."""
        parts = list(text)
        while True:
            found = [
                (rank, i)
                for i in range(len(parts) - 1)
                if (rank := self.ranks.get(parts[i] + parts[i + 1])) is not None
            ]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fits(self, last: str | None, piece: str) -> bool:
        """Whether ``piece`` may follow the token ``last`` (None: nothing that could merge)."""
        known = self.fitting.get((last, piece))
        if known is None:
            if len(self.fitting) > 8 * self.max_states:
                self.fitting.clear()
            expected = [piece] if last is None else [last, piece]
            known = self.fitting[last, piece] = self.merge((last or "") + piece) == expected
        return known

    def tokens_of(self, piece: str) -> int:
        """One; a character outside the vocabulary falls back to its bytes."""
        return 1 if piece in self.ranks else len(piece.encode())

    def compile_step(self, state: State, char: str) -> tuple[State, int]:
        if char not in self.chars:
            return self.start, len(char.encode())
        entries = state.entries if state.last + char in self.pairs else self.start.entries
        moved, token, distance = [], None, 0
        for node, last, tokens in entries:
            child = self.child.get((node, char))
            if child is None:
                continue
            piece = self.piece[child]
            if token is None and piece is not None and self.fits(last, piece):
                token, distance = piece, tokens
            if child in self.grows:
                moved.append((child, last, tokens))
        change = self.tokens_of(token) - distance
        after = ((0, token, 0), *[(node, last, n + change) for node, last, n in moved])
        found = self.states.get(after)
        if found is None:
            if len(self.states) >= self.max_states:
                self.states.clear()
                self.start.clear()
            found = self.states[after] = State(self, after, char)
        return found, change

    def run(self, state: State, text: str) -> tuple[State, int]:
        tokens = 0
        for char in text:
            state, change = state[char]
            tokens += change
        return state, tokens

    def run_fresh(self, text: str) -> tuple[State, int]:
        """From the start state; all words but the last by the table of words."""
        if self.joins_words:
            return self.run(self.start, text)
        *words, last = WORDS.findall(text) or [""]
        state, tokens = self.run(self.start, last)
        return state, tokens + sum(map(self.words.__getitem__, words))

    def chunk_map(self, text: str) -> StateMap:
        """The state map of a chunk."""
        pairs = self.pairs
        cut = next((i for i in range(1, len(text)) if text[i - 1 : i + 1] not in pairs), None)
        if cut is None:
            return StateMap(text, None, 0)
        return StateMap(text[:cut], *self.run_fresh(text[cut:]))

    def compose(self, first: StateMap, second: StateMap) -> StateMap:
        """First one map, then the other."""
        if first.end is None:
            return StateMap(first.head + second.head, second.end, second.tokens)
        state, tokens = self.run(first.end, second.head)
        if second.end is None:
            return StateMap(first.head, state, first.tokens + tokens)
        return StateMap(first.head, second.end, first.tokens + tokens + second.tokens)

    def scan(self, maps: list[StateMap]) -> list[StateMap]:
        """Prefix scan: pairs are composed, scanned, and the places between filled in."""
        if len(maps) < 2:
            return maps
        halves = self.scan([self.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)])
        out = [maps[0]]
        for i in range(1, len(maps)):
            half = halves[(i - 1) // 2]
            out.append(half if i % 2 else self.compose(half, maps[i]))
        return out

    def count(self, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
        """Tokens of the text: the maps of its chunks composed pair by pair, the first half of the scan.

        A head is carried along until it is run once, so texts without any cut cost as much as others.
        """
        if len(text) <= chunk_chars:
            return self.run_fresh(text)[1]
        maps = [self.chunk_map(text[i : i + chunk_chars]) for i in range(0, len(text), chunk_chars)]
        while len(maps) > 1:
            pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
            maps = [*pairs, *maps[len(pairs) * 2 :]]
        return self.run_fresh(maps[0].head)[1] + maps[0].tokens

    def prefix_counts(self, text: str, chunk_chars: int = CHUNK_CHARS) -> list[int]:
        """Tokens of the text up to the end of each chunk, by a prefix scan; the last is the count of the text."""
        if len(text) <= chunk_chars:
            return [self.run_fresh(text)[1]]
        cuts = range(0, len(text), chunk_chars)
        maps = self.scan([self.chunk_map(text[i : i + chunk_chars]) for i in cuts])
        return [self.run_fresh(m.head)[1] + m.tokens for m in maps]


@lru_cache(maxsize=2)
def piece_machine(model_file: str) -> TokenMachine:
    """The machine of a sentencepiece BPE model that keeps its input as it is."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    ids = [i for i in range(model.get_piece_size()) if not any(f(i) for f in special)]
    ranked = sorted(ids, key=model.get_score, reverse=True)
    return TokenMachine({model.id_to_piece(i): rank for rank, i in enumerate(ranked)})


def piece_text(text: str) -> str:
    """The characters the model sees: a space in front, spaces as the visible mark."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Tokens of every whole text: (doc_id, n_bytes, n_tokens, over_limit).

    A narrow pass without shuffle. Null and empty texts have no bytes and no tokens. Texts of any
    length are counted whole, chunk by chunk. One row per row: repeated rows and null identifiers
    are kept; other columns are not read, whatever their names.
    """
    machine_file, width = model_file, chunk_chars

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        machine = piece_machine(machine_file)
        for batch in slices(batches, "text", 8_000_000):
            texts = batch.column("text").to_pylist()
            counts = [machine.count(piece_text(t), width) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(
        F.col("doc_id").cast("bigint"),
        whole_text().alias("text"),
        F.octet_length(whole_text()).cast("bigint").alias("n_bytes"),
    )
    counted = rows.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
