"""Secret detection: fixed patterns, and a character convolutional network over all candidates.

A candidate is any run of 16 or more characters that keys are written with. The network sees it in
overlapping windows over its whole length, each with the characters around it. It is trained on labelled findings:
candidates that a pattern proves and random keys of six alphabets put where candidates of the texts are,
against candidates that no pattern proves and that do not look like a key. That is done on the driver, from a
bounded number of findings of all texts. The output is calibrated on all findings kept aside, and the threshold is
the highest at which the stated shares of proven findings and of drawn keys are still found.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice, takewhile
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm.common import slices, whole_text

# The patterns of the definition, with the least length of what they find.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ("assign", "access", "hex", "net")

LEAST = 16
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
#: A piece of a long run between its separators.
PIECE = re.compile(r"[A-Za-z0-9+]{16,}")
WORDS = ("password", "passwd", "secret", "token", "api")
#: Findings of each label that the network learns from at most.
FIT_FINDINGS = 1_500
#: One finding in so many is kept aside, and its output is rounded to one part in so many.
ASIDE = 4
STEPS = 100
#: Keys drawn at random for each alphabet, half to learn from and half to set the threshold by.
DRAWN = 1200
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base64": "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/",
}
LEAST_FINDINGS = 20
RECALL = 0.95
#: Share of the drawn keys of each alphabet that must pass, so that the shortest ones do too.
DRAWN_RECALL = 0.97
BEFORE, INSIDE, AFTER = 16, 40, 8
#: Where letters, capitals and digits change within a word, but for an initial capital.
TURN = re.compile(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[0-9])")
#: Distance of the windows of a run that is longer than one window.
STRIDE = 20
WIDTH, ALPHABET, EMBED, FILTERS = 5, 98, 6, 12


class Span(NamedTuple):
    kind: str
    start: int
    end: int


class SecretModel(NamedTuple):
    """Weights of the network, its calibration, its threshold on the calibrated output, and the share
    of findings kept aside that pass, by kinds: as they stand and with their surroundings blanked."""

    weights: dict[str, np.ndarray]
    slope: float
    shift: float
    threshold: float
    recall: dict[str, tuple[float, float]] = {}


def base_spans(text: str, candidates: list[tuple[int, int]]) -> list[Span]:
    """What the patterns find, by start and kind."""
    found = []
    low = text.lower()
    if any(word in low for word in WORDS):
        found += [Span("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    # Both other patterns only match inside a candidate run.
    for start, end in candidates:
        for kind, pattern, least in (("access", ACCESS, ACCESS_LEAST), ("hex", HEX, HEX_LEAST)):
            for m in pattern.finditer(text, start, end):
                if m.end() - m.start() >= least:
                    found.append(Span(kind, m.start(), m.end()))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def candidate_runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def run_windows(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Windows of at most ``INSIDE`` characters that cover a run: itself if it is short, else one
    every ``STRIDE`` characters, and one at every long piece between separators."""
    if end - start <= INSIDE:
        return [(start, end)]
    windows = {(a, a + INSIDE) for a in (*range(start, end - INSIDE, STRIDE), end - INSIDE)}
    windows |= {(m.start(), min(m.end(), m.start() + INSIDE)) for m in PIECE.finditer(text, start, end)}
    return sorted(windows)


def proven_parts(base: list[Span]) -> list[tuple[int, int, frozenset[str]]]:
    """Spans merged where they overlap, with their kinds, in ascending order; ``base`` is sorted by start."""
    merged: list[tuple[int, int, frozenset[str]]] = []
    for kind, start, end in base:
        if merged and start < merged[-1][1]:
            first, last, kinds = merged[-1]
            merged[-1] = (first, max(end, last), kinds | {kind})
        else:
            merged.append((start, end, frozenset({kind})))
    return merged


def like_a_key(window: str) -> bool:
    """Whether letters, capitals and digits take turns as in a key; what no pattern proves may be one."""
    return len(TURN.findall(window)) >= max(3, len(window) / 8)


def open_parts(runs: list[tuple[int, int]], base: list[Span]) -> Iterator[tuple[int, int]]:
    """Parts of the runs that no pattern's span covers, if they are as long as a candidate."""
    proven = proven_parts(base)
    ends = [b for _, b, _ in proven]
    for start, end in runs:
        for a, b, _ in islice(proven, bisect_right(ends, start), None):
            if a >= end:
                break
            if a - start >= LEAST:
                yield start, a
            start = max(start, b)
        if end - start >= LEAST:
            yield start, end


def encode(text: str, start: int, end: int, run: tuple[int, int] | None = None) -> np.ndarray:
    """Codes of the characters around a window and of the window; 0 is padding.

    What surrounds a window in its own run is blank, so that a window inside a run looks like a run.
    """
    first, last = run or (start, end)
    head = (text[max(0, start - BEFORE) : start] if start == first else " " * BEFORE).rjust(BEFORE, "\0")
    body = text[start : min(end, start + INSIDE)].ljust(INSIDE, "\0")
    tail = (text[end : end + AFTER] if end == last else " " * AFTER).ljust(AFTER, "\0")
    codes = np.frombuffer((head + body + tail).encode("utf-32-le"), np.uint32)
    return np.where(codes == 0, 0, np.where((codes >= 32) & (codes < 127), codes - 31, ALPHABET - 1)).astype(np.int64)


def _forward(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    e = w["embed"][x] + w["place"]
    n, length, _ = e.shape
    steps = length - WIDTH + 1
    cols = np.concatenate([e[:, i : i + steps] for i in range(WIDTH)], axis=2)
    conv = np.maximum(cols @ w["conv"] + w["conv_bias"], 0)
    top, mean = conv.argmax(axis=1), conv.mean(axis=1)
    peak = np.take_along_axis(conv, top[:, None], 1)[:, 0]
    pooled = np.concatenate([peak, mean], axis=1)
    return pooled @ w["out"] + w["bias"][0], {"cols": cols, "conv": conv, "top": top, "pooled": pooled}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, d: np.ndarray, kept: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Gradients given that of the output."""
    conv, cols = kept["conv"], kept["cols"]
    n, steps, filters = conv.shape
    d_pooled = np.outer(d, w["out"])
    d_conv = np.repeat(d_pooled[:, None, filters:] / steps, steps, axis=1)
    rows, maps = np.ogrid[:n, :filters]
    d_conv[rows, kept["top"], maps] += d_pooled[:, :filters]
    d_conv *= conv > 0
    flat = d_conv.reshape(-1, filters)
    d_cols = (flat @ w["conv"].T).reshape(n, steps, WIDTH, EMBED)
    d_e = np.zeros((n, x.shape[1], EMBED))
    for i in range(WIDTH):
        d_e[:, i : i + steps] += d_cols[:, :, i]
    d_embed = np.zeros_like(w["embed"])
    np.add.at(d_embed, x, d_e)
    return {
        "embed": d_embed,
        "place": d_e.sum(axis=0),
        "conv": cols.reshape(-1, WIDTH * EMBED).T @ flat,
        "conv_bias": flat.sum(axis=0),
        "out": kept["pooled"].T @ d,
        "bias": np.array([d.sum()]),
    }


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 12, seed: int = 5) -> dict[str, np.ndarray]:
    """Weighted logistic loss by Adam. Half of the time a row's surroundings are blanked, so that the
    network learns what a key looks like and not only the words that the patterns ask for."""
    rng = np.random.default_rng(seed)
    w = {
        "embed": rng.normal(0, 0.5, (ALPHABET, EMBED)),
        "place": np.zeros((x.shape[1], EMBED)),
        "conv": rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)),
        "conv_bias": np.zeros(FILTERS),
        "out": rng.normal(0, 0.3, 2 * FILTERS),
        "bias": np.zeros(1),
    }
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            batch = x[rows].copy()
            blank = rng.random(len(rows)) < 0.5
            batch[blank] = blanked(batch[blank])
            logit, kept = _forward(w, batch)
            d = share[rows] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) / len(rows)
            step += 1
            for k, g in _gradients(w, batch, d, kept).items():
                g = g + 1e-4 * w[k]
                m, v = moments[k]
                m[:] = 0.9 * m + 0.1 * g
                v[:] = 0.999 * v + 0.001 * g * g
                w[k] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def network_output(weights: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.concatenate([_forward(weights, part)[0] for part in np.array_split(x, max(1, len(x) // 2048))])


def chance(model: SecretModel, raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * raw + model.shift, -30, 30)))


def probability(model: SecretModel, x: np.ndarray) -> np.ndarray:
    return chance(model, network_output(model.weights, x))


def blanked(x: np.ndarray) -> np.ndarray:
    """Windows without their surroundings."""
    out = x.copy()
    out[:, :BEFORE] = out[:, BEFORE + INSIDE :] = ord(" ") - 31
    return out


def drawn_keys(around: np.ndarray, chars: str, n: int, rng: np.random.Generator) -> np.ndarray:
    """Windows of random keys of an alphabet, of every length a window holds, short ones more often, in given surroundings."""
    out = around[rng.integers(0, len(around), n)].astype(np.int64)
    codes = np.array([ord(c) - 31 for c in chars])
    body = codes[rng.integers(0, len(codes), (n, INSIDE))]
    lengths = LEAST + ((INSIDE + 1 - LEAST) * rng.random(n) ** 2.5).astype(int)
    body[np.arange(INSIDE)[None] >= lengths[:, None]] = 0
    out[:, BEFORE : BEFORE + INSIDE] = body
    return out


def calibrated(
    weights: dict[str, np.ndarray], raw: np.ndarray, kinds: np.ndarray, bare: np.ndarray, n: np.ndarray, recall: float = RECALL
) -> SecretModel:
    """Calibration and threshold from outputs ``raw`` of the network, each of ``n`` findings.

    ``kinds`` names the patterns that prove a finding, "" if none does; ``bare`` tells the outputs with
    blanked surroundings from those of findings as they stand. The threshold is the highest that keeps
    ``recall`` of the proven findings in either form, as a key that no pattern finds has no telling words,
    and of the drawn keys of each alphabet (kinds "drawn ...").
    """
    drawn = np.char.startswith(kinds.astype(str), "drawn")
    y = kinds != ""
    proven, total = n[y].sum(), n.sum()
    target = np.where(y, (proven + 1) / (proven + 2), 1 / (total - proven + 2))
    middle = (raw * n).sum() / total
    scale = max(1e-6, float(np.sqrt(((raw - middle) ** 2 * n).sum() / total)))
    z, slope, shift = (raw - middle) / scale, 1.0, 0.0
    for _ in range(2000):  # a plain descent: two numbers only
        gap = (1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30))) - target) * n / total
        slope, shift = max(0.05, slope - (gap * z).sum()), shift - gap.sum()
    least = []
    groups = [y & ~drawn & (bare == form) for form in (False, True)]
    groups += [(kinds == k) for k in sorted(set(kinds[drawn]))]
    for group in groups:
        mine = np.flatnonzero(group)
        mine = mine[np.argsort(raw[mine])]
        missed = 1 - (DRAWN_RECALL if drawn[group].all() else recall)
        place = np.searchsorted(np.cumsum(n[mine]), int(missed * n[mine].sum()), "right")
        least.append(raw[mine][place])
    model = SecretModel(weights, slope / scale, shift - slope * middle / scale, 0.0)
    model = model._replace(threshold=float(chance(model, np.array([min(least)]))[0]))
    passed = chance(model, raw) >= model.threshold
    share = lambda rows: float((n * passed)[rows].sum() / n[rows].sum())
    return model._replace(recall={str(k): tuple(share((kinds == k) & (bare == form)) for form in (False, True)) for k in sorted(set(kinds[y & ~drawn]))})


def fit_from_findings(x: np.ndarray, y: np.ndarray, aside: np.ndarray, recall: float = RECALL) -> SecretModel | None:
    """Train on some findings; calibrate and set the threshold on those kept ``aside``.

    With fewer than ``LEAST_FINDINGS`` findings of either label on either side there is no model.
    """
    if any(((y == label) & (aside == side)).sum() < LEAST_FINDINGS for label in (0, 1) for side in (False, True)):
        return None
    weights = fit_network(x[~aside], y[~aside])
    raw = network_output(weights, np.concatenate([x[aside], blanked(x[aside])]))
    kinds, bare = np.where(np.tile(y[aside], 2) == 1, "proven", ""), np.repeat([False, True], aside.sum())
    return calibrated(weights, raw, kinds, bare, np.ones(len(raw)), recall)


def labelled_windows(text: str) -> Iterator[tuple[np.ndarray, str]]:
    """Codes of the windows of every candidate of a text, and the kinds of pattern that prove them.

    A window is proven if patterns prove half of it or all of a key lies in it, and a negative ("") if
    they prove nothing of it. Without a label, and left out, are windows that show a smaller part of a
    key, and those that no pattern proves but that look like a key.
    """
    runs = candidate_runs(text)
    proven = proven_parts(base_spans(text, runs)) if runs else []
    ends = [b for _, b, _ in proven]
    for run in runs:
        for start, end in run_windows(text, *run):
            first = bisect_right(ends, start)
            inside = list(takewhile(lambda part: part[0] < end, islice(proven, first, None)))
            seen = sum(min(b, end) - max(a, start) for a, b, _ in inside)
            if not seen and not like_a_key(text[start:end]):
                yield encode(text, start, end, run).astype(np.int8), ""
            elif seen and (2 * seen >= end - start or any(start <= a and b <= end for a, b, _ in inside)):
                yield encode(text, start, end, run).astype(np.int8), "+".join(sorted(set().union(*(k for _, _, k in inside))))


def fit_secret_model(docs: DataFrame, fit_findings: int = FIT_FINDINGS) -> SecretModel | None:
    """Labelled findings of all texts. Equal ones count once; a quarter, by hash, is kept aside.

    The network learns from the ``fit_findings`` lowest hashes of each label among the others. Its
    calibration and threshold come from all findings kept aside, as counts of rounded outputs.
    """
    texts = docs.select(whole_text().alias("text"))

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lowest hashes of each label of a task, which hold the lowest ones of all tasks."""
        held: tuple[dict[int, np.ndarray], dict[int, np.ndarray]] = ({}, {})
        for batch in slices(batches, "text", 4_000_000):
            for text in batch.column("text").to_pylist():
                for codes, kinds in labelled_windows(text):
                    draw, y = hash_window(codes), int(kinds != "")
                    if draw % ASIDE:
                        held[y][draw] = codes
                        if len(held[y]) > 4 * fit_findings:
                            for extra in sorted(held[y])[fit_findings:]:
                                del held[y][extra]
        for y in (0, 1):
            draws = sorted(held[y])[:fit_findings]
            yield pa.RecordBatch.from_arrays(
                [pa.array([held[y][d] for d in draws], pa.list_(pa.int8())), pa.array([y] * len(draws), pa.int32()), pa.array(draws, pa.int64())],
                ["x", "y", "draw"],
            )

    found = texts.mapInArrow(lowest, "x array<tinyint>, y int, draw bigint").dropDuplicates(["draw", "y"])
    parts = [found.filter(F.col("y") == k).orderBy("draw").limit(fit_findings).toPandas() for k in (0, 1)]
    if any(len(p) < LEAST_FINDINGS for p in parts):
        return None
    x = np.concatenate([np.stack(p["x"].to_numpy()) for p in parts]).astype(np.int64)
    y = np.concatenate([p["y"].to_numpy() for p in parts])
    # Keys that no pattern proves: drawn from every alphabet, where candidates of the texts were.
    rng = np.random.default_rng(DRAWN)
    keys = {name: drawn_keys(x, chars, DRAWN, rng) for name, chars in ALPHABETS.items()}
    half = DRAWN // 2
    learned = np.concatenate([x, *(k[:half] for k in keys.values())])
    weights = fit_network(learned, np.concatenate([y, np.ones(half * len(keys), y.dtype)]))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rounded outputs of the findings kept aside; rounded down, so that a threshold keeps them."""
        for batch in slices(batches, "text", 4_000_000):
            rows = {}
            for text in batch.column("text").to_pylist():
                for codes, kinds in labelled_windows(text):
                    draw = hash_window(codes)
                    if draw % ASIDE == 0:
                        rows[draw, kinds] = codes
            if rows:
                draws, kinds = (pa.array(column) for column in zip(*rows, strict=True))
                windows = np.stack(list(rows.values()))
                for bare, form in enumerate((windows, blanked(windows))):
                    step = np.floor(network_output(shared.value, form) * STEPS).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [draws, kinds, pa.array([bool(bare)] * len(step)), pa.array(step)], ["draw", "kinds", "bare", "step"]
                    )

    kept = texts.mapInArrow(outputs, "draw bigint, kinds string, bare boolean, step bigint")
    kept = kept.dropDuplicates(["draw", "kinds", "bare"])
    counts = kept.groupBy("kinds", "bare", "step").count().orderBy("kinds", "bare", "step").toPandas()
    kinds, n = counts["kinds"].to_numpy(str), counts["count"].to_numpy(float)
    bare = counts["bare"].to_numpy(bool)
    if any(n[((kinds != "") == label) & ~bare].sum() < LEAST_FINDINGS for label in (False, True)):
        return None
    drawn = {f"drawn {name}": np.floor(network_output(weights, k[half:]) * STEPS) / STEPS for name, k in keys.items()}
    raw = np.concatenate([counts["step"].to_numpy(float) / STEPS, *drawn.values()])
    kinds = np.concatenate([kinds, np.repeat(list(drawn), [len(v) for v in drawn.values()])])
    more = len(raw) - len(n)
    return calibrated(weights, raw, kinds, np.append(bare, np.ones(more, bool)), np.append(n, np.ones(more)))


def hash_window(codes: np.ndarray) -> int:
    """A number that depends on the characters alone."""
    return int.from_bytes(hashlib.blake2b(codes.astype(np.int8).tobytes(), digest_size=7).digest(), "big")


def scan_texts(texts: list[str], model: SecretModel | None) -> list[list[Span]]:
    """All spans of each text, by start and kind: the patterns' ones, and what the network adds.

    The network sees the parts of candidates that no pattern's span covers, over their whole length:
    a short part is added as a whole, of a long one the windows that pass, merged where they meet.
    """
    spans, x, places = [], [], []

    def score() -> None:
        if x:
            for p, (i, part, start, end) in zip(probability(model, np.stack(x)), places, strict=True):
                if p < model.threshold:
                    continue
                last = spans[i][-1] if spans[i] else None
                if last and last.kind == "net" and part <= last.start and start <= last.end:
                    spans[i][-1] = Span("net", last.start, max(end, last.end))
                else:
                    spans[i].append(Span("net", start, end))
        x.clear()
        places.clear()

    for i, text in enumerate(texts):
        runs = candidate_runs(text)
        spans.append(base_spans(text, runs))
        if model is None:
            continue
        for part in open_parts(runs, list(spans[i])):
            for start, end in run_windows(text, *part):
                x.append(encode(text, start, end, part).astype(np.int8))
                places.append((i, part[0], start, end))
                if len(x) == 4096:  # a run of any length is scored in bounded memory
                    score()
    score()
    return [sorted(s, key=lambda s: (s.start, KINDS.index(s.kind))) for s in spans]


def find_secrets(docs: DataFrame, model: SecretModel | None) -> DataFrame:
    """Spans of every whole text: (doc_id, spans array<struct<kind, start, end>>), in code points.

    Null and empty texts have no spans. Without a model (too few findings) only the patterns speak.
    Repeated rows give repeated results; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4_000_000):
            found = scan_texts(batch.column("text").to_pylist(), shared.value)
            rows = pa.array([[s._asdict() for s in f] for f in found], pa.list_(span))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("bigint"), whole_text().alias("text"))
    return rows.mapInArrow(scan, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")
