"""Quality classifier learned from positive and unlabelled texts.

Trusted positives, unlabelled web text and an estimated share of positives give an unbiased estimate
of the classification risk. Its part for the negatives can fall below zero when a flexible model
overfits; the non-negative form (Kiryo et al., 2017) takes a step back whenever it does.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.llm.common import draw, draw_limit, code_points, slices, whole_text

#: Expected number of rows of each kind that are learned from at most.
FIT_ROWS = 6_000
#: Kinds of characters: other letters, then these.
KINDS = ("lower", "upper", "digit", "space", "line", "stop", "bang", "bar", "symbol", "quote", "other")
THRESHOLD = 0.3


class QualityModel(NamedTuple):
    """A network with one hidden layer on standardised features, and its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    bias: float
    slope: float
    shift: float


def _kind_table() -> np.ndarray:
    table = np.full(1 << 16, KINDS.index("other"), np.uint8)
    for code in range(1 << 16):
        char = chr(code)
        if char.isalpha():
            table[code] = KINDS.index("upper" if char.isupper() else "lower")
        elif char.isdigit():
            table[code] = KINDS.index("digit")
        elif char in "\r\n":
            table[code] = KINDS.index("line")
        elif char.isspace():
            table[code] = KINDS.index("space")
    for kind, chars in (("stop", ".,;:?"), ("bang", "!"), ("bar", "|"), ("symbol", "*#$%&@^~_=+<>{}[]\\/"), ("quote", "\"'()-")):
        for char in chars:
            table[ord(char)] = KINDS.index(kind)
    return table


_TABLE: list[np.ndarray] = []


def features(texts: list[str]) -> np.ndarray:
    """One row per text: shares of neighbouring character kinds, and what words and lines repeat."""
    if not _TABLE:
        _TABLE.append(_kind_table())
    k = len(KINDS)
    codes, starts = code_points([f" {t}" for t in texts])
    kinds = _TABLE[0][np.minimum(codes, 0xFFFF)].astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    same = owner[1:] == owner[:-1]
    cell = (owner[1:] * k * k + kinds[:-1] * k + kinds[1:])[same]
    pairs = np.bincount(cell, minlength=len(texts) * k * k).reshape(len(texts), k * k)
    size = np.maximum(np.diff(starts) - 1, 1)[:, None]
    words = np.zeros((len(texts), 5))
    for i, text in enumerate(texts):
        all_words, lines = text.split(), text.split("\n")
        n = max(len(all_words), 1)
        distinct = len(set(all_words))
        stays = sum(map(str.__eq__, all_words, all_words[1:]))
        words[i] = (np.log1p(n), distinct / n, np.log(n + 1) - np.log(distinct + 1), len(set(lines)) / len(lines), stays / n)
    return np.hstack([np.sqrt(pairs / size), words]).astype(np.float32)


def _logit(model: QualityModel, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    return np.tanh(z @ model.hidden + model.hidden_bias) @ model.out + model.bias


def predict(model: QualityModel, x: np.ndarray) -> np.ndarray:
    """Calibrated probability of the positive label."""
    return 1 / (1 + np.exp(-np.clip(model.slope * _logit(model, x) + model.shift, -30, 30)))


def fit_nn_pu(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 60, width: int = 12, seed: int = 11
) -> QualityModel:
    """Minimise the non-negative risk with the sigmoid loss, by Adam on mini-batches."""
    rng = np.random.default_rng(seed)
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 0.05  # rare kinds must not loom large
    decay = 1e-4 * (1 + 5000 / len(both))  # more of it on few rows
    xp, xu = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    w = {
        "hidden": rng.normal(0, 1 / np.sqrt(xp.shape[1]), (xp.shape[1], width)),
        "hidden_bias": np.zeros(width),
        "out": rng.normal(0, 1 / np.sqrt(width), width),
        "bias": np.zeros(1),
    }
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    batches = max(1, min(60, len(xu) // 64))
    for _ in range(epochs):
        p_order = np.array_split(np.resize(rng.permutation(len(xp)), max(len(xp), batches)), batches)
        u_order = np.array_split(np.resize(rng.permutation(len(xu)), max(len(xu), batches)), batches)
        for p, u in zip(p_order, u_order, strict=True):
            x = np.vstack([xp[p], xu[u]])
            act = np.tanh(x @ w["hidden"] + w["hidden_bias"])
            g = act @ w["out"] + w["bias"][0]
            s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))  # loss of a negative; 1 - s that of a positive
            slope = s * (1 - s)
            n = len(p)
            negative_risk = s[n:].mean() - prior * s[:n].mean()
            d = np.zeros_like(g)
            if negative_risk >= 0:
                d[:n] = (-prior - prior) * slope[:n] / n
                d[n:] = slope[n:] / len(u)
            else:  # step back on the part below zero
                d[:n] = prior * slope[:n] / n
                d[n:] = -slope[n:] / len(u)
            back = np.outer(d, w["out"]) * (1 - act**2)
            grad = {
                "hidden": x.T @ back + decay * w["hidden"],
                "hidden_bias": back.sum(axis=0),
                "out": act.T @ d + decay * w["out"],
                "bias": np.array([d.sum()]),
            }
            step += 1
            for k, v in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v**2
                w[k] -= 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return QualityModel(mean, scale, w["hidden"], w["hidden_bias"], w["out"], float(w["bias"][0]), 1.0, 0.0)


def calibrate(model: QualityModel, x: np.ndarray, label: np.ndarray) -> QualityModel:
    """Slope and shift of a logistic curve over the raw output, by Newton steps."""
    g = _logit(model, x)
    slope, shift = 1.0, 0.0
    target = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * g + shift, -30, 30)))
        weight, gap = p * (1 - p) + 1e-6, target - p
        a, b, c = (weight * g * g).sum() + 1e-3, (weight * g).sum(), weight.sum() + 1e-3
        u, v = (gap * g).sum(), gap.sum()
        det = a * c - b * b
        slope, shift = slope + np.clip((c * u - b * v) / det, -2, 2), shift + np.clip((a * v - b * u) / det, -2, 2)
    return model._replace(slope=max(float(slope), 1e-3), shift=float(shift))


def _feature_rows(rows: DataFrame, keep: list[str], schema: str) -> DataFrame:
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            x = features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(list(x), pa.list_(pa.float32()))], [*keep, "x"]
            )

    return rows.mapInArrow(compute, schema)


def fit_quality(docs: DataFrame, labels: DataFrame, may_learn: Column, fit_rows: int = FIT_ROWS) -> QualityModel | None:
    """Learn from the rows of ``docs`` that ``may_learn`` admits and their labels (doc_id, quality).

    Trusted positives are rows labelled 1; unlabelled text is all rows without a label; the share of
    positives is estimated from the labels. The output is calibrated on the labelled rows. At most
    about ``fit_rows`` rows of each kind are taken, by a hash of the identifier. A document with
    several labels counts as its lowest. None if there is no positive or nothing else to learn from.
    """
    label = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    kind = F.coalesce(F.col("quality").cast("int"), F.lit(-1)).alias("kind")
    known = docs.filter(may_learn).select("doc_id").join(label, "doc_id", "left").select("doc_id", kind)
    # Sizes and the sample of identifiers need no text; a sample has about fit_rows rows of a kind.
    sizes = {r["kind"]: r["count"] for r in known.groupBy("kind").count().collect()}
    keep = F.lit(False)
    for value, rows in sizes.items():
        rate = min(1.0, fit_rows / rows)
        keep = keep | ((F.col("kind") == value) & (draw("doc_id") < draw_limit(rate)))
    chosen = known.filter(keep & F.col("doc_id").isNotNull()).distinct()
    sample = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id").select("kind", "text")
    table = _feature_rows(sample, ["kind"], "kind int, x array<float>").toPandas()
    if not len(table):
        return None
    x, y = np.stack(table["x"].to_numpy()).astype(float), table["kind"].to_numpy()
    order = np.lexsort((*x.T[:8], y))  # the order of rows from Spark may differ from run to run
    x, y = x[order], y[order]
    if not (y == 1).any() or (y == 1).all():
        return None
    labelled = sizes.get(1, 0) + sizes.get(0, 0)
    prior = min(0.98, max(0.02, sizes.get(1, 0) / labelled))
    unlabelled = x[y == -1] if (y == -1).any() else x
    return calibrate(fit_nn_pu(x[y == 1], unlabelled, prior), x[y >= 0], y[y >= 0])


def score_quality(docs: DataFrame, model: QualityModel | None, carry: list[str]) -> DataFrame:
    """The ``carry`` columns, ``score`` and ``predicted`` (score >= 0.3) of every whole text.

    Null and empty texts are scored like any text, with all shares at zero. Without a model every
    score is 1. Repeated rows give repeated results; no other column is read.
    """
    rows = docs.select(*carry, whole_text().alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            texts = batch.column("text").to_pylist()
            p = predict(shared.value, features(texts)) if shared.value is not None else np.ones(len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(p)], [*carry, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema) + ", score double"
    return rows.mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def good_documents(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text the model does not reject.

    Null and empty texts are judged like any text; rows that repeat another, or have no identifier, are
    judged each on its own. Without a model every row stays; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            if shared.value is not None:
                texts = [t or "" for t in batch.column("text").to_pylist()]
                batch = batch.filter(pa.array(predict(shared.value, features(texts)) >= THRESHOLD))
            yield batch

    return docs.mapInArrow(keep, docs.schema)
