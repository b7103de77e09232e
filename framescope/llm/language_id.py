"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are summed by Spark; the log-probability matrix, whose size is buckets times languages, is
broadcast. Scoring takes the rows of the matrix that a text's n-grams hit and sums them per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.llm.common import code_points, draw, draw_limit, slices, whole_text

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Expected number of texts a language is learned from at most.
FIT_TEXTS = 1_500
#: Distinct language values that are learned from at most; more is an error, not a cut.
MAX_LANGUAGES = 500
#: N-grams after which more text does not make a score more certain.
EVIDENCE = 40.0
UNKNOWN = "und"


class LanguageModel(NamedTuple):
    """Languages in order; log probability of each bucket under each of them; log priors."""

    languages: list[str]
    log_probability: np.ndarray
    log_prior: np.ndarray


def _letter_table() -> np.ndarray:
    """For each code point of the first plane its lower-case form if it is a letter, else a space."""
    table = np.full(1 << 16, 32, np.uint32)
    for code in range(1 << 16):
        char = chr(code)
        if char.isalpha():
            lower = char.lower()
            table[code] = ord(lower) if len(lower) == 1 else code
    return table


_LETTERS: list[np.ndarray] = []


def letters(codes: np.ndarray) -> np.ndarray:
    """Lower-case letters, all other characters as spaces; letters beyond the first plane stay."""
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    out = _LETTERS[0][np.minimum(codes, 0xFFFF)]
    for place in np.flatnonzero(codes > 0xFFFF):
        char = chr(codes[place])
        out[place] = codes[place] if char.isalpha() else 32
    return out


def hashed_ngrams(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams that end in a letter, and the text each of them belongs to."""
    codes, starts = code_points([f" {t}" for t in texts])
    codes = letters(codes)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    head = np.zeros(len(codes) + 1, bool)
    head[starts[:-1]] = True
    mixed = codes.astype(np.uint32) * np.uint32(0x9E3779B1)
    ends = np.flatnonzero(codes != 32)
    found, owners = [], []
    rolling = np.zeros(len(ends), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        place = ends - (order - 1)
        inside = place >= starts[owner[ends]] if order > 1 else np.ones(len(ends), bool)
        if order > 2:  # nothing reaches over the gap between two words
            inside &= codes[np.maximum(ends - order + 2, 0)] != 32
        ends, rolling, place = ends[inside], rolling[inside], place[inside]
        rolling = (rolling ^ mixed[place]) * np.uint32(0x85EBCA6B) + np.uint32(order)
        if order in ORDERS:
            found.append(((rolling ^ (rolling >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(17))
            owners.append(owner[ends])
    return np.concatenate(found).astype(np.int64) % buckets, np.concatenate(owners)


def fit_language_model(labelled: DataFrame, fit_texts: int = FIT_TEXTS, buckets: int = BUCKETS) -> LanguageModel:
    """Learn from (doc_id, text, lang) rows whose text and lang are not null.

    ``fit_texts`` bounds the expected number of texts per language: rows are taken by a hash of
    identifier and text, at a rate that follows from the number of rows of the language. Priors come from
    all rows. With no row at all the model has no language, and everything is undetermined.
    """
    usable = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = usable.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    totals = {row["lang"]: row["count"] for row in sorted(sizes, key=lambda r: r["lang"])}
    if not totals:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), np.zeros(0))
    keep = F.lit(False)
    drawn = draw("doc_id", "lang", "text")
    for language, rows in totals.items():
        rate = min(1.0, fit_texts / rows)
        keep = keep | ((F.col("lang") == language) & (drawn < draw_limit(rate)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", 4_000_000):
            names = np.array(batch.column("lang").to_pylist(), object)
            texts = np.array(batch.column("text").to_pylist(), object)
            for name in set(names):
                hit, _ = hashed_ngrams(list(texts[names == name]), buckets)
                sums[name] = sums.get(name, 0) + np.bincount(hit, minlength=buckets)
        for name, counts in sums.items():
            hit = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(hit)), pa.array(hit), pa.array(counts[hit])],
                ["lang", "bucket", "n"],
            )

    sampled = usable.filter(keep).select("lang", "text")
    counted = sampled.mapInArrow(count, "lang string, bucket bigint, n bigint")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = list(totals)
    counts = np.full((buckets, len(languages)), 0.5)
    column = table["lang"].map({name: i for i, name in enumerate(languages)})
    counts[table["bucket"].to_numpy(int), column.to_numpy(int)] += table["n"].to_numpy(float)
    priors = np.array([totals[name] for name in languages], float)
    return LanguageModel(
        languages,
        np.log(counts / counts.sum(axis=0)).astype(np.float32),
        np.log(priors / priors.sum()),
    )


def score_texts(texts: list[str], model: LanguageModel, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Language and probability of each text; undetermined and 0 without a letter."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not texts or not model.languages:
        return names, scores
    hit, owner = hashed_ngrams(texts, buckets)
    n = np.bincount(owner, minlength=len(texts))
    likelihood = np.stack(
        [np.bincount(owner, model.log_probability[hit, k], len(texts)) for k in range(len(model.languages))], 1
    )
    weight = np.minimum(n, EVIDENCE) / np.maximum(n, 1)
    # The language follows from the whole text; only the score is tempered, prior and all.
    logit = likelihood + model.log_prior
    best = logit.argmax(axis=1)
    logit = (logit - logit.max(axis=1, keepdims=True)) * weight[:, None]
    probability = np.exp(logit)
    probability /= probability.sum(axis=1, keepdims=True)
    for i in np.flatnonzero(n):
        names[i], scores[i] = model.languages[best[i]], probability[i, best[i]]
    return names, scores


def identify_languages(docs: DataFrame, model: LanguageModel, held_out: Column) -> DataFrame:
    """Language of every whole text: (doc_id, held_out, lang_pred, score).

    Reads the text and nothing else for a prediction. A null or empty text, or one without any
    letter, is ``und`` with score 0; equal probabilities go to the first language by name. Repeated
    rows give repeated results; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            names, scores = score_texts(batch.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), held_out.alias("held_out"), whole_text().alias("text"))
    return rows.mapInArrow(score, "doc_id bigint, held_out boolean, lang_pred string, score double")
