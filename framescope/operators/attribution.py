"""Quoted, attributed and opinion sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope import constants as C
from framescope.functions.binding import where_equal
from framescope.functions.labels import opinion_label
from framescope.functions.numeric import ratio
from framescope.functions.text import is_blank, raw_words, split_sentences

CLASSES = ["quoted", "attributed", "opinion"]


def sentence_class(sentence: Column) -> Column:
    """Quotation marks win over attribution, everything else is opinion."""
    lowered = F.lower(sentence)
    verbs = F.array(*[F.lit(v) for v in C.ATTRIBUTION_VERBS])
    attributed = F.arrays_overlap(raw_words(sentence), verbs)
    for phrase in C.ATTRIBUTION_PHRASES:
        attributed = attributed | lowered.contains(phrase)
    return (
        F.when(sentence.rlike('["“”]'), F.lit("quoted"))
        .when(attributed, F.lit("attributed"))
        .otherwise(F.lit("opinion"))
    )


def classify_sentences(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``classified``: an array of (sentence_idx, sentence, sentence_class)."""
    rows = F.transform(
        split_sentences(text),
        lambda s, i: F.struct(
            i.cast("bigint").alias("sentence_idx"),
            s.alias("sentence"),
            sentence_class(s).alias("sentence_class"),
        ),
    )
    return df.withColumn("classified", rows)


def _of_class(name: str) -> Column:
    return where_equal("classified", "sentence_class", name)


def opinion_ratios(classified: DataFrame, text: str = "text") -> DataFrame:
    """Add sentence counts per class, their ratios and the opinion label."""
    out = classified.withColumn("total_sentences", F.size("classified").cast("bigint"))
    for name in CLASSES:
        out = out.withColumn(f"{name}_sentences", F.size(_of_class(name)).cast("bigint"))
    for name, column in (
        ("opinion", "opinion_ratio"),
        ("quoted", "quote_ratio"),
        ("attributed", "attribution_ratio"),
    ):
        out = out.withColumn(
            column, ratio(F.col(f"{name}_sentences"), F.col("total_sentences"))
        )
    return out.withColumn("opinion_label", opinion_label(F.col("opinion_ratio"), is_blank(text)))


def opinion_examples(
    classified: DataFrame, key: str = "doc_id", k: int = 3, width: int = 200
) -> DataFrame:
    """First ``k`` sentences per class in text order, cut to ``width`` characters."""
    picked = F.flatten(
        F.array(
            *[
                F.transform(
                    F.slice(_of_class(name), 1, k),
                    lambda s, i: F.struct(
                        s["sentence_class"].alias("sentence_class"),
                        (i + 1).cast("bigint").alias("position"),
                        F.substring(s["sentence"], 1, width).alias("example"),
                    ),
                )
                for name in CLASSES
            ]
        )
    )
    rows = classified.select(key, F.inline_outer(picked))
    return rows.filter("sentence_class IS NOT NULL")
