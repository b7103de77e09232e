"""Corpus exploration: distributions, correlations and class vocabulary."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescope.constants import STOP_WORDS
from framescope.functions.numeric import ratio, round_to
from framescope.functions.text import raw_words, split_fragments, word_count
from framescope.operators.quantiles import exact_quantiles
from framescope.operators.tfidf import word_ngrams
from framescope.session import materialize


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and percentage per class; the window runs over the aggregated classes only."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("percent", share)


def with_lengths(df: DataFrame, text: str = "text") -> DataFrame:
    """Add characters, words, sentences and mean word length of a text."""
    letters = F.aggregate(
        raw_words(text), F.lit(0), lambda acc, w: acc + F.length(w)
    )
    return (
        df.withColumn("chars", F.length(text).cast("bigint"))
        .withColumn("words", word_count(text).cast("bigint"))
        .withColumn("sentences", F.size(split_fragments(text)).cast("bigint"))
        .withColumn("avg_word_length", ratio(letters, F.col("words")))
    )


QUARTILES = (0.25, 0.5, 0.75)


def text_length_stats(lengths: DataFrame, label: str = "label", exact: bool = True) -> DataFrame:
    """Means per class and word-count quartiles.

    ``exact=False`` takes the quartiles from a mergeable sketch in the pass that gives the means; exact ones
    cost a few passes over stored lengths (see ``quantiles``).
    """
    names = [f"words_{n}" for n in ("q1", "median", "q3")]
    means = [
        F.avg("chars").alias("mean_chars"),
        F.avg("words").alias("mean_words"),
        round_to(F.avg("avg_word_length"), 6).alias("mean_word_length"),
        F.avg("sentences").alias("mean_sentences"),
    ]
    if not exact:
        sketched = [F.percentile_approx("words", p).cast("double").alias(n) for p, n in zip(QUARTILES, names, strict=True)]
        return lengths.groupBy(label).agg(*means, *sketched)
    stored = materialize(lengths.select(label, "chars", "words", "avg_word_length", "sentences"), "lengths")
    quartiles = exact_quantiles(stored, [label], "words", QUARTILES).toDF("_label", *names)
    # One row per class on both sides.
    same = F.col(label).eqNullSafe(F.col("_label"))
    return stored.groupBy(label).agg(*means).join(F.broadcast(quartiles), same).drop("_label")


def feature_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, computed in one aggregation."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("feature_a"),
                F.lit(b).alias("feature_b"),
                round_to(F.col(f"`{a}|{b}`"), 6).alias("correlation"),
            )
            for a, b in pairs
        ]
    )
    return row.select(F.inline(cells))


def feature_label_correlation(
    df: DataFrame, columns: Sequence[str], label: str = "label"
) -> DataFrame:
    row = df.agg(*[F.corr(c, F.col(label).cast("double")).alias(c) for c in columns])
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), round_to(F.col(c), 6).alias("correlation"))
            for c in columns
        ]
    )
    return row.select(F.inline(cells))


def feature_distribution(
    df: DataFrame,
    columns: Sequence[str],
    label: str = "label",
    low: float = 0.0,
    high: float = 1.0,
    bins: int = 10,
) -> DataFrame:
    """Histogram counts per class, feature and bin; values outside go to the end bins."""
    width = (high - low) / bins

    def bin_of(name: str) -> Column:
        raw = F.floor((F.col(name) - F.lit(low)) / F.lit(width))
        return F.greatest(F.lit(0), F.least(raw, F.lit(bins - 1))).cast("bigint")

    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), bin_of(c).alias("bin")) for c in columns]
    )
    return (
        df.select(label, F.inline(cells))
        .groupBy(label, "feature", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def feature_quantiles(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """Exact quartiles per class and feature, of the values as they are; features are computed once and stored."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    stored = materialize(df.select(label, F.inline(cells)), "features")
    quartiles = exact_quantiles(stored, [label, "feature"], "value", QUARTILES)
    return quartiles.toDF(label, "feature", "q1", "median", "q3")


def _top_terms(counts: DataFrame, label: str, k: int) -> DataFrame:
    """Counts arrive aggregated; Spark's window group limit cuts each partition to k first."""
    order = Window.partitionBy(label).orderBy(F.desc("n"), "term")
    return (
        counts.withColumn("position", F.row_number().over(order).cast("bigint"))
        .filter(F.col("position") <= k)
    )


def term_totals(
    df: DataFrame, text: str = "text", label: str = "label", low: int = 1, high: int = 1
) -> DataFrame:
    """(class, term, n); partial aggregation runs before the shuffle."""
    return (
        word_ngrams(df.select(label, text), text, low, high)
        .select(label, F.explode_outer("ngrams").alias("term"))
        .filter("term IS NOT NULL")
        .groupBy(label, "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_unigrams(
    df: DataFrame,
    text: str = "text",
    label: str = "label",
    k: int = 20,
    stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """Most frequent words per class that are not stop words."""
    spark = df.sparkSession
    stops = spark.createDataFrame([(w,) for w in stop_words], "term string")
    counts = term_totals(df, text, label).join(F.broadcast(stops), "term", "left_anti")
    return _top_terms(counts, label, k)


def top_ngrams(
    df: DataFrame, n: int, text: str = "text", label: str = "label", k: int = 20
) -> DataFrame:
    """Most frequent n-word terms per class."""
    return _top_terms(term_totals(df, text, label, n, n), label, k)


def exclusive_vocabulary(
    df: DataFrame,
    text: str = "text",
    label: str = "label",
    share: float = 0.9,
    min_count: int = 5,
) -> DataFrame:
    """Words of which at least ``share`` of the occurrences fall in one class."""
    totals = (
        term_totals(df, text, label)
        .groupBy("term")
        .agg(
            F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)).alias("biased"),
            F.sum(F.when(F.col(label) != 1, F.col("n")).otherwise(0)).alias("neutral"),
        )
        .withColumn("total", F.col("biased") + F.col("neutral"))
    )
    top = F.greatest("biased", "neutral") / F.col("total")
    return (
        totals.withColumn("class_share", top)
        .filter((F.col("total") >= min_count) & (F.col("class_share") >= share))
        .withColumn("main_class", F.when(F.col("biased") > F.col("neutral"), 1).otherwise(0))
    )


def polarity_subjectivity_grid(
    df: DataFrame, label: str = "label", cells: int = 10
) -> DataFrame:
    """Counts per class over a polarity x subjectivity grid."""

    def cell(value: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.floor(value * cells), F.lit(cells - 1))).cast("bigint")

    return (
        df.groupBy(
            label,
            cell((F.col("polarity") + 1.0) / 2.0).alias("polarity_bin"),
            cell(F.col("subjectivity")).alias("subjectivity_bin"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
