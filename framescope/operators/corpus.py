"""Labelled corpora: cleaning, merging, deduplication, splits and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framescope.functions.labels import leaning_to_label
from framescope.functions.text import is_blank, strip, word_count
from framescope.operators.ranking import hash_rank


def clean_dataset(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop null or blank texts, keep labels 0 and 1 as integers."""
    label = F.expr("try_cast(label as double)")
    return df.filter(F.col("text").isNotNull() & ~is_blank("text") & label.isin(0.0, 1.0)).select(
        *keep, "text", label.cast("int").alias("label")
    )


def map_leaning_labels(
    df: DataFrame, leaning: str, source: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Binary labels from leaning names; unknown leanings are dropped, the source is tagged."""
    return (
        df.filter(F.col("text").isNotNull() & F.col(leaning).isNotNull())
        .withColumn("label", leaning_to_label(F.col(leaning)))
        .filter(F.col("label") != -1)
        .select(*keep, "text", "label", F.lit(source).alias("source"))
    )


def length_filter(df: DataFrame, low: int = 5, high: int | None = 500) -> DataFrame:
    """Keep texts of ``low`` to ``high`` words, both inclusive; no upper end when null."""
    words = word_count("text")
    return df.filter(words >= low if high is None else words.between(low, high))


def merge_corpora(frames: Sequence[DataFrame]) -> DataFrame:
    """Union all, in order of priority, with stripped texts."""
    merged = None
    for priority, frame in enumerate(frames):
        tagged = frame.withColumn("priority", F.lit(priority)).withColumn("text", strip("text"))
        merged = tagged if merged is None else merged.unionByName(tagged)
    return merged


def dedup_text(merged: DataFrame, key: str = "row_id") -> DataFrame:
    """Case-insensitive distinct texts; the row first in (priority, key) order survives.

    One aggregation over digests that keeps the first row itself: the sources are read once, copies
    are reduced before the shuffle, and one row survives even where keys repeat.
    """
    digest = F.sha2(F.lower("text"), 256)
    row = F.struct(*[F.col(c) for c in merged.columns])
    first = F.min_by(row, F.struct("priority", key)).alias("first")
    return merged.groupBy(digest.alias("digest")).agg(first).select("first.*")


def build_corpus(frames: Sequence[DataFrame], key: str = "row_id", low: int = 5) -> DataFrame:
    """Merge, keep texts of at least ``low`` words, remove repeated texts."""
    return dedup_text(length_filter(merge_corpora(frames), low, None), key)


def corpus_summary(corpus: DataFrame) -> DataFrame:
    """Rows in total, per label and per source, in one pass over the data."""
    counted = corpus.groupBy("label", "source").agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.groupingSets([[], ["label"], ["source"]], "label", "source")
        .agg(F.sum("n").alias("row_count"), F.grouping_id().alias("level"))
        .select(
            F.when(F.col("level") == 3, "total")
            .when(F.col("level") == 1, "label")
            .otherwise("source")
            .alias("dimension"),
            F.coalesce(F.col("label").cast("string"), F.col("source"), F.lit("all")).alias("value"),
            "row_count",
        )
    )


def stratified_split(
    df: DataFrame, label: str = "label", key: str = "doc_id", test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split`` (train or test), keeping the class ratio exactly."""
    test = F.col("hash_rank") <= F.floor(F.col("label_count") * test_share + 0.5)
    return (
        hash_rank(df, label, key, seed)
        .withColumn("split", F.when(test, "test").otherwise("train"))
        .drop("hash_rank", "label_count")
    )


def stratified_folds(
    df: DataFrame, label: str = "label", key: str = "doc_id", folds: int = 5, seed: int = 42
) -> DataFrame:
    """Add ``fold``: per class, folds differ in size by at most one row."""
    return (
        hash_rank(df, label, key, seed)
        .withColumn("fold", F.pmod(F.col("hash_rank") - 1, F.lit(folds)).cast("int"))
        .drop("hash_rank", "label_count")
    )


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("class_count"))
    classes = Window.partitionBy(F.lit(1))  # one row per class
    rows, k = F.sum("class_count").over(classes), F.count(F.lit(1)).over(classes)
    return counts.withColumn("weight", rows.cast("double") / (k.cast("double") * F.col("class_count")))


def with_class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Attach the balanced weight; one short row per class is broadcast."""
    weights = class_weights(df, label).select(label, "weight")
    return df.join(F.broadcast(weights), label)
