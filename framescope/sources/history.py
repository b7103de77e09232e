"""Append tables: stored analyses and the history log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.constants import HISTORY_COLUMNS
from framescope.operators.history import analysis_record, history_row
from framescope.sources.paths import path_exists

_COUNTS = {"loaded_word_count", "ner_entity_count", "word_count"}
_SCORES = {
    "composite_score", "ml_probability", "emotion_intensity", "subjectivity_score",
    "passive_score", "lexicon_score", "opinion_ratio", "quote_ratio", "attribution_ratio",
    "hedge_score",
}
HISTORY_SCHEMA = ", ".join(
    f"`{c}` " + ("bigint" if c in _COUNTS else "double" if c in _SCORES else "string")
    for c in HISTORY_COLUMNS
)


def append_analyses(report: DataFrame, path: str) -> None:
    """Append one row per analysis, in date folders.

    Rows are rebalanced by date first, so a date gets a few files of good size, also where one date
    holds most rows. A bloom filter lets a lookup by ``id`` skip files.
    """
    (
        analysis_record(report)
        .withColumn("created_date", F.to_date("created_at"))
        .hint("rebalance", "created_date")
        .write.option("parquet.bloom.filter.enabled#id", "true")
        .mode("append")
        .partitionBy("created_date")
        .parquet(path)
    )


def read_analyses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_history_log(report: DataFrame, path: str) -> None:
    history_row(report).write.mode("append").parquet(path)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """The log with parsed timestamps; malformed ones become null, a missing log is empty."""
    if path_exists(spark, path):
        log = spark.read.schema(HISTORY_SCHEMA).parquet(path)
    else:
        log = spark.createDataFrame([], HISTORY_SCHEMA)
    return log.withColumn("timestamp", F.expr("try_to_timestamp(timestamp)"))
