"""Labelled corpora: CSV in and out, column discovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.constants import LABEL_COLUMN_NAMES, TEXT_COLUMN_NAMES
from framescope.functions.text import strip, word_count
from framescope.sources.csv_split import csv_records
from framescope.sources.paths import path_exists

CORPUS_SCHEMA = "doc_id bigint, text string, label string, source string"


def write_corpus(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; quotes are doubled and line breaks stay inside quoted fields."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_corpus_csv(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA) -> DataFrame:
    """Rows of CSV files as :func:`write_corpus` writes them; large files are read by many tasks (``csv_records``)."""
    options = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    records = csv_records(spark, path).filter("NOT header")
    return records.select(F.from_csv("record", F.lit(schema), options).alias("r")).select("r.*")


def read_labeled_corpus(
    spark: SparkSession,
    preferred: str,
    fallback: str | None = None,
    min_words: int | None = None,
    schema: str = CORPUS_SCHEMA,
) -> DataFrame:
    """Texts with integer labels from the preferred path, else from the fallback.

    Rows with a null text or label are dropped. With ``min_words`` texts are stripped and short ones
    are dropped too.
    """
    path = preferred if fallback is None or path_exists(spark, preferred) else fallback
    label = F.expr("cast(try_cast(label as double) as int)").alias("label")
    raw = read_corpus_csv(spark, path, schema)
    kept = raw.dropna(subset=["text", "label"])
    kept = kept.select(*[label if c == "label" else F.col(c) for c in kept.columns])
    if min_words is not None:
        kept = kept.withColumn("text", strip("text")).filter(word_count("text") >= min_words)
    return kept


def find_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First candidate that matches a column name, ignoring case."""
    by_name = {c.lower(): c for c in columns}
    return next((by_name[c.lower()] for c in candidates if c.lower() in by_name), None)


def discover_columns(
    df: DataFrame,
    text_names: Sequence[str] = TEXT_COLUMN_NAMES,
    label_names: Sequence[str] = LABEL_COLUMN_NAMES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rename the discovered text and label columns to ``text`` and ``raw_label``."""
    text = find_column(df.columns, text_names)
    label = find_column(df.columns, label_names)
    if text is None or label is None:
        raise ValueError(f"no text or label column among {df.columns}")
    return df.select(*keep, F.col(text).alias("text"), F.col(label).alias("raw_label"))
