"""Articles from document and page tables, in one schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.operators.shaping import extract_fallback, shape_text_articles
from framescope.session import spread

ARTICLE_COLUMNS = [
    "article_id", "url", "domain", "headline", "body_paras", "body_text", "word_count", "success",
    "error", "engine",
]


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id")


def articles_from_documents(documents: DataFrame) -> DataFrame:
    shaped = shape_text_articles(documents)
    return shaped.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("article_id"),
        "headline", "body_paras", "body_text", "word_count",
        F.lit(True).alias("success"), F.lit("").alias("error"), "engine",
    )


def articles_from_pages(pages: DataFrame) -> DataFrame:
    return extract_fallback(pages).withColumn(
        "article_id", F.concat(F.lit("page-"), F.col("page_id").cast("string"))
    ).drop("page_id")


def read_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as one article table; documents have no url."""
    from_documents = articles_from_documents(read_documents(spark, sf_dir))
    from_pages = articles_from_pages(read_pages(spark, sf_dir))
    return from_documents.unionByName(from_pages, allowMissingColumns=True).select(ARTICLE_COLUMNS)
