"""From fetched pages to stored analyses: extraction, report, entities and outlet ratings in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.functions.binding import settle
from framescope.operators.composite import article_report, engine_scores
from framescope.operators.entities import gazetteer_summary
from framescope.operators.linear_model import LinearTextModel
from framescope.operators.ratings import domain_lookup
from framescope.operators.shaping import extract_fallback

RATING_FIELDS = ["leaning", "factual", "country"]


#: What extraction adds to a page.
_EXTRACTED = ["headline", "body_paras", "body_text", "word_count", "success", "error", "engine", "domain"]


def accepted_pages(extracted: DataFrame) -> DataFrame:
    """Extracted pages that have an article. The filter reads the settled extraction and does not extract again."""
    return settle(extracted, *[c for c in extracted.columns if c in _EXTRACTED]).filter("success")


def rejected_pages(extracted: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, error) of the pages without an article."""
    return extracted.filter("NOT success").select(key, "url", "error")


def analyze_pages(
    pages: DataFrame,
    model: LinearTextModel | None,
    gazetteer: DataFrame,
    ratings: DataFrame,
    analysed_at: Column,
    key: str = "page_id",
) -> DataFrame:
    """One analysis per page with an article, ready for ``append_analyses``.

    The pages are scanned twice, for the report and for the entities. Only short rows are shuffled:
    scores of sections and mentions. ``domain_info`` holds the ratings of the outlet as JSON, null for
    an unknown one.
    """
    articles = accepted_pages(extract_fallback(pages)).select(
        key,
        "url",
        "domain",
        "headline",
        "body_paras",
        "body_text",
        F.col("engine").alias("scrape_engine"),
        F.md5(F.concat_ws("|", F.col(key).cast("string"), "url")).alias("id"),
        analysed_at.alias("created_at"),
    )
    carry = ["url", "domain", "scrape_engine", "id", "created_at"]
    report = engine_scores(article_report(articles, model, key, carry))
    entities = gazetteer_summary(articles, gazetteer, "body_text", key).select(
        key,
        F.col("total_unique").alias("ner_entity_count"),
        "negatively_framed_entities",
        F.col("summary").alias("ner_summary"),
    )
    info = F.to_json(F.struct(*RATING_FIELDS))
    rated = domain_lookup(
        report.join(entities, key, "left"), ratings.select("domain", *RATING_FIELDS, F.lit(True).alias("rated"))
    )
    return rated.withColumn("domain_info", F.when(F.col("rated"), info)).drop(
        "rating_domain", "rated", *RATING_FIELDS
    )
