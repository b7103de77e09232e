"""Analysis history: rows, pages, lookups and rollups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope import constants as C
from framescope.functions.numeric import round_to
from framescope.functions.urls import infer_source

ANALYSIS_COLUMNS = [
    "id", "url", "domain", "headline", "body_preview", "composite_score", "verdict",
    "ml_probability", "ml_label", "engine_scores", "scrape_engine", "word_count", "created_at",
    "analysis_version", "domain_info",
]


def analysis_record(report: DataFrame) -> DataFrame:
    """Columns of the stored analysis; long texts are cut to their stored width.

    ``domain_info`` is null where a report has none.
    """
    info = F.col("domain_info") if "domain_info" in report.columns else F.lit(None).cast("string")
    return report.select(
        "id", "url", "domain",
        F.substring("headline", 1, 2000).alias("headline"),
        F.substring("body_preview", 1, 1000).alias("body_preview"),
        "composite_score", "verdict", "ml_probability", "ml_label", "engine_scores",
        "scrape_engine", "word_count", "created_at",
        F.lit(C.ANALYSIS_VERSION).alias("analysis_version"),
        info.alias("domain_info"),
    )


def history_row(report: DataFrame) -> DataFrame:
    """Flatten a report to the 23 columns of the history log.

    Expects the report columns plus ``url``, ``source_label``, ``created_at``, ``word_count``,
    ``top_loaded_words``, ``ner_entity_count`` and ``negatively_framed_entities``.
    """
    breakdown = F.to_json(
        F.struct(
            F.col("beginning_score").alias("beginning"),
            F.col("middle_score").alias("middle"),
            F.col("end_score").alias("end"),
        )
    )
    source = F.when(
        F.coalesce("source_label", F.lit("")) == "", infer_source(F.col("url"))
    ).otherwise(F.col("source_label"))
    columns = {
        "timestamp": F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"),
        "source_label": source,
        "url": F.coalesce("url", F.lit("")),
        "headline": F.substring("headline", 1, 200),
        "lexicon_score": F.col("lexicon_rate"),
        "loaded_word_count": F.col("loaded_word_count").cast("bigint"),
        "opinion_ratio": round_to(F.col("opinion_ratio")),
        "quote_ratio": round_to(F.col("quote_ratio")),
        "attribution_ratio": round_to(F.col("attribution_ratio")),
        "hedge_label": F.coalesce("hedge_label", F.lit("Not analysed")),
        "top_loaded_words": F.coalesce("top_loaded_words", F.lit("")),
        "negatively_framed_entities": F.coalesce("negatively_framed_entities", F.lit("")),
        "ner_entity_count": F.coalesce("ner_entity_count", F.lit(0)).cast("bigint"),
        "section_breakdown": breakdown,
    }
    return report.select(
        *[columns.get(name, F.col(name)).alias(name) for name in C.HISTORY_COLUMNS]
    )


def history_filter(
    analyses: DataFrame, domain: str | None = None, verdict: str | None = None
) -> DataFrame:
    """Equality filters; both reach the scan as pushed-down predicates."""
    if domain:
        analyses = analyses.filter(F.col("domain") == domain)
    if verdict:
        analyses = analyses.filter(F.col("verdict") == verdict)
    return analyses


def history_page(
    analyses: DataFrame,
    page: int = 1,
    per_page: int = 20,
    domain: str | None = None,
    verdict: str | None = None,
) -> DataFrame:
    """One page, newest first. Planned as a top-k of ``page * per_page`` rows."""
    if page < 1 or not 1 <= per_page <= 100:
        raise ValueError("page starts at 1 and per_page is 1 to 100")
    return (
        history_filter(analyses, domain, verdict)
        .select(
            "id", "url", "domain", "headline",
            F.coalesce("composite_score", F.lit(0.0)).alias("composite_score"),
            F.coalesce("verdict", F.lit("")).alias("verdict"),
            F.coalesce("ml_label", F.lit(0)).alias("ml_label"),
            "created_at",
        )
        .orderBy(F.desc_nulls_last("created_at"), "id")
        .offset((page - 1) * per_page)
        .limit(per_page)
    )


def history_page_after(
    analyses: DataFrame,
    created_at: datetime | None,
    analysis_id: str,
    per_page: int = 20,
    domain: str | None = None,
    verdict: str | None = None,
) -> DataFrame:
    """The page after the row with this time and identifier, at any depth for the cost of one page.

    Date folders after that row are not read, and no more than ``per_page`` rows are gathered.
    """
    if created_at is None:  # undated rows come last, by identifier
        rest = F.col("created_date").isNull() & F.col("created_at").isNull() & (F.col("id") > analysis_id)
    else:
        stamp = F.lit(created_at)
        later = F.col("created_at").isNull() | (F.col("created_at") < stamp)
        rest = (F.col("created_date").isNull() | (F.col("created_date") <= F.to_date(stamp))) & (
            later | ((F.col("created_at") == stamp) & (F.col("id") > analysis_id))
        )
    return history_page(analyses.filter(rest), 1, per_page, domain, verdict)


def history_total(
    analyses: DataFrame, domain: str | None = None, verdict: str | None = None
) -> DataFrame:
    return history_filter(analyses, domain, verdict).agg(F.count(F.lit(1)).alias("total"))


def history_lookup(analyses: DataFrame, analysis_id: str) -> DataFrame:
    """One analysis by id, null scores as zero."""
    found = analyses.filter(F.col("id") == analysis_id)
    return (
        found.withColumn("composite_score", F.coalesce("composite_score", F.lit(0.0)))
        .withColumn("verdict", F.coalesce("verdict", F.lit("")))
        .withColumn("ml_probability", F.coalesce("ml_probability", F.lit(0.0)))
        .withColumn("ml_label", F.coalesce("ml_label", F.lit(0)))
        .withColumn(
            "analysis_version", F.coalesce("analysis_version", F.lit(C.ANALYSIS_VERSION))
        )
    )


def _exact(name: str):
    return F.col(name).cast("decimal(18,6)")


def _exact_mean(name: str):
    """Mean of the values there are; null if there is none."""
    return F.try_divide(F.sum(_exact(name)).cast("double"), F.count(name))


def source_ranking(log: DataFrame) -> DataFrame:
    """Mean composite per source, highest first; hot sources are combined before the shuffle.

    Null scores are left out of a mean, null sources out of the ranking; a source without any score
    comes last.
    """
    return (
        log.filter(F.col("source_label").isNotNull())
        .groupBy("source_label")
        .agg(F.count(F.lit(1)).alias("analyses"), _exact_mean("composite_score").alias("mean_composite"))
        .orderBy(F.desc_nulls_last("mean_composite"), "source_label")
    )


def verdict_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def date_range(log: DataFrame) -> DataFrame:
    """First and last valid timestamp as text, ``N/A`` when there is none."""
    stamp = F.expr("try_to_timestamp(timestamp)")

    def shown(value):
        return F.coalesce(F.date_format(value, "yyyy-MM-dd HH:mm:ss"), F.lit("N/A"))

    return log.agg(shown(F.min(stamp)).alias("first"), shown(F.max(stamp)).alias("last"))


def summary_stats(log: DataFrame) -> DataFrame:
    """One row, also for an empty log.

    The most biased source is the top of an aggregate with one row per source, so its inputs are
    combined before they meet. Means are over the scores there are, 0 if there is none.
    """

    def mean(name: str):
        total = F.sum(F.col(f"{name}_sum")).cast("double")
        return round_to(F.coalesce(F.try_divide(total, F.sum(f"{name}_n")), F.lit(0.0)))

    names = ["composite_score", "ml_probability", "opinion_ratio"]
    stamp = F.expr("try_to_timestamp(timestamp)")
    per_source = log.groupBy("source_label").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(_exact(n)).alias(f"{n}_sum") for n in names],
        *[F.count(n).alias(f"{n}_n") for n in names],
        F.min(stamp).alias("first"),
        F.max(stamp).alias("last"),
    )
    mean_score = F.try_divide(F.col("composite_score_sum").cast("double"), F.col("composite_score_n"))
    unranked = mean_score.isNull() | F.col("source_label").isNull()
    rankable = F.when(~unranked, F.col("source_label"))
    shown = {
        edge: F.coalesce(F.date_format(f(edge), "yyyy-MM-dd HH:mm:ss"), F.lit("N/A"))
        for edge, f in (("first", F.min), ("last", F.max))
    }
    return per_source.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_analyses"),
        mean("composite_score").alias("avg_composite"),
        mean("ml_probability").alias("avg_ml_prob"),
        mean("opinion_ratio").alias("avg_opinion_ratio"),
        F.coalesce(
            F.min_by(rankable, F.struct(unranked, -mean_score, F.col("source_label"))), F.lit("N/A")
        ).alias("most_biased_source"),
        shown["first"].alias("first_analysis"),
        shown["last"].alias("last_analysis"),
    )


def domain_stats(analyses: DataFrame, ratings: DataFrame) -> DataFrame:
    """Per domain: articles, mean score, last update, and its rating.

    Aggregated before the join, so a domain with very many articles is one row when it meets the
    ratings.
    """
    stats = analyses.groupBy("domain").agg(
        F.count(F.lit(1)).alias("total_articles"),
        round_to(_exact_mean("composite_score")).alias("avg_bias_score"),
        F.max("created_at").alias("last_updated"),
    )
    return stats.join(
        ratings.select("domain", "leaning", "factual", "country"), "domain", "left"
    )
