"""Queries that run a stream over the given tables and read what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framescope.plans import oracle_base as B
from framescope.plans.history_queries import DOMAINS
from framescope.plans.planted import pick, plant, planted_model
from framescope.plans.registry import query
from framescope.session import scratch_path
from framescope.streaming import incremental as T

_DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@query(
    "stream_score",
    B.with_ctes(B.PLANTED, B.DOCS_AS_S, *B.ENGINES)
    + f" SELECT doc_id, composite_score, {B.verdict('composite_score', 'blank')} AS verdict, ml_probability, hedge_score FROM scored",
)
def stream_score(spark, sf_dir):
    """Arriving documents are scored once and appended; equals the batch result."""
    model = planted_model(spark, sf_dir)
    arriving = T.read_stream(spark, f"{sf_dir}/documents*.parquet", _DOCUMENTS)
    scored = T.stream_score(plant(arriving), model).select(
        "doc_id", "composite_score", "verdict", "ml_probability", "hedge_score"
    )
    path = scratch_path(spark, "scored")
    T.append_to(scored, path, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(path)


_ANALYSES = (
    "id string, created_at timestamp, source_label string, verdict string, composite_score double"
)
DELAY = "1 day"


def _analyses(spark: SparkSession, sf_dir: str, mark: str) -> DataFrame:
    """An analysis of every event; ``mark`` distinguishes the identifiers."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        F.md5(F.concat(F.lit(mark), F.col("event_id").cast("string")).cast("binary")).alias("id"),
        F.timestamp_seconds(
            F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("event_id") * 60
        ).alias("created_at"),
        pick(DOMAINS, F.col("user_id")).alias("source_label"),
        F.col("event_type").alias("verdict"),
        (F.pmod(F.floor(F.col("value") * 7), F.lit(101)) / F.lit(100.0)).alias("composite_score"),
    )


def _arrive_twice(
    spark: SparkSession, sf_dir: str, copies: int, run: Callable[[DataFrame], StreamingQuery]
) -> None:
    """Run a stream over the analyses of all events, then again, from its checkpoint, over late ones.

    Every identifier of the first arrival comes ``copies`` times. The second arrival holds another
    analysis of every tenth event and, of every 25th, the one that has arrived already. By then the
    watermark is one day before the newest event, so most of them are too late.
    """
    path = scratch_path(spark, "arrivals")
    first = _analyses(spark, sf_dir, "")
    first = first.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    first.drop("copy", "event_id").write.parquet(path)
    arriving = T.read_stream(spark, path, _ANALYSES, files_per_trigger=1_000_000)
    run(arriving).awaitTermination()
    late = _analyses(spark, sf_dir, "late-").filter("event_id % 10 = 0")
    if copies > 1:
        late = late.union(_analyses(spark, sf_dir, "").filter("event_id % 25 = 0"))
    late.drop("event_id").write.mode("append").parquet(path)
    run(T.read_stream(spark, path, _ANALYSES, files_per_trigger=1_000_000)).awaitTermination()


_AT = "(TIMESTAMP '2024-01-01' + to_minutes(event_id))"
# What the watermark is when the second arrival is read.
_MARK = f"(SELECT max{_AT} - INTERVAL 1 DAY FROM events)"


@query(
    "stream_dedup",
    f"SELECT md5(event_id::VARCHAR) AS id, strftime({_AT}, '%Y-%m-%d %H:%M:%S') AS created_at FROM events UNION ALL "
    f"SELECT md5('late-' || event_id), strftime({_AT}, '%Y-%m-%d %H:%M:%S') FROM events WHERE event_id % 10 = 0 AND {_AT} > {_MARK}",
)
def stream_dedup(spark, sf_dir):
    """Each identifier once; what arrives later than the watermark allows is dropped."""
    path, checkpoint = scratch_path(spark, "unique"), scratch_path(spark, "checkpoint")
    _arrive_twice(
        spark, sf_dir, 3, lambda s: T.append_to(T.stream_dedup(s, delay=DELAY), path, checkpoint)
    )
    return spark.read.parquet(path).select(
        "id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at")
    )


_EVENT_SCORE = "((floor(value * 7)::BIGINT % 101) / 100e0)"


@query(
    "stream_source_stats",
    f"WITH arrived AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 10 = 0 "
    f"AND date_trunc('day', {_AT}) + INTERVAL 1 DAY > {_MARK}) "
    f"SELECT strftime(date_trunc('day', {_AT}), '%Y-%m-%d') AS day, {B.pick(DOMAINS, 'user_id')} AS source_label, "
    f"event_type AS verdict, count(*)::BIGINT AS n, sum({_EVENT_SCORE}::DECIMAL(18,6))::DOUBLE / count(*) AS mean_composite FROM arrived GROUP BY ALL",
)
def stream_source_stats(spark, sf_dir) -> DataFrame:
    """Final state of the running daily statistics; days that the watermark has passed stay closed."""
    path, checkpoint = scratch_path(spark, "stats"), scratch_path(spark, "checkpoint")
    keys = ["window_start", "source_label", "verdict"]
    _arrive_twice(
        spark, sf_dir, 1,
        lambda s: T.update_latest(T.stream_source_stats(s, delay=DELAY), path, checkpoint, keys, compact_every=2),
    )
    return T.latest_state(spark, path, keys).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"),
        "source_label", "verdict", "n", "mean_composite",
    )
