"""Structured Streaming forms of scoring, deduplication and source statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framescope.operators.composite import score_text
from framescope.operators.linear_model import LinearTextModel
from framescope.sources.paths import child_names


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files arriving under a folder or glob."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def stream_score(articles: DataFrame, model: LinearTextModel | None, text: str = "text") -> DataFrame:
    """Stateless scoring: every engine is row-local, so batches need no state and no shuffle."""
    return score_text(articles, text, model)


def stream_dedup(
    analyses: DataFrame, key: str = "id", stamp: str = "created_at", delay: str = "1 day"
) -> DataFrame:
    """One row per id; the watermark bounds how long an id is remembered."""
    return analyses.withWatermark(stamp, delay).dropDuplicatesWithinWatermark([key])


def stream_source_stats(
    analyses: DataFrame,
    stamp: str = "created_at",
    delay: str = "1 day",
    window: str = "1 day",
) -> DataFrame:
    """Counts and exact score sums per day, source and verdict.

    Aggregates are combined in each task before the shuffle, so one very active source does not
    overload a state partition.
    """
    return (
        analyses.withWatermark(stamp, delay)
        .groupBy(F.window(stamp, window), "source_label", "verdict")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("composite_score").cast("decimal(18,6)")).alias("score_sum"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            "source_label",
            "verdict",
            "n",
            (F.col("score_sum").cast("double") / F.col("n")).alias("mean_composite"),
        )
    )


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write everything that has arrived to an append table, then stop."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def update_latest(
    stream: DataFrame, path: str, checkpoint: str, keys: list[str], compact_every: int = 20
) -> StreamingQuery:
    """Update mode: each batch writes its changed groups under its own batch number.

    After every ``compact_every`` batches the newest row of every group is written as one generation, so that
    :func:`latest_state` reads one generation and at most that many batches, however long the stream
    has run. Older folders are read by nobody and are left to the retention of the folder.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        # The number is part of the path, so a batch replayed after a failure replaces itself.
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if (number + 1) % compact_every == 0:
            state = latest_state(spark, path, keys, upto=number)
            state.write.mode("overwrite").parquet(f"{path}/generation={number}")

    return (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def state_folders(spark: SparkSession, path: str, upto: int | None = None) -> tuple[int | None, list[int]]:
    """The newest finished generation and the batches after it, up to a batch number.

    A generation counts once its success mark is written, and never for its own making.
    """
    names = child_names(spark, path)
    limit = float("inf") if upto is None else upto
    generations = [int(n.split("=")[1]) for n in names if n.startswith("generation=")]
    finished = [g for g in generations if g <= limit and g != upto and "_SUCCESS" in child_names(spark, f"{path}/generation={g}")]
    newest = max(finished, default=None)
    batches = sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))
    return newest, [b for b in batches if b <= limit and (newest is None or b > newest)]


def latest_state(spark: SparkSession, path: str, keys: list[str], upto: int | None = None) -> DataFrame:
    """Newest row per key of the tables that :func:`update_latest` writes."""
    newest, batches = state_folders(spark, path, upto)
    parts = [] if newest is None else [(newest, f"{path}/generation={newest}")]
    parts += [(b, f"{path}/batch={b}") for b in batches]
    written = None
    for number, folder in parts:
        rows = spark.read.parquet(folder).withColumn("_batch", F.lit(number))
        written = rows if written is None else written.unionByName(rows)
    if written is None:
        raise ValueError(f"nothing has been written to {path}")
    values = [c for c in written.columns if c not in (*keys, "_batch")]
    return (
        written.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), "_batch").alias("v"))
        .select(*keys, "v.*")
    )
