"""Partial sums by date and compacted stream states."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from framescope.session import scratch_path
from framescope.sources import rollups
from framescope.sources.history import read_analyses
from framescope.streaming import incremental

REPORT = (
    "id string, url string, domain string, headline string, body_preview string, composite_score double, verdict string, "
    "ml_probability double, ml_label long, engine_scores string, scrape_engine string, word_count long, created_at timestamp"
)


def rows(spark, *given):
    data = [
        (i, "u", domain, "h", "b", score, verdict, 0.5, 1, "{}", "x", 10, day and datetime(2024, 3, day, 12))
        for i, domain, score, verdict, day in given
    ]
    return spark.createDataFrame(data, REPORT)


def files_of(spark, path):
    return sorted(r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").collect())


def test_a_day_is_renewed_alone_and_twice_the_same(spark):
    path, sums = scratch_path(spark, "a"), scratch_path(spark, "s")
    assert rollups.read_sums(spark, sums).count() == 0
    rollups.append_with_sums(
        rows(spark, ("1", "a.b", 0.2, "Neutral", 1), ("2", "a.b", None, "Neutral", 1), ("3", None, 0.4, None, None)), path, sums
    )
    before = [f for f in files_of(spark, sums) if "created_date=2024-03-01" in f]
    rollups.append_with_sums(rows(spark, ("4", "a.b", 0.8, "Biased", 2), ("5", "c.d", 0.6, "Biased", 2)), path, sums)
    assert [f for f in files_of(spark, sums) if "created_date=2024-03-01" in f] == before
    once = sorted(map(str, rollups.read_sums(spark, sums).collect()))
    rollups.renew_sums(spark, path, sums, [date(2024, 3, 2), date(2024, 3, 1), None])
    assert sorted(map(str, rollups.read_sums(spark, sums).collect())) == once
    ratings = spark.createDataFrame([("a.b", "Left", "High", "US")], "domain string, leaning string, factual string, country string")
    stats = {r["domain"]: r for r in rollups.domain_stats_of(rollups.read_sums(spark, sums), ratings).collect()}
    assert stats["a.b"]["total_articles"] == 3 and stats["a.b"]["avg_bias_score"] == 0.5 and stats["a.b"]["leaning"] == "Left"
    assert stats[None]["total_articles"] == 1 and stats[None]["last_updated"] is None
    counts = {r["verdict"]: r["n"] for r in rollups.verdict_counts_of(rollups.read_sums(spark, sums)).collect()}
    assert counts == {"Neutral": 2, "Biased": 2, None: 1}
    total = rollups.totals_of(rollups.read_sums(spark, sums)).first()
    assert total["total_analyses"] == 5 and total["avg_composite"] == 0.5
    assert rollups.totals_of(rollups.read_sums(spark, scratch_path(spark, "none"))).first()["total_analyses"] == 0


def test_a_renewal_reads_only_its_dates(spark):
    path, sums = scratch_path(spark, "a"), scratch_path(spark, "s")
    rollups.append_with_sums(rows(spark, *[(str(d), "a.b", 0.1, "N", d) for d in range(1, 9)]), path, sums)
    days = read_analyses(spark, path).filter(F.col("created_date").isin([date(2024, 3, 4)]))
    text = rollups.daily_sums(days)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "2024-03-04" in text
    assert days.select(F.input_file_name()).distinct().count() == 1


def test_stream_state_reads_a_bounded_number_of_folders(spark):
    arriving, path, checkpoint = (scratch_path(spark, n) for n in ("in", "state", "check"))
    schema = "created_at timestamp, source_label string, verdict string, composite_score double"
    keys = ["window_start", "source_label", "verdict"]
    for i in range(11):
        one = [(datetime(2024, 1, 1, i), f"s{i % 2}", "v", 0.5)]
        spark.createDataFrame(one, schema).coalesce(1).write.mode("append").parquet(arriving)
        stream = incremental.stream_source_stats(incremental.read_stream(spark, arriving, schema, 1))
        incremental.update_latest(stream, path, checkpoint, keys, compact_every=4).awaitTermination()
        newest, batches = incremental.state_folders(spark, path)
        assert len(batches) <= 4
    assert newest is not None and newest % 4 == 3
    state = {r["source_label"]: r["n"] for r in incremental.latest_state(spark, path, keys).collect()}
    assert state == {"s0": 6, "s1": 5}
    # An unfinished generation, and one in the making, is not read.
    spark.range(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/generation=99")
    assert incremental.state_folders(spark, path)[0] == newest
    assert incremental.state_folders(spark, path, upto=newest)[0] != newest


def test_a_changed_table_has_another_version(spark, tmp_path):
    from framescope.sources.paths import data_version

    spark.range(3).write.parquet(f"{tmp_path}/documents.parquet")
    first = data_version(spark, str(tmp_path))
    assert first == data_version(spark, str(tmp_path))
    spark.range(4).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    assert data_version(spark, str(tmp_path)) != first
