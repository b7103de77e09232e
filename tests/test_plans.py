"""Physical plans: what must not shuffle does not, what can be pushed down is."""

from __future__ import annotations

from conftest import SMALL
from pyspark.sql import functions as F

from framescope.operators import corpus, history, shaping
from framescope.operators.composite import score_text
from framescope.operators.features import linguistic_features
from framescope.operators.linear_model import LinearTextModel
from framescope.operators.tfidf import TfidfModel, term_counts
from framescope.plans.history_queries import analyses, history_row
from framescope.sources.history import HISTORY_SCHEMA


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")


def model():
    return LinearTextModel(TfidfModel(("alpha", "alpha beta"), (1.0, 1.5), 1, 3), (2.0, -1.0), 0.1)


def test_scoring_never_shuffles(spark):
    for frame in (
        score_text(documents(spark), "text", model()),
        linguistic_features(documents(spark)),
        term_counts(documents(spark)),
        shaping.explode_sections(shaping.shape_text_articles(documents(spark))),
        shaping.extract_fallback(spark.read.parquet(f"{SMALL}/pages.parquet")),
    ):
        text = plan(frame)
        assert "Exchange" not in text
        assert "Python" not in text and "ArrowEval" not in text


def test_filters_on_scores_do_not_multiply_the_work(spark):
    """A filter on a computed column may be pushed down, but never into a per-element loop."""
    scored = score_text(documents(spark), "text", model())
    frame = scored.filter("composite_score > 0.4 AND loaded_word_count >= 0")
    frame.select("doc_id", "composite_score").write.format("noop").mode("overwrite").save()
    assert plan(frame).count("regexp_extract_all") <= 4


def test_scan_reads_only_needed_columns(spark):
    text = plan(score_text(spark.read.parquet(f"{SMALL}/documents.parquet"), "text", model()).select(
        "doc_id", "hedge_score"
    ))
    schema = text[text.index("ReadSchema"):].split("\n")[0]
    assert "doc_id" in schema and "text" in schema and "lang" not in schema


def test_history_row_leaves_no_column_out(spark):
    """All columns of the log, so entities and attribution are worked out as well."""
    rows = history_row(spark, SMALL)
    assert [f"`{n}` {t}" for n, t in rows.dtypes] == HISTORY_SCHEMA.split(", ")
    assert rows.filter("ner_entity_count > 0 AND attribution_ratio > 0").count() > 0


def test_history_filters_are_pushed_down(spark):
    page = history.history_page(analyses(spark, SMALL), 1, 20, domain="cnn.com")
    text = plan(page)
    assert "EqualTo(domain,cnn.com)" in text
    assert "TakeOrderedAndProject" in text
    recent = analyses(spark, SMALL).filter(F.col("created_date") >= "2024-01-01")
    assert "PartitionFilters: [isnotnull(created_date" in plan(recent)


def test_dedup_has_no_window(spark):
    frame = documents(spark).select(
        F.col("doc_id").alias("row_id"), "text", F.lit(0).alias("label"), F.lit("d").alias("source")
    )
    text = plan(corpus.build_corpus([frame]))
    assert "Window" not in text and "partial_min" in text


def test_no_cartesian_products(spark):
    from framescope.plans.history_queries import full_report

    text = plan(full_report(spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_terms_are_cut_before_the_shuffle(spark):
    from framescope.operators.explore import top_ngrams
    from framescope.plans.planted import labelled_documents

    text = plan(top_ngrams(labelled_documents(spark, SMALL), 2))
    assert text.count("WindowGroupLimit") == 2


def test_entities_read_texts_once(spark):
    from framescope.operators import entities as N
    from framescope.plans.history_queries import full_report
    from framescope.plans.planted import gazetteer

    docs = documents(spark)
    for frame in (
        N.gazetteer_summary(docs, gazetteer(spark)),
        N.top_entities(N.entity_mentions(docs, gazetteer(spark))),
    ):
        assert plan(frame).count("FileScan") == 1
    assert plan(full_report(spark, SMALL)).count("FileScan") == 2


def test_tfidf_moves_no_text(spark):
    from framescope.operators.tfidf import tfidf

    assert "Exchange" not in plan(tfidf(documents(spark), max_features=50))


def test_keyset_page_reads_only_older_dates(spark):
    from datetime import datetime

    page = history.history_page_after(analyses(spark, SMALL), datetime(2024, 1, 1, 2), "x", 5)
    text = plan(page)
    filters = text[text.index("PartitionFilters: ["):].split("]")[0]
    assert "created_date" in filters


def test_a_filter_on_the_classifier_leaves_one_copy_of_it(spark):
    from framescope.operators.metrics import score_counts
    from framescope.plans.planted import predictions

    scored = predictions(spark, SMALL)
    filtered = scored.filter("probability > 0.5 AND NOT isnan(probability)")
    assert plan(filtered).count("regexp_extract_all") == plan(scored).count("regexp_extract_all")
    assert "regexp_extract_all" not in plan(score_counts(scored))


def test_entities_are_found_in_the_row(spark):
    """No n-gram leaves the scan stage: neither texts nor words are joined."""
    from framescope.operators import entities as N
    from framescope.plans.planted import gazetteer

    docs = documents(spark)
    mentions = N.entity_mentions(docs, gazetteer(spark))
    assert "Exchange" not in plan(mentions) and "Join" not in plan(mentions)
    for frame in (N.gazetteer_summary(docs, gazetteer(spark)), N.top_entities(mentions)):
        assert "Join" not in plan(frame) and "BroadcastExchange" not in plan(frame)


def test_model_frames_do_not_go_through_python(spark):
    from framescope.operators.models import training_frame

    rows = documents(spark).withColumn("label", (F.col("doc_id") % 2).cast("int"))
    frame = training_frame(rows, model().tfidf)
    assert "Python" not in plan(frame) and "MapInArrow" not in plan(frame)
    assert frame.schema["features"].dataType.typeName() == "vectorudt" or "Vector" in str(frame.schema["features"].dataType)
