"""Extraction, sections, ratings and history on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from framescope import constants as C
from framescope.functions.urls import extract_domain, infer_source, valid_url
from framescope.operators import history, ratings, shaping
from framescope.session import scratch_path
from framescope.sources import history as stored
from framescope.sources import ratings as rating_source

LONG = " ".join(f"word{i}" for i in range(31))


@pytest.mark.parametrize(
    "url, domain, valid",
    [
        ("https://www.ndtv.com/india/article", "ndtv.com", True),
        ("https://thehindu.com/news", "thehindu.com", True),
        ("not-a-url", "", False),
        ("//host.only/path", "host.only", False),
        ("http://User:p@WWW.X.com:80/a?b#c", "user:p@www.x.com:80", True),
        ("", "", False),
        (None, "", False),
    ],
)
def test_urls(spark, url, domain, valid):
    df = spark.createDataFrame([(url,)], "url string")
    row = df.select(
        extract_domain(F.col("url")).alias("d"), valid_url(F.col("url")).alias("v")
    ).first()
    assert (row["d"], row["v"]) == (domain, valid)


def test_infer_source(spark):
    urls = ["", "  ", "https://www.A.com?x=1/b", "https://", "http://b.org/x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r["s"] for r in df.select(infer_source(F.col("url")).alias("s")).collect()]
    assert got == ["Raw Text", "Raw Text", "A.com?x=1", "Unknown", "b.org"]


def test_fallback_chain(spark):
    body = f"<p>{LONG}<p>please subscribe to our newsletter right now today"
    rows = [
        (1, "https://a.org/1", f"<html><title>T &amp; U</title><nav>menu</nav><h1> Head </h1>{body}</html>"),
        (2, "https://a.org/2", "<p>too short to be kept</p>"),
        (3, "a.org/3", f"<p>{LONG}</p>"),
        (4, "https://a.org/4", None),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    for order, headline in ((("lines", "paragraphs"), "T & U"), (("paragraphs", "lines"), "Head")):
        got = {r["page_id"]: r for r in shaping.extract_fallback(pages, order=order).collect()}
        assert got[1]["engine"] == order[0]
        assert got[1]["headline"] == headline
        assert got[2]["engine"] == "none" and got[2]["error"] == C.NO_TEXT_ERROR
        assert got[3]["error"] == C.INVALID_URL_ERROR and got[3]["body_paras"] == []
        assert not got[4]["success"]
    paragraphs = shaping.extract_paragraph_article(pages).filter("page_id = 1").first()
    assert paragraphs["body_paras"] == [LONG]


@pytest.mark.parametrize("words, ok", [(9, False), (10, True)])
def test_word_minimum(texts, words, ok):
    row = shaping.validate_texts(texts("  " + " ".join(["w"] * words) + " ")).first()
    assert row["accepted"] is ok


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 7])
def test_thirds(spark, n):
    paras = [f"p{i}" for i in range(n)]
    df = spark.createDataFrame([(1, paras)], "doc_id int, body_paras array<string>")
    row = shaping.split_thirds(df).first()
    parts = (row["beginning"], row["middle"], row["end"])
    if n < 3:
        assert parts == (" ".join(paras),) * 3
    else:
        k = n // 3
        assert parts == (" ".join(paras[:k]), " ".join(paras[k : 2 * k]), " ".join(paras[2 * k :]))


def test_ratings(spark):
    first = spark.createDataFrame(
        [("a.com", "Left", "High", "US"), ("www.b.com", "Right", "Low", "UK"),
         ("b.com", "Center", None, "UK")],
        rating_source.GLOBAL_SCHEMA,
    )
    second = spark.createDataFrame(
        [("a.com", "A", None, "Mixed", "IN", "English", "N", 1990, "Digital")],
        rating_source.REGIONAL_SCHEMA,
    )
    merged = {r["domain"]: r for r in ratings.merge_ratings(first, second).collect()}
    assert (merged["a.com"]["leaning"], merged["a.com"]["factual"]) == ("Left", "Mixed")
    assert (merged["b.com"]["leaning"], merged["b.com"]["factual"]) == ("Center", None)
    listed = {r["domain"]: r["leaning"] for r in ratings.list_domains(first, second).collect()}
    assert listed == {"a.com": None, "www.b.com": "Right", "b.com": "Center"}
    articles = spark.createDataFrame([(1, " WWW.A.com "), (2, "sub.a.com")], "id int, domain string")
    joined = {
        r["id"]: r["country"]
        for r in ratings.domain_lookup(articles, ratings.merge_ratings(first, second)).collect()
    }
    assert joined == {1: "IN", 2: None}
    path = scratch_path(spark, "r")
    rating_source.write_ratings(second, path)
    assert rating_source.read_ratings(spark, path).collect() == second.collect()
    absent = rating_source.read_ratings(spark, path + "-no", fallback=first)
    assert absent.count() == 3


def test_whole_file_ratings(spark, tmp_path):
    file = tmp_path / "r.json"
    file.write_text('{\n "x.in": {"name": "X", "leaning": "Left",\n "founded": 2001}\n}')
    row = rating_source.read_ratings(spark, str(file), whole_file=True).first()
    assert (row["domain"], row["name"], row["founded"], row["type"]) == ("x.in", "X", 2001, None)


def test_empty_history(spark):
    log = stored.load_history(spark, scratch_path(spark, "no-log"))
    assert log.columns == C.HISTORY_COLUMNS
    row = history.summary_stats(log.withColumn("timestamp", F.col("timestamp").cast("string"))).first()
    assert (row["total_analyses"], row["avg_composite"]) == (0, 0.0)
    assert (row["most_biased_source"], row["first_analysis"]) == ("N/A", "N/A")


def test_page_limits(spark):
    frame = spark.createDataFrame([], "id string")
    for page, size in ((0, 20), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            history.history_page(frame, page, size)
