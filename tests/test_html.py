"""Page extraction against the rules of HTML."""

from __future__ import annotations

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from framescope.constants import BOILERPLATE_TAGS
from framescope.functions.html import decode_entities, extract_headline, extract_paragraphs, strip_boilerplate
from framescope.operators.shaping import extract_fallback

PARTS = [
    "&amp;", "&rsquo;", "&#8217;", "&#x2019;", "&lt", "&ltx", "&notit;", "&notin;", "&copy", "&copyright", "&nosuch;", "&", "&&",
    "&#", "&#x", "&#;", "&#0;", "&#128;", "&#x9f;", "&#129;", "&#xD800;", "&#1114112;", "&#99999999999;", "&#x0000041;",
    "&#65", "&#65x", "&#X41;", "&frac12", "&frac125", "&NotEqualTilde;", "&#11;", "&#xFFFE;", "&#xFDD0;", "&#13;", "&#127;",
    "&amp;lt;", " ", "a", ";", "text", "😀", "é", "&#128512;", "&CounterClockwiseContourIntegral;", "&AMP;", "&Amp;", "&\n", "#39;",
]


def test_references_are_decoded_as_html_says(spark):
    rng = random.Random(1)
    texts = [*PARTS, *("".join(rng.choice(PARTS) for _ in range(rng.randint(1, 12))) for _ in range(800)), ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for row in frame.withColumn("got", decode_entities(F.col("text"))).collect():
        assert row["got"] == html.unescape(row["text"]), row["text"]


def outside_by_hand(page: str) -> str:
    """Balanced pairs removed, tag by tag, with a stack."""
    for tag in BOILERPLATE_TAGS:
        if tag in ("script", "style"):
            page = re.sub(rf"(?is)<{tag}\b.*?</{tag}\s*>", "", page)
            continue
        kept, open_ = "", []
        for piece in re.split(rf"(?i)(<!--.*?(?:-->|$)|<{tag}\b[^>]*>|</{tag}\s*>)", page, flags=re.S):
            if re.match(rf"(?i)</{tag}", piece) and open_:
                kept = kept[: open_.pop()]
                continue
            if re.match(rf"(?i)<{tag}\b", piece) and not piece.endswith("/>"):
                open_.append(len(kept))
            kept += piece
        page = kept
    return page


def test_nested_boilerplate_goes_whole(spark):
    pages = {
        "a<nav>b<nav>c</nav>d</nav>e": "ae",
        "a<NAV class='x'>b<div>c</div><aside>d<nav>e</nav></aside></NAV >f": "af",
        "a<nav>b<nav>c</nav>d": "a<nav>bd",
        "a</nav>b<nav>c</nav>d": "a</nav>bd",
        "a<nav/>b<nav>c</nav>d": "a<nav/>bd",
        "a<!-- <nav> -->b<nav>c</nav>d": "a<!-- <nav> -->bd",
        "a<nav><!-- </nav> -->b</nav>c": "ac",
        "<script>if (a</nav>) {}</script><form><form><button>x</button></form>y</form>z": "z",
        "plain": "plain",
    }
    rng = random.Random(5)
    bits = ["<nav>", "</nav>", "<aside id=1>", "</aside>", "<p>", "</p>", "x", "y ", "<!-- c -->", "<footer>", "</footer >", "\n"]
    texts = [*pages, *("".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(400)), "<nav>" * 300 + "x" + "</nav>" * 300]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, html string")
    for row in frame.withColumn("got", strip_boilerplate(F.col("html"))).collect():
        assert row["got"] == outside_by_hand(row["html"]), row["html"]
        if row["html"] in pages:
            assert row["got"] == pages[row["html"]]
    assert frame.select(strip_boilerplate(F.lit(None).cast("string")).alias("c")).first()["c"] == ""


@pytest.mark.parametrize("order", [("paragraphs", "lines"), ("lines", "paragraphs")])
def test_planted_page(spark, order):
    words = " ".join(f"word{i}" for i in range(30))
    page = (
        "<html><head><title>T&eacute;st &#8212; it</title></head><body><nav>one <nav>two three four five six</nav> seven eight nine ten "
        f"eleven</nav><h1>It&rsquo;s &#x201C;news&#8221;</h1><p>{words} don&#8217;t &amp;amp; stop</p>"
        "<footer><footer>a b c d e f</footer> g h i j k l</footer></body></html>"
    )
    frame = spark.createDataFrame([(1, "https://a.b/c", page)], "page_id int, url string, html string")
    got = extract_fallback(frame, order=order).first()
    assert got["body_text"].endswith("don’t &amp; stop") and "seven" not in got["body_text"] and "g h" not in got["body_text"]
    clean = strip_boilerplate(F.col("html"))
    row = frame.select(extract_headline(clean).alias("h"), extract_paragraphs(clean).alias("p")).first()
    assert row["h"] == "It’s “news”" and len(row["p"]) == 1
