"""Tokenisers and splitters against plain Python on whole documents and on edge rows."""

from __future__ import annotations

import re
import unicodedata

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from framescope.functions import text as X
from framescope.plans.planted import planted_documents

EDGES = [
    "", "   \n\t ", "one", "no terminator", "3.5 percent.",
    "Dr. A met U.S. envoys. They left.", "“Smart” quotes.", "café au lait", "far-left iron-fisted",
    " lead and trail. ", "a.\n\nb!\tc? d", "Mr.Mrs. X. Y", "¿Qué? ¡No!", "x" * 50 + ".",
    "....", ". . .", "end with space. ", "vs. them. St. Ives U.K. now.", "a b c",
]


def py_tokens(text):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s-]", "", text.lower())).strip().split()


def py_sentences(text):
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]


def py_abbrev(text):
    known = r"\b(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|U\.S|U\.K|vs)\."
    safe = re.sub(known, lambda m: m.group().replace(".", "\x00"), text)
    parts = [s.replace("\x00", ".") for s in re.split(r"(?<=[.!?])\s+", safe)]
    return [s.strip() for s in parts if s.strip()]


def py_fragments(text):
    return [s.strip() for s in re.split(r"[.!?]+", text) if s.strip()]


def py_ngrams(text):
    plain = "".join(
        c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c)
    )
    tokens = re.findall(r"\b\w\w+\b", plain)
    grams = [tokens[i : i + n] for n in (1, 2, 3) for i in range(len(tokens) - n + 1)]
    return [" ".join(g) for g in grams]


CASES = [
    ("tokens", X.tokenize, py_tokens),
    ("raw", X.raw_words, lambda t: t.lower().split()),
    ("sentences", X.split_sentences, py_sentences),
    ("abbrev", X.split_sentences_abbrev, py_abbrev),
    ("fragments", X.split_fragments, py_fragments),
    ("ngrams", lambda c: X.ngrams_of(X.vector_tokens(c), 1, 3), py_ngrams),
]


@pytest.mark.parametrize("name, column, plain", CASES, ids=[c[0] for c in CASES])
def test_edges_and_documents(spark, texts, name, column, plain):
    documents = planted_documents(spark, SMALL).select("doc_id", "text")
    rows = texts(*EDGES).unionByName(documents).withColumn("got", column("text")).collect()
    for row in rows:
        assert row["got"] == plain(row["text"]), row["text"][:200]


def test_null_text_is_blank(texts):
    row = texts(None).select(
        X.tokenize("text").alias("t"), X.is_blank("text").alias("b"), X.strip("text").alias("s")
    ).first()
    assert (row["t"], row["b"], row["s"]) == ([], True, "")


def test_paragraphs_and_headline(texts):
    row = texts("First line. More\n\n  second \n").select(
        X.split_paragraphs("text").alias("p"),
        X.default_headline(F.lit(""), F.col("text")).alias("h"),
        X.default_headline(F.lit("Given"), F.col("text")).alias("g"),
    ).first()
    assert row["p"] == ["First line. More", "second"]
    assert (row["h"], row["g"]) == ("First line", "Given")
    assert texts(" ").select(X.split_paragraphs("text").alias("p")).first()["p"] == [" "]


def test_preview_cuts_only_long_texts(texts):
    rows = texts("x" * 120, "x" * 121).select(X.preview("text").alias("p")).collect()
    assert rows[0]["p"] == "x" * 120
    assert rows[1]["p"] == "x" * 120 + "..."


def test_highlight_escapes_terms(texts):
    row = texts("Costs $5 (net) and MORE").select(
        X.highlight_terms(F.col("text"), ["$5", "(net)", "more"]).alias("h")
    ).first()
    assert row["h"] == "Costs <mark>$5</mark> <mark>(net)</mark> and <mark>MORE</mark>"


def test_long_runs_stay_fast(texts):
    """Runs of one character must not make a pattern quadratic."""
    long = "word " + "=" * 200_000 + " " * 200_000 + "." * 1000 + " end"
    row = texts(long).select(
        F.size(X.split_fragments("text")).alias("f"), F.length(X.strip("text")).alias("n")
    ).first()
    assert row["n"] == len(long)
    assert row["f"] == len(py_fragments(long))
