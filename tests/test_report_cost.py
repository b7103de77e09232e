"""What scoring a text costs: one search for all phrases, one look-up per word, only words to Python."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from framescope.functions.text import count_char, mark_phrase, mark_words, vector_tokens
from framescope.operators import analysis, composite, hedging, sentiment, shaping
from framescope.operators.linear_model import LinearTextModel
from framescope.operators.term_sketch import count_known_terms
from framescope.operators.tfidf import TfidfModel

_TEXTS = [
    "It is clearly so. Of course it is clear, as everyone knows.", "Of  course not; unclearly, clearly-wrong it_is clear",
    "No one disputes that no one, no ONE disputes no", "it is said to", "don't know; it's (no! clearly", "CLEARLYİ may have\nmight have",
    "\x01clearly\x01 naturally\x01", "éclearly clearlyé clearly", "", None, "of" + "course of course" * 3,
]
_PHRASES = [
    hedging.PHRASES,
    {"epistemic": ["no", "no one", "it is", "Upper", "don't know"], "inflation": ["no one disputes", "(no", "of course", "é"]},
    {"epistemic": ["(no"], "inflation": []},
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("phrases", _PHRASES)
def test_phrases_are_found_in_one_search(spark, phrases):
    """Every phrase that occurs as words is there, none that does not occur at all, in the given order."""
    df = spark.createDataFrame(list(enumerate(_TEXTS)), "doc_id long, text string")
    rows = df.select(
        F.lower(F.coalesce("text", F.lit(""))).alias("lowered"),
        mark_words(F.coalesce("text", F.lit(""))).alias("marked"),
        hedging.present_phrases(F.col("text"), phrases).alias("found"),
    ).collect()
    every = [p for group in phrases.values() for p in group]
    for row in rows:
        found = [p["phrase"] for p in row["found"]]
        assert [p for p in every if p in row["lowered"] and mark_phrase(p) in row["marked"]] == [
            p for p in found if mark_phrase(p) in row["marked"]
        ]
        assert all(p in row["lowered"] for p in found)
        assert found == [p for p in every if p in found]


def test_phrases_are_not_searched_one_by_one(spark):
    scanned = hedging.hedge_scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert "regexp_extract_all" in plan(scanned)


def test_only_listed_words_are_looked_up(spark):
    """Words are tested as a set, and the places of listed ones serve both scores."""
    df = spark.createDataFrame(list(enumerate(_TEXTS)), "doc_id long, text string")
    text = plan(sentiment.auxiliary_scores(df))
    assert "INSET" in text and text.count("_emotion_places") > 0
    both = sentiment.auxiliary_scores(df).collect()
    apart = sentiment.subjectivity(sentiment.emotion_intensity(df)).collect()
    assert [r.asDict() for r in both] == [r.asDict() for r in apart]


@pytest.mark.parametrize("count", [3, sentiment.MAX_SET_WORDS + 5])
def test_short_and_long_word_lists_score_alike(spark, count):
    words = {"vile": (-3.0, 0.9), "heroic": (2.0, 0.8), "none": (None, 0.5)} | {f"w{i}": (1.0, 0.5) for i in range(count - 3)}
    texts = ["a VILE, not very heroic act but heroic none", "all lower vile", "ALL UPPER VILE", "none", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sentiment.auxiliary_scores(df, words=words).orderBy("doc_id").collect()
    hits = df.select(
        "doc_id", F.size(F.filter(sentiment.emotion_words(F.col("text")), lambda w: F.lower(w).isin("vile", "heroic"))).alias("n")
    ).orderBy("doc_id").collect()
    assert [r["n"] for r in hits] == [3, 1, 1, 0, 0, 0]
    assert [r["compound"] == 0.0 for r in rows] == [False, False, False, True, True, True]
    # Capitals count only where a text has both kinds of words.
    assert rows[1]["compound"] == rows[2]["compound"]


def test_matching_terms_sends_only_words_to_python(spark):
    df = spark.createDataFrame([(1, "ab cd ab", [1]), (2, None, None)], "doc_id long, text string, more array<int>")
    counted = count_known_terms(df, vector_tokens("text"), ["ab", "ab cd", "cd"], 1, 3, "found")
    assert "MapInArrow" not in plan(counted)
    rows = counted.orderBy("doc_id").collect()
    assert [[tuple(p) for p in r["found"]] for r in rows] == [[(0, 2), (1, 1), (2, 1)], []]
    assert counted.columns == ["doc_id", "text", "more", "found"] and rows[0]["more"] == [1]


def test_characters_are_counted_by_bytes(spark):
    df = spark.createDataFrame([("é!ü!!",), ("",), ("€?",)], "text string")
    assert [r[0] for r in df.select(count_char(F.col("text"), "!")).collect()] == [3, 0, 0]
    assert "octet_length" in plan(df.select(count_char(F.col("text"), "!")))


def test_a_filter_on_counts_does_not_count_again(spark):
    df = spark.createDataFrame([(1, "ab cd ab"), (2, None)], "doc_id long, text string")
    counted = count_known_terms(df, vector_tokens("text"), ["ab", "cd"], 1, 1, "found").withColumn("n", F.size("found"))
    filtered = counted.filter("n > 0")
    assert plan(filtered).count("ArrowEvalPython") == plan(counted).count("ArrowEvalPython") == 1
    assert [(r["doc_id"], r["n"]) for r in filtered.collect()] == [(1, 2)]


_ARTICLES = ["One. It was clearly said.", " Two\nlines of vile words", "a b.\n\nc was lost!\nd heroic\ne", "", None, "same\n", "x.\nx.\nx."]


def test_sections_of_the_same_text_are_scored_once(spark):
    """Articles of fewer than three paragraphs have their text scored once, with the scores of all five sections."""
    articles = shaping.shape_text_articles(spark.createDataFrame(list(enumerate(_ARTICLES)), "doc_id long, text string"))
    texts = shaping.section_texts(articles)
    held = [(r["doc_id"], r["section_text"]) for r in texts.collect()]
    assert len(held) == len(set(held)) and len(held) < 5 * len(_ARTICLES)
    alone = [r for r in texts.collect() if r["doc_id"] == 0]
    assert {tuple(r["sections"]) for r in alone} == {("Full Body", "Beginning", "Middle", "End"), ("Headline",)}
    model = LinearTextModel(TfidfModel(("clearly", "vile words"), (1.0, 1.5), 1, 3), (2.0, -1.0), 0.1)
    columns = ["doc_id", "section", "section_text", *composite.SECTION_COLUMNS]
    plain = composite.score_text(shaping.explode_sections(articles), "section_text", model).select(*columns)

    def ordered(df):
        return sorted((str(r.asDict()) for r in df.collect()))

    assert ordered(composite.score_sections(articles, model).select(*columns)) == ordered(plain)


def test_sentences_of_a_text_are_split_once_for_both_engines(spark):
    scored = composite.score_text(spark.createDataFrame([(1, "a", 0.5)], "doc_id long, text string, ml_probability double"), "text")
    # Tokens, words of the valence rules, sentences.
    assert plan(scored).count("split(") == 3


def test_accepted_pages_are_extracted_once(spark):
    """The filter on success is not pushed below the exchange of the pages, which would extract there as well."""
    pages = spark.createDataFrame([(1, "http://a.b/c", "<p>x</p>")], "page_id long, url string, html string").repartition(3, "page_id")
    text = plan(analysis.accepted_pages(shaping.extract_fallback(pages)))
    assert "regexp_replace" in text and "regexp_replace" not in text[text.index("Exchange"):]
