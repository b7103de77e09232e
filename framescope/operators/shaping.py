"""From pages and raw texts to articles and sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope import constants as C
from framescope.functions import html as H
from framescope.functions import text as X
from framescope.functions.binding import let
from framescope.functions.urls import extract_domain, valid_url

# Block-level tags that end a line when a page is read as text.
_LINE_TAGS = r"(?i)</?(?:p|div|article|section|body|html|br|h[1-6]|ul|ol|li|tr|table)\b[^>]*>"


def extract_paragraph_article(
    pages: DataFrame, html: str = "html", min_words: int = 20
) -> DataFrame:
    """Add headline, paragraphs, body and word count; ``body_ok`` marks bodies above the gate."""
    cleaned = pages.withColumn("_clean", H.strip_boilerplate(F.col(html)))
    return _paragraph_article(cleaned, min_words).drop("_clean")


def _paragraph_article(cleaned: DataFrame, min_words: int = 20) -> DataFrame:
    """The same for pages whose boilerplate is gone (``_clean``)."""
    return (
        cleaned.withColumn("headline", H.extract_headline(F.col("_clean")))
        .withColumn("body_paras", H.extract_paragraphs(F.col("_clean")))
        .withColumn("body_text", F.array_join("body_paras", " "))
        .withColumn("word_count", X.word_count("body_text").cast("bigint"))
        .withColumn("body_ok", F.col("word_count") > min_words)
    )


def page_text(html: Column) -> Column:
    """A page as plain lines: block tags become line breaks, other tags vanish.

    The title is not part of the text.
    """
    return _clean_text(H.strip_boilerplate(html))


def _clean_text(cleaned: Column) -> Column:
    body = F.regexp_replace(cleaned, r"(?is)<title\b.*?</title\s*>", "")
    lines = F.regexp_replace(body, _LINE_TAGS, "\n")
    return H.decode_entities(F.regexp_replace(lines, r"(?s)<!--.*?-->|<[^>]*>", " "))


def extract_line_article(df: DataFrame, text: str = "text", min_words: int = 30) -> DataFrame:
    """Line-based article of a plain text column; empty below the word gate."""
    lines = F.when(X.word_count(text) > min_words, H.extract_lines(F.col(text))).otherwise(
        F.array().cast("array<string>")
    )
    return (
        df.withColumn("line_paras", lines)
        .withColumn("line_text", F.array_join("line_paras", " "))
        .withColumn("line_words", X.word_count("line_text").cast("bigint"))
    )


def extract_fallback(
    pages: DataFrame,
    url: str = "url",
    html: str = "html",
    min_words: int = 30,
    order: Sequence[str] = ("lines", "paragraphs"),
) -> DataFrame:
    """Try extractors in order; the first body above ``min_words`` words wins.

    Failed pages keep their row, with empty fields and an error text.
    """
    cleaned = pages.withColumn("_clean", H.strip_boilerplate(F.col(html)))
    tried = _paragraph_article(cleaned).withColumn("_page", _clean_text(F.col("_clean"))).drop("_clean")
    tried = extract_line_article(tried, "_page").withColumn(
        "title",
        H.inner_text(F.regexp_extract(F.col(html), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)),
    )
    ok = valid_url(F.col(url))
    columns = {
        "paragraphs": ("headline", "body_paras", "body_text", "word_count"),
        "lines": ("title", "line_paras", "line_text", "line_words"),
    }
    gates = {
        "paragraphs": ok & F.col("body_ok") & (F.col("word_count") > min_words),
        "lines": ok & (F.col("line_words") > min_words),
    }

    def first_good(position: int, empty: Column) -> Column:
        branches = [F.when(gates[name], F.col(columns[name][position])) for name in order]
        return F.coalesce(*branches, empty)

    engine = F.coalesce(*[F.when(gates[name], F.lit(name)) for name in order], F.lit("none"))
    success = engine != "none"
    error = (
        F.when(~ok, F.lit(C.INVALID_URL_ERROR))
        .when(~success, F.lit(C.NO_TEXT_ERROR))
        .otherwise(F.lit(""))
    )
    return tried.select(
        *[c for c in pages.columns if c != html],
        first_good(0, F.lit("")).alias("headline"),
        first_good(1, F.array().cast("array<string>")).alias("body_paras"),
        first_good(2, F.lit("")).alias("body_text"),
        first_good(3, F.lit(0).cast("bigint")).alias("word_count"),
        success.alias("success"),
        error.alias("error"),
        engine.alias("engine"),
        extract_domain(F.col(url)).alias("domain"),
    )


def validate_texts(df: DataFrame, text: str = "text", min_words: int = 10) -> DataFrame:
    """Strip the text and mark whether it has enough words to be analysed."""
    stripped = X.strip(text)
    accepted = X.word_count(text) >= min_words
    return (
        df.withColumn(text, stripped)
        .withColumn("accepted", accepted)
        .withColumn(
            "reject_reason",
            F.when(F.col("accepted"), F.lit("")).otherwise(
                F.lit(f"Text must be at least {min_words} words.")
            ),
        )
    )


def validate_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Strip the url and mark blank ones as rejected."""
    return (
        df.withColumn(url, X.strip(url))
        .withColumn("accepted", F.col(url) != "")
        .withColumn(
            "reject_reason",
            F.when(F.col("accepted"), F.lit("")).otherwise(F.lit("URL cannot be empty.")),
        )
    )


def shape_text_articles(
    df: DataFrame, text: str = "text", headline: str | None = None
) -> DataFrame:
    """Article columns for raw texts: headline, paragraphs, body, word count, engine."""
    given = F.col(headline) if headline else F.lit("")
    return (
        df.withColumn("headline", X.default_headline(given, F.col(text)))
        .withColumn("body_paras", X.split_paragraphs(text))
        .withColumn("body_text", F.coalesce(F.col(text), F.lit("")))
        .withColumn("word_count", X.word_count(text).cast("bigint"))
        .withColumn("engine", F.lit("text_input"))
    )


def split_thirds(df: DataFrame, paragraphs: str = "body_paras") -> DataFrame:
    """Add ``beginning``, ``middle`` and ``end``.

    Fewer than three paragraphs give the whole text three times; the remainder of the division goes
    to the end.
    """
    n = F.size(paragraphs)
    third = F.floor(n / 3).cast("int")

    def part(start: Column, length: Column) -> Column:
        whole = F.array_join(paragraphs, " ")
        cut = F.array_join(F.slice(paragraphs, start, length), " ")
        return F.when(n < 3, whole).otherwise(cut)

    return (
        df.withColumn("beginning", part(F.lit(1), third))
        .withColumn("middle", part(third + 1, third))
        .withColumn("end", part(third * 2 + 1, F.greatest(n - third * 2, F.lit(0))))
    )


def explode_sections(
    articles: DataFrame, key: str = "doc_id", carry: Sequence[str] = ()
) -> DataFrame:
    """Five rows per article: (key, carried columns, section, section text)."""
    columns = ["body_text", "headline", "beginning", "middle", "end"]
    sections = F.array(
        *[
            F.struct(F.lit(label).alias("section"), F.col(c).alias("section_text"))
            for label, c in zip(C.SECTIONS, columns, strict=True)
        ]
    )
    return split_thirds(articles).select(key, *carry, F.inline(sections))


def section_texts(
    articles: DataFrame, key: str = "doc_id", carry: Sequence[str] = ()
) -> DataFrame:
    """One row per different text of an article's sections: (key, carried columns, sections, section text).

    ``sections`` names the sections that have this text, in their order. An article of fewer than three paragraphs
    gives its whole text to several sections; what reads the text alone then reads it once.
    """
    columns = ["body_text", "headline", "beginning", "middle", "end"]
    # Bound together, so that neither a text nor the paragraphs are put together once per use.
    texts = F.array(*[F.col(c) for c in columns])
    names = F.array(*[F.lit(label) for label in C.SECTIONS])

    def named(found: Column) -> Column:
        def row(text: Column) -> Column:
            having = F.filter(names, lambda _, i: F.get(found, i).eqNullSafe(text))
            return F.struct(having.alias("sections"), text.alias("section_text"))

        return F.transform(F.array_distinct(found), row)

    return split_thirds(articles).select(key, *carry, F.inline(let(texts, named)))
