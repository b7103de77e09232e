"""Queries for the text layer: extraction, tokens, sentences, buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope import constants as C
from framescope.functions import html as H
from framescope.functions import labels as L
from framescope.functions import text as X
from framescope.functions import urls as U
from framescope.operators import shaping as S
from framescope.operators.tfidf import word_ngrams
from framescope.plans import oracle_base as B
from framescope.plans.planted import planted_articles, planted_documents
from framescope.plans.registry import query
from framescope.sources.articles import read_pages

# --- pages -----------------------------------------------------------------

_ODD_URL = (
    "CASE WHEN page_id % 10 = 0 THEN replace(url, '://', '') "
    "WHEN page_id % 10 = 1 THEN replace(url, '://', '://www.') "
    "WHEN page_id % 10 = 2 THEN '  ' WHEN page_id % 10 = 3 THEN replace(url, '://', '://WWW.User:x@') "
    "WHEN page_id % 10 = 4 THEN replace(url, 'https:', '') ELSE url END"
)


def _odd_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, sf_dir).select("page_id", F.expr(_ODD_URL).alias("url"))


@query(
    "valid_url",
    f"SELECT page_id, regexp_matches(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+')::BIGINT AS valid "
    f"FROM (SELECT page_id, {_ODD_URL} AS u FROM pages)",
)
def valid_url(spark, sf_dir):
    valid = U.valid_url(F.col("url")).cast("bigint").alias("valid")
    return _odd_urls(spark, sf_dir).select("page_id", valid)


@query(
    "extract_domain",
    "SELECT page_id, regexp_replace(lower(regexp_extract(u, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)), "
    f"'^www\\.', '') AS domain FROM (SELECT page_id, {_ODD_URL} AS u FROM pages)",
)
def extract_domain(spark, sf_dir):
    return _odd_urls(spark, sf_dir).select(
        "page_id", U.extract_domain(F.col("url")).alias("domain")
    )


@query(
    "infer_source",
    "SELECT page_id, CASE WHEN trim(u) = '' THEN 'Raw Text' "
    "WHEN split_part(regexp_replace(u, '^https?://(www\\.)?', ''), '/', 1) = '' THEN 'Unknown' "
    "ELSE split_part(regexp_replace(u, '^https?://(www\\.)?', ''), '/', 1) END AS source "
    f"FROM (SELECT page_id, {_ODD_URL} AS u FROM pages)",
)
def infer_source(spark, sf_dir):
    return _odd_urls(spark, sf_dir).select(
        "page_id", U.infer_source(F.col("url")).alias("source")
    )


def _sql_boilerplate(e: str) -> str:
    for tag in C.BOILERPLATE_TAGS:
        e = f"regexp_replace({e}, '(?is)<{tag}\\b.*?</{tag}\\s*>', '', 'g')"
    return e


# The references that occur in the pages.
_ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"),
    ("&hellip;", "…"), ("&amp;", "&"),
]


def _sql_entities(e: str) -> str:
    for entity, char in _ENTITIES:
        e = f"replace({e}, {B.quoted(entity)}, {B.quoted(char)})"
    return e


def _sql_inner(e: str) -> str:
    plain = f"regexp_replace({e}, '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')"
    return B.strip(f"regexp_replace({_sql_entities(plain)}, '[{B.WS}]+', ' ', 'g')")


_CLEAN = f"clean AS (SELECT page_id, url, html, {_sql_boilerplate('html')} AS c FROM pages)"
_H1 = _sql_inner("regexp_extract(c, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1)")
_TITLE = _sql_inner("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)")
_SEGMENT = _sql_inner(f"string_split_regex(q, {B.quoted(H._BLOCK_END)})[1]")
_PARAGRAPHS = (
    f"paras0 AS (SELECT page_id, url, html, c, list_transform(string_split_regex(c, '(?i)<p(?:\\s[^>]*)?>')[2:], "
    f"lambda q: {_SEGMENT}) AS raw FROM clean),\n"
    f"paras AS (SELECT page_id, url, html, c, list_filter(raw, lambda q: {B.word_count('q')} >= 5 AND NOT "
    f"regexp_matches(lower(q), '{'|'.join(C.SKIP_PHRASES)}')) AS ps FROM paras0)"
)
_PARA_BODY = (
    f"pbody AS (SELECT page_id, url, html, {_H1} AS headline, ps, array_to_string(ps, ' ') AS body, "
    f"{B.word_count('''array_to_string(ps, ' ')''')}::BIGINT AS wc FROM paras)"
)
_LINE_TAGS = B.quoted(S._LINE_TAGS)
_PAGE_TEXT = _sql_entities(
    "regexp_replace(regexp_replace(regexp_replace(c, '(?is)<title\\b.*?</title\\s*>', '', 'g'), "
    f"{_LINE_TAGS}, chr(10), 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')"
)
_LINES = (
    f"ptext AS (SELECT page_id, {_PAGE_TEXT} AS t FROM clean),\n"
    f"lines0 AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda q: {B.strip('q')}), "
    f"lambda q: {B.word_count('q')} >= 5) AS l, {B.word_count('t')} AS raw_words FROM ptext),\n"
    "lines1 AS (SELECT page_id, CASE WHEN raw_words > 30 THEN l ELSE [] END AS ls FROM lines0),\n"
    "lbody AS (SELECT page_id, ls, array_to_string(ls, ' ') AS line_text, "
    f"{B.word_count('''array_to_string(ls, ' ')''')}::BIGINT AS line_words FROM lines1)"
)


@query(
    "strip_boilerplate",
    B.with_ctes(_CLEAN)
    + " SELECT page_id, length(c)::BIGINT AS kept_chars, md5(c) AS kept_md5 FROM clean",
)
def strip_boilerplate(spark, sf_dir):
    clean = H.strip_boilerplate(F.col("html"))
    return (
        read_pages(spark, sf_dir)
        .select("page_id", clean.alias("c"))
        .select(
            "page_id",
            F.length("c").cast("bigint").alias("kept_chars"),
            F.md5(F.col("c").cast("binary")).alias("kept_md5"),
        )
    )


@query("extract_headline", B.with_ctes(_CLEAN) + f" SELECT page_id, {_H1} AS headline FROM clean")
def extract_headline(spark, sf_dir):
    headline = H.extract_headline(H.strip_boilerplate(F.col("html"))).alias("headline")
    return read_pages(spark, sf_dir).select("page_id", headline)


@query(
    "extract_paragraphs",
    B.with_ctes(_CLEAN, _PARAGRAPHS)
    + " SELECT page_id, (generate_subscripts(ps, 1) - 1)::BIGINT AS position, unnest(ps) AS paragraph FROM paras",
)
def extract_paragraphs(spark, sf_dir):
    paragraphs = H.extract_paragraphs(H.strip_boilerplate(F.col("html")))
    return (
        read_pages(spark, sf_dir)
        .select("page_id", F.posexplode(paragraphs).alias("position", "paragraph"))
        .withColumn("position", F.col("position").cast("bigint"))
    )


@query(
    "assemble_body",
    B.with_ctes(_CLEAN, _PARAGRAPHS, _PARA_BODY)
    + " SELECT page_id, body AS body_text, wc AS word_count, (wc > 20)::BIGINT AS body_ok FROM pbody",
)
def assemble_body(spark, sf_dir):
    return S.extract_paragraph_article(read_pages(spark, sf_dir)).select(
        "page_id", "body_text", "word_count", F.col("body_ok").cast("bigint").alias("body_ok")
    )


@query(
    "extract_lines",
    B.with_ctes(_CLEAN, _LINES)
    + " SELECT page_id, line_text, line_words, len(ls)::BIGINT AS line_count FROM lbody",
)
def extract_lines(spark, sf_dir):
    pages = read_pages(spark, sf_dir).select("page_id", S.page_text(F.col("html")).alias("text"))
    return S.extract_line_article(pages).select(
        "page_id", "line_text", "line_words",
        F.size("line_paras").cast("bigint").alias("line_count"),
    )


_FALLBACK = B.with_ctes(_CLEAN, _PARAGRAPHS, _PARA_BODY, _LINES) + (
    ", tried AS (SELECT p.page_id, url, headline, body, wc, line_text, line_words, "
    f"{_TITLE} AS title, regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+') AS ok "
    "FROM pbody p JOIN lbody l USING (page_id)), "
    "chosen AS (SELECT *, CASE WHEN ok AND {first} THEN '{a}' WHEN ok AND {second} THEN '{b}' ELSE 'none' END AS engine FROM tried) "
    "SELECT page_id, engine, CASE engine WHEN 'lines' THEN title WHEN 'paragraphs' THEN headline ELSE '' END AS headline, "
    "CASE engine WHEN 'lines' THEN line_text WHEN 'paragraphs' THEN body ELSE '' END AS body_text, "
    "CASE engine WHEN 'lines' THEN line_words WHEN 'paragraphs' THEN wc ELSE 0 END AS word_count, "
    "(engine <> 'none')::BIGINT AS success, CASE WHEN NOT ok THEN '{bad}' WHEN engine = 'none' THEN '{none}' ELSE '' END AS error FROM chosen"
)
_GATES = {"lines": "line_words > 30", "paragraphs": "wc > 30"}


def _fallback_sql(first: str, second: str) -> str:
    text = _FALLBACK
    for name, value in {
        "first": _GATES[first], "second": _GATES[second], "a": first, "b": second,
        "bad": C.INVALID_URL_ERROR, "none": C.NO_TEXT_ERROR,
    }.items():
        text = text.replace("{" + name + "}", value)
    return text


def _fallback(spark, sf_dir, order) -> DataFrame:
    return S.extract_fallback(read_pages(spark, sf_dir), order=order).select(
        "page_id", "engine", "headline", "body_text", "word_count",
        F.col("success").cast("bigint").alias("success"), "error",
    )


FALLBACK_SQL = _fallback_sql("lines", "paragraphs")
# Accepted pages as articles, under the names that the report of documents uses.
PAGE_ARTICLES = (
    "planted AS (SELECT page_id AS doc_id, url, engine, headline AS page_headline, body_text AS text, page_paras FROM ("
    + FALLBACK_SQL.replace("line_text, line_words, ", "line_text, line_words, ps, ls, ").replace(
        " AS success, ", " AS success, url, CASE engine WHEN 'lines' THEN ls ELSE ps END AS page_paras, "
    )
    + ") WHERE success = 1)"
)


@query("extract_fallback", FALLBACK_SQL)
def extract_fallback(spark, sf_dir):
    return _fallback(spark, sf_dir, ("lines", "paragraphs"))


@query("extract_fallback_paragraphs_first", _fallback_sql("paragraphs", "lines"))
def extract_fallback_paragraphs_first(spark, sf_dir):
    return _fallback(spark, sf_dir, ("paragraphs", "lines"))


# --- raw texts ----------------------------------------------------------------


@query(
    "validate_article",
    f"SELECT conv_id, turn, {B.strip('text')} AS text, ({B.word_count('text')} >= 10)::BIGINT AS accepted, "
    f"CASE WHEN {B.word_count('text')} >= 10 THEN '' ELSE 'Text must be at least 10 words.' END AS reject_reason "
    "FROM conversations",
)
def validate_article(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return S.validate_texts(turns).withColumn("accepted", F.col("accepted").cast("bigint"))


@query(
    "validate_url",
    f"SELECT page_id, {B.strip('u')} AS url, ({B.strip('u')} <> '')::BIGINT AS accepted, "
    f"CASE WHEN {B.strip('u')} <> '' THEN '' ELSE 'URL cannot be empty.' END AS reject_reason "
    f"FROM (SELECT page_id, {_ODD_URL} AS u FROM pages)",
)
def validate_url(spark, sf_dir):
    return S.validate_urls(_odd_urls(spark, sf_dir)).withColumn(
        "accepted", F.col("accepted").cast("bigint")
    )


@query(
    "default_headline",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Given headline' ELSE "
    + B.strip("split_part(text, '.', 1)")
    + " END AS headline FROM documents",
)
def default_headline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = F.when(F.col("doc_id") % 2 == 0, F.lit("Given headline")).otherwise(F.lit(""))
    return docs.select("doc_id", X.default_headline(given, F.col("text")).alias("headline"))


@query(
    "split_paragraphs",
    B.with_ctes(B.PLANTED, B.SHAPED)
    + " SELECT doc_id, (generate_subscripts(ps, 1) - 1)::BIGINT AS position, unnest(ps) AS paragraph FROM shaped",
)
def split_paragraphs(spark, sf_dir):
    return (
        planted_articles(spark, sf_dir)
        .select("doc_id", F.posexplode("body_paras").alias("position", "paragraph"))
        .withColumn("position", F.col("position").cast("bigint"))
    )


@query(
    "split_thirds",
    B.with_ctes(B.PLANTED, B.SHAPED)
    + ' SELECT doc_id, beginning, middle, "end" AS ending FROM thirds',
)
def split_thirds(spark, sf_dir):
    return S.split_thirds(planted_articles(spark, sf_dir)).select(
        "doc_id", "beginning", "middle", F.col("end").alias("ending")
    )


@query(
    "explode_sections",
    B.with_ctes(B.PLANTED, B.SHAPED, B.SECTIONS_AS_S)
    + f" SELECT doc_id, section, length(text)::BIGINT AS chars, {B.word_count('text')}::BIGINT AS words FROM s",
)
def explode_sections(spark, sf_dir):
    return S.explode_sections(planted_articles(spark, sf_dir)).select(
        "doc_id", "section",
        F.length("section_text").cast("bigint").alias("chars"),
        X.word_count("section_text").cast("bigint").alias("words"),
    )


@query(
    "previews",
    "SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS text_preview, "
    "substr(text, 1, 500) AS body_preview FROM documents",
)
def previews(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        "doc_id",
        X.preview("text").alias("text_preview"),
        F.substring("text", 1, 500).alias("body_preview"),
    )


# --- tokens and sentences ---------------------------------------------------------


def _array_query(name: str, sql_expr: str, build) -> None:
    """Length, distinct members and an order-sensitive digest of an array per document."""
    sql = B.with_ctes(B.PLANTED) + (
        f" SELECT doc_id, len(l)::BIGINT AS n, len(list_distinct(l))::BIGINT AS n_distinct, "
        f"md5(array_to_string(l, '|')) AS digest FROM (SELECT doc_id, {sql_expr} AS l FROM planted)"
    )

    @query(name, sql)
    def run(spark, sf_dir):
        return (
            planted_documents(spark, sf_dir)
            .select("doc_id", build("text").alias("l"))
            .select(
                "doc_id",
                F.size("l").cast("bigint").alias("n"),
                F.size(F.array_distinct("l")).cast("bigint").alias("n_distinct"),
                F.md5(F.array_join("l", "|").cast("binary")).alias("digest"),
            )
        )


_array_query("tokenize", B.tokens("text"), X.tokenize)
_array_query("raw_words", B.raw_words("text"), X.raw_words)
_array_query("split_sentences", B.sentences("text"), X.split_sentences)
_array_query("split_sentences_abbrev", B.sentences_abbrev("text"), X.split_sentences_abbrev)
_array_query("split_fragments", B.fragments("text"), X.split_fragments)


@query(
    "word_ngrams",
    B.with_ctes(B.PLANTED, B.grams("planted", "g", "doc_id"))
    + " SELECT term, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs FROM g GROUP BY term",
)
def ngrams(spark, sf_dir):
    from framescope.operators.tfidf import term_counts

    return (
        term_counts(planted_documents(spark, sf_dir))
        .groupBy("term")
        .agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("docs"))
    )


@query(
    "word_bigrams_per_document",
    B.with_ctes(B.PLANTED, f"t AS (SELECT doc_id, {B.vector_tokens('text')} AS t FROM planted)")
    + " SELECT doc_id, len(t)::BIGINT AS unigrams, greatest(len(t) - 1, 0)::BIGINT AS bigrams FROM t",
)
def word_bigrams_per_document(spark, sf_dir):
    docs = planted_documents(spark, sf_dir).select("doc_id", "text")
    one = word_ngrams(docs, "text", 1, 1, "one")
    return word_ngrams(one, "text", 2, 2, "two").select(
        "doc_id",
        F.size("one").cast("bigint").alias("unigrams"),
        F.size("two").cast("bigint").alias("bigrams"),
    )


# --- buckets --------------------------------------------------------------------------
# Scores are the event values scaled to [0, 1), rounded to two digits so that cuts are hit exactly.

_SCORE = "(floor(value * 7)::BIGINT % 101) / 100e0"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    score = F.pmod(F.floor(F.col("value") * 7), F.lit(101)) / F.lit(100.0)
    return events.select("event_id", score.alias("score"))


def _bucket_query(name: str, sql_cases: dict[str, str], build) -> None:
    columns = ", ".join(f"{sql} AS {alias}" for alias, sql in sql_cases.items())
    sql = f"SELECT event_id, {columns} FROM (SELECT event_id, {_SCORE} AS score FROM events)"

    @query(name, sql)
    def run(spark, sf_dir):
        built = build(F.col("score"))
        return _scores(spark, sf_dir).select(
            "event_id", *[column.alias(alias) for alias, column in built.items()]
        )


_bucket_query(
    "verdict",
    {
        "verdict": B.bucket("score", C.VERDICT_CUTS, C.VERDICT_LABELS),
        "color": B.bucket("score", C.VERDICT_CUTS, C.VERDICT_COLORS),
        "emoji": B.bucket("score", C.VERDICT_CUTS, C.VERDICT_EMOJI),
    },
    lambda s: {"verdict": L.verdict(s), "color": L.verdict_color(s), "emoji": L.verdict_emoji(s)},
)
_bucket_query(
    "lexicon_label",
    {"label": B.lexicon_label("(score / 8e0)", "(event_id % 50)")},
    lambda s: {"label": L.lexicon_label(s / F.lit(8.0), F.col("event_id") % 50)},
)
_bucket_query(
    "hedge_label",
    {"label": B.hedge_label("score", "event_id % 50 = 0")},
    lambda s: {"label": L.hedge_label(s, F.col("event_id") % 50 == 0)},
)
_bucket_query(
    "passive_label",
    {
        "label": "CASE WHEN event_id % 50 = 0 THEN 'N/A' ELSE "
        + B.bucket("score", C.PASSIVE_CUTS, C.PASSIVE_LABELS) + " END"
    },
    lambda s: {"label": L.passive_label(s, F.col("event_id") % 50 == 0)},
)
_bucket_query(
    "subjectivity_label",
    {"label": B.bucket("score", C.SUBJECTIVITY_CUTS, C.SUBJECTIVITY_LABELS)},
    lambda s: {"label": L.subjectivity_label(s)},
)
_bucket_query(
    "emotion_label",
    {
        "label": B.bucket("score", C.EMOTION_CUTS, C.EMOTION_LABELS),
        "sentiment": "CASE WHEN score - 0.5e0 >= 0.05e0 THEN 'Positive' "
        "WHEN score - 0.5e0 <= -0.05e0 THEN 'Negative' ELSE 'Neutral' END",
    },
    lambda s: {"label": L.emotion_label(s), "sentiment": L.sentiment(s - F.lit(0.5))},
)
_bucket_query(
    "opinion_label",
    {"label": B.bucket("score", C.OPINION_CUTS, C.OPINION_LABELS)},
    lambda s: {"label": L.opinion_label(s, F.lit(False))},
)
_bucket_query(
    "gauge_bin",
    {
        "gauge": B.bucket("score", C.VERDICT_CUTS, C.GAUGE_LABELS, "<="),
        "band": B.bucket("score", C.BAND_CUTS, C.BAND_LABELS),
    },
    lambda s: {"gauge": L.gauge_bin(s), "band": L.score_band(s)},
)
_bucket_query(
    "frame_label",
    {
        "label": "CASE WHEN floor(score * 5) - 2 > 0 THEN 'Positive Framing' "
        "WHEN floor(score * 5) - 2 < 0 THEN 'Negative Framing' ELSE 'Neutral Framing' END"
    },
    lambda s: {"label": L.frame_label(F.floor(s * 5.0) - 2)},
)
_bucket_query(
    "ml_label",
    {
        "label": "(score >= 0.5e0)::BIGINT",
        "label_name": "CASE WHEN score >= 0.5e0 THEN 'Biased' ELSE 'Neutral' END",
    },
    lambda s: {
        "label": L.ml_label(s).cast("bigint"),
        "label_name": L.ml_label_name(L.ml_label(s)),
    },
)

LEANINGS = ["Left", "Lean Left ", "Center", "lean right", " RIGHT", "Mixed", "unknown"]


@query(
    "leaning_to_label",
    f"SELECT doc_id, CASE lower(trim(l)) WHEN 'left' THEN 1 WHEN 'lean left' THEN 1 WHEN 'center' THEN 0 "
    f"WHEN 'lean right' THEN 1 WHEN 'right' THEN 1 ELSE -1 END::BIGINT AS label "
    f"FROM (SELECT doc_id, {B.pick(LEANINGS, 'n_chars')} AS l FROM documents)",
)
def leaning_to_label(spark, sf_dir):
    from framescope.plans.planted import pick

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        "doc_id",
        L.leaning_to_label(pick(LEANINGS, F.col("n_chars"))).cast("bigint").alias("label"),
    )
