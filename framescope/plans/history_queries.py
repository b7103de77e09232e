"""Queries for outlet ratings and the analysis history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope import constants as C
from framescope.functions import urls as U
from framescope.operators import analysis as AN
from framescope.operators import entities as N
from framescope.operators import history as HI
from framescope.operators import ratings as D
from framescope.operators.composite import article_report, engine_scores
from framescope.operators.linear_model import LinearTextModel
from framescope.operators.shaping import extract_fallback, shape_text_articles
from framescope.operators.tfidf import TfidfModel, coefficients_by_index
from framescope.plans import oracle_base as B
from framescope.plans.engine_queries import FRAMED, NER, REPORT_COLUMNS, REPORT_CTES
from framescope.plans.planted import BIAS, WEIGHTS, gazetteer, pick, planted_documents, planted_model
from framescope.plans.registry import query
from framescope.plans.text_queries import FALLBACK_SQL, PAGE_ARTICLES
from framescope.session import materialize, scratch_path
from framescope.sources import history as SH
from framescope.sources import ratings as SR
from framescope.sources import rollups as RO
from framescope.sources.articles import read_articles, read_pages
from framescope.sources.paths import data_version

KNOWN = sorted({r[0] for r in C.GLOBAL_RATINGS} | {r[0] for r in C.REGIONAL_RATINGS})
DOMAINS = [*KNOWN, "unknown-one.test", "unknown-two.test"]
FACTUAL = ["Very High", "High", "Mostly", "Mixed", "Low"]
COUNTRIES = ["US", "UK", "IN"]

# --- rating tables: the built-in outlets and every host of the pages -----------------

_HOST = (
    "regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\\.', '')"
)
_VALUES_A = ", ".join("(" + ", ".join(B.quoted(v) for v in r) + ")" for r in C.GLOBAL_RATINGS)
_VALUES_B = ", ".join(
    "(" + ", ".join(B.quoted(v) if isinstance(v, str) else str(v) for v in r) + ")"
    for r in C.REGIONAL_RATINGS
)
RATINGS = (
    f"hosts AS (SELECT {_HOST} AS host, min(page_id) AS m FROM pages GROUP BY 1),\n"
    f"first_r AS (SELECT * FROM (VALUES {_VALUES_A}) t(domain, leaning, factual, country) UNION ALL "
    f"SELECT CASE WHEN m % 5 = 0 THEN 'www.' || host ELSE host END, {B.pick(C.LEANING_ORDER, 'm')}, {B.pick(FACTUAL, 'm')}, "
    f"{B.pick(COUNTRIES, 'm')} FROM hosts WHERE m % 3 <> 0),\n"
    f"second_r AS (SELECT domain, name, leaning, factual, country, language, region, founded::INT AS founded, type FROM "
    f"(VALUES {_VALUES_B}) t(domain, name, leaning, factual, country, language, region, founded, type) UNION ALL "
    f"SELECT host, upper(host), {B.pick(C.LEANING_ORDER, 'm + 1')}, CASE WHEN m % 2 = 0 THEN NULL ELSE {B.pick(FACTUAL, 'm + 1')} END, "
    f"{B.pick(COUNTRIES, 'm')}, 'English', 'National', (1900 + m % 100)::INT, 'Digital' FROM hosts WHERE m % 3 <> 1),\n"
    f"key_a AS (SELECT regexp_replace(trim(lower(domain)), '^www\\.', '') AS k, * FROM first_r),\n"
    "best_a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY (domain <> k)::INT, domain) AS rn FROM key_a) WHERE rn = 1),\n"
    f"key_b AS (SELECT regexp_replace(trim(lower(domain)), '^www\\.', '') AS k, * FROM second_r),\n"
    "best_b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY (domain <> k)::INT, domain) AS rn FROM key_b) WHERE rn = 1),\n"
    "merged AS (SELECT coalesce(a.k, b.k) AS domain, coalesce(b.leaning, a.leaning) AS leaning, coalesce(b.factual, a.factual) AS factual, "
    "coalesce(b.country, a.country) AS country, b.name, b.language, b.region, b.founded, b.type FROM best_a a FULL OUTER JOIN best_b b ON a.k = b.k),\n"
    "listed AS (SELECT * FROM second_r UNION ALL SELECT domain, NULL, leaning, factual, country, NULL, NULL, NULL, NULL FROM first_r "
    "WHERE domain NOT IN (SELECT domain FROM second_r))"
)


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = U.extract_domain(F.col("url")).alias("host")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.groupBy(host).agg(F.min("page_id").alias("m"))


def first_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("m")
    domain = F.when(m % 5 == 0, F.concat(F.lit("www."), "host")).otherwise(F.col("host"))
    derived = _hosts(spark, sf_dir).filter(m % 3 != 0).select(
        domain.alias("domain"),
        pick(C.LEANING_ORDER, m).alias("leaning"),
        pick(FACTUAL, m).alias("factual"),
        pick(COUNTRIES, m).alias("country"),
    )
    return SR.global_ratings(spark).unionByName(derived)


def second_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("m")
    derived = _hosts(spark, sf_dir).filter(m % 3 != 1).select(
        F.col("host").alias("domain"),
        F.upper("host").alias("name"),
        pick(C.LEANING_ORDER, m + 1).alias("leaning"),
        F.when(m % 2 != 0, pick(FACTUAL, m + 1)).alias("factual"),
        pick(COUNTRIES, m).alias("country"),
        F.lit("English").alias("language"),
        F.lit("National").alias("region"),
        (F.lit(1900) + m % 100).cast("int").alias("founded"),
        F.lit("Digital").alias("type"),
    )
    return SR.regional_ratings(spark).unionByName(derived)


def merged_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.merge_ratings(first_ratings(spark, sf_dir), second_ratings(spark, sf_dir))


def listed_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.list_domains(first_ratings(spark, sf_dir), second_ratings(spark, sf_dir))


_PLANTED_DOMAIN = f"CASE WHEN page_id % 3 = 0 THEN {B.pick(DOMAINS, 'page_id')} ELSE ' WWW.' || {_HOST} END"


def _page_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    host = F.concat(F.lit(" WWW."), U.extract_domain(F.col("url")))
    domain = F.when(page % 3 == 0, pick(DOMAINS, page)).otherwise(host)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", domain.alias("domain"))


@query(
    "normalize_domain",
    f"SELECT page_id, regexp_replace(trim(lower(d)), '^www\\.', '') AS key, replace(d, 'www.', '') AS loose_key "
    f"FROM (SELECT page_id, {_PLANTED_DOMAIN} AS d FROM pages)",
)
def normalize_domain(spark, sf_dir):
    return _page_domains(spark, sf_dir).select(
        "page_id",
        U.normalize_domain(F.col("domain")).alias("key"),
        U.normalize_domain_loose(F.col("domain")).alias("loose_key"),
    )


@query(
    "domain_lookup",
    B.with_ctes(RATINGS)
    + f" SELECT page_id, d AS domain, leaning, factual, country, name, founded::BIGINT AS founded FROM "
    f"(SELECT page_id, {_PLANTED_DOMAIN} AS d FROM pages) p "
    "LEFT JOIN merged m ON m.domain = regexp_replace(trim(lower(d)), '^www\\.', '')",
)
def domain_lookup(spark, sf_dir):
    joined = D.domain_lookup(_page_domains(spark, sf_dir), merged_ratings(spark, sf_dir))
    return joined.select(
        "page_id", "domain", "leaning", "factual", "country", "name",
        F.col("founded").cast("bigint").alias("founded"),
    )


_RATING_COLUMNS = "domain, name, leaning, factual, country, language, region, founded::BIGINT AS founded, type"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(
        "domain", "name", "leaning", "factual", "country", "language", "region",
        F.col("founded").cast("bigint").alias("founded"), "type",
    )


@query("merge_ratings", B.with_ctes(RATINGS) + f" SELECT {_RATING_COLUMNS} FROM merged")
def merge_ratings(spark, sf_dir):
    return _shown(merged_ratings(spark, sf_dir))


@query("list_domains", B.with_ctes(RATINGS) + f" SELECT {_RATING_COLUMNS} FROM listed")
def list_domains(spark, sf_dir):
    return _shown(listed_domains(spark, sf_dir))


@query(
    "filter_domains",
    B.with_ctes(RATINGS)
    + f" SELECT {_RATING_COLUMNS} FROM listed WHERE leaning = 'Center' AND "
    "(contains(lower(domain), 'th') OR contains(lower(coalesce(name, '')), 'th'))",
)
def filter_domains(spark, sf_dir):
    return _shown(D.filter_domains(listed_domains(spark, sf_dir), "Center", "Th"))


_ORDINAL = "list_position(" + B.sql_list(C.LEANING_ORDER) + ", leaning)::BIGINT - 1"


@query(
    "leaning_spectrum",
    B.with_ctes(RATINGS)
    + f" SELECT {_ORDINAL} AS ordinal, leaning, count(*)::BIGINT AS domains FROM listed WHERE {_ORDINAL} >= 0 GROUP BY ALL",
)
def leaning_spectrum(spark, sf_dir):
    return D.leaning_spectrum(listed_domains(spark, sf_dir))


@query(
    "domains_by_leaning",
    B.with_ctes(RATINGS) + f" SELECT {_ORDINAL} AS ordinal, leaning, domain FROM listed WHERE {_ORDINAL} >= 0",
)
def domains_by_leaning(spark, sf_dir):
    return D.domains_by_leaning(listed_domains(spark, sf_dir))


@query("read_ratings", B.with_ctes(RATINGS) + f" SELECT {_RATING_COLUMNS} FROM second_r")
def read_ratings(spark, sf_dir):
    path = scratch_path(spark, "ratings")
    SR.write_ratings(second_ratings(spark, sf_dir), path)
    return _shown(SR.read_ratings(spark, path))


# --- analysis history -----------------------------------------------------------------

_DOMAIN = f"CASE WHEN doc_id % 10 = 0 THEN NULL ELSE {B.pick(DOMAINS, 'doc_id')} END"
HISTORY = (
    f"base AS (SELECT {REPORT_COLUMNS} FROM report JOIN op USING (doc_id)),\n"
    "topw AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, word) AS rn "
    "FROM lexhits WHERE section = 'Full Body' GROUP BY doc_id, word),\n"
    "toplist AS (SELECT doc_id, string_agg(word, ', ' ORDER BY rn) AS top_loaded_words FROM topw WHERE rn <= 6 GROUP BY doc_id),\n"
    f"hist AS (SELECT b.*, {_DOMAIN} AS domain, 'https://www.' || {_DOMAIN} || '/a/' || doc_id AS url, md5(doc_id::VARCHAR) AS id, "
    "CASE WHEN doc_id % 2 = 0 THEN d.source ELSE '' END AS label0, "
    "CASE WHEN doc_id % 19 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_minutes(doc_id) END AS created_at, "
    "coalesce(top_loaded_words, '') AS top_loaded_words, n.total_unique AS ner_entity_count, n.negatively_framed_entities "
    "FROM base b JOIN documents d USING (doc_id) JOIN ner n USING (doc_id) LEFT JOIN toplist USING (doc_id)),\n"
    "log AS (SELECT CASE WHEN word_count % 17 = 0 THEN 'not a date' ELSE strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS timestamp, "
    "CASE WHEN label0 <> '' THEN label0 WHEN url IS NULL THEN 'Raw Text' ELSE split_part(regexp_replace(url, '^https?://(www\\.)?', ''), '/', 1) END AS source_label, "
    "coalesce(url, '') AS url, substr(headline, 1, 200) AS headline, composite_score, verdict, ml_probability, emotion_intensity, subjectivity_score, "
    "passive_score, lexicon_rate AS lexicon_score, loaded_word_count, top_loaded_words, "
    f"{B.round_to('opinion_ratio')} AS opinion_ratio, opinion_label, {B.round_to('quote_ratio')} AS quote_ratio, "
    f"{B.round_to('attribution_ratio')} AS attribution_ratio, hedge_score, hedge_label, ner_entity_count, negatively_framed_entities, word_count, "
    "'{\"beginning\":' || beginning_score || ',\"middle\":' || middle_score || ',\"end\":' || end_score || '}' AS section_breakdown FROM hist)"
)
# The mention fragments need sentences of the body only.
_BODY_MENTIONS = B.MENTIONS.replace("FROM sentrows)", "FROM sentrows WHERE section = 'Full Body')")
HISTORY_CTES = (
    *REPORT_CTES, B.GAZETTEER_TABLE, _BODY_MENTIONS, B.FRAMING, FRAMED, NER, HISTORY
)

_STORED: dict[tuple, tuple[str, str]] = {}
_REPORTS: dict[tuple, DataFrame] = {}


def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the planted articles with the columns a stored analysis needs."""
    key = F.col("doc_id")
    domain = F.when(key % 10 != 0, pick(DOMAINS, key))
    created = F.when(
        key % 19 != 0,
        F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + key * 60),
    )
    origin = {
        "domain": domain,
        "url": F.concat(F.lit("https://www."), domain, F.lit("/a/"), key.cast("string")),
        "id": F.md5(key.cast("string").cast("binary")),
        "source_label": F.when(key % 2 == 0, F.col("source")).otherwise(F.lit("")),
        "created_at": created,
        "scrape_engine": F.lit("text_input"),
    }
    documents = planted_documents(spark, sf_dir).select(
        "doc_id", "text", *[value.alias(name) for name, value in origin.items()]
    )
    ner = N.gazetteer_summary(documents.select("doc_id", "text"), gazetteer(spark)).select(
        "doc_id", F.col("total_unique").alias("ner_entity_count"), "negatively_framed_entities"
    )
    report = article_report(
        shape_text_articles(documents), planted_model(spark, sf_dir), carry=list(origin)
    ).withColumn("top_loaded_words", _top_words())
    return engine_scores(report).join(ner, "doc_id", "left")


def _top_words():
    """Six most frequent loaded words of a report row, ties by word."""
    counted = F.transform(
        "distinct_loaded_words",
        lambda w: F.struct(
            (-F.size(F.filter("loaded_words", lambda x: x == w))).alias("order"), w.alias("word")
        ),
    )
    ranked = F.transform(F.slice(F.array_sort(counted), 1, 6), lambda s: s["word"])
    return F.array_join(ranked, ", ")


def stored_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full report, written once per application."""
    key = data_version(spark, sf_dir)
    if key not in _REPORTS:
        _REPORTS[key] = materialize(full_report(spark, sf_dir), "report")
    return _REPORTS[key]


def stored(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Paths of the stored analyses and of the history log, written once per application."""
    key = data_version(spark, sf_dir)
    if key not in _STORED:
        report = stored_report(spark, sf_dir)
        analyses, log = scratch_path(spark, "analyses"), scratch_path(spark, "log")
        SH.append_analyses(report, analyses)
        SH.append_history_log(report, log)
        _STORED[key] = (analyses, log)
    return _STORED[key]


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SH.read_analyses(spark, stored(spark, sf_dir)[0])


def _with_bad_stamps(log: DataFrame) -> DataFrame:
    """The log with some malformed timestamps planted."""
    bad = F.when(F.col("word_count") % 17 == 0, F.lit("not a date"))
    return log.withColumn("timestamp", F.coalesce(bad, F.col("timestamp")))


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_bad_stamps(spark.read.schema(SH.HISTORY_SCHEMA).parquet(stored(spark, sf_dir)[1]))


# The report of pages: the same steps over other articles.
_PAGE_SHAPED = B.SHAPED.replace(f"{B.strip("split_part(text, '.', 1)")} AS headline, {B.PARAS} AS ps", "page_headline AS headline, page_paras AS ps")
_PAGE_CTES = (
    RATINGS,
    *[{B.PLANTED: PAGE_ARTICLES, B.SHAPED: _PAGE_SHAPED}.get(part, part) for part in (
        *REPORT_CTES, B.GAZETTEER_TABLE, _BODY_MENTIONS, B.FRAMING, FRAMED, NER
    )],
    f"catcounts AS (SELECT doc_id, string_agg(category || '=' || n, ',' ORDER BY category) AS categories FROM "
    "(SELECT doc_id, category, count(*) AS n FROM lexhits WHERE section = 'Full Body' GROUP BY ALL) GROUP BY doc_id),\n"
    f"base AS (SELECT {REPORT_COLUMNS} FROM report JOIN op USING (doc_id))",
)
_ANALYSED_AT = "2024-06-01 12:00:00"


@query(
    "analyze_pages",
    B.with_ctes(*_PAGE_CTES)
    + f" SELECT md5(doc_id || '|' || p.url) AS id, p.url, {_HOST.replace('url', 'p.url')} AS domain, b.headline, body_preview, composite_score, b.verdict, "
    "ml_probability, ml_label, word_count, p.engine AS scrape_engine, m.leaning, m.factual, m.country, n.total_unique AS ner_entity_count, "
    "n.negatively_framed_entities, coalesce(c.categories, '') AS categories "
    "FROM base b JOIN planted p USING (doc_id) JOIN ner n USING (doc_id) LEFT JOIN catcounts c USING (doc_id) "
    f"LEFT JOIN merged m ON m.domain = regexp_replace(trim(lower({_HOST.replace('url', 'p.url')})), '^www\\.', '')",
)
def analyze_pages(spark, sf_dir):
    """Pages to stored analyses, end to end; the model's vocabulary is that of the articles."""
    pages = read_pages(spark, sf_dir)
    bodies = AN.accepted_pages(extract_fallback(pages)).select("page_id", "body_text")
    tfidf = TfidfModel.fit(bodies, "body_text", "page_id")
    model = LinearTextModel(tfidf, coefficients_by_index(tfidf, WEIGHTS), BIAS)
    found = materialize(
        AN.analyze_pages(
            pages, model, gazetteer(spark), merged_ratings(spark, sf_dir), F.lit(_ANALYSED_AT).cast("timestamp")
        ),
        "page-reports",
    )
    path = scratch_path(spark, "page-analyses")
    SH.append_analyses(found, path)
    sizes = F.array_sort(
        F.transform(F.map_entries("category_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    )
    extras = found.select(
        "id", "ner_entity_count", "negatively_framed_entities", F.array_join(sizes, ",").alias("categories")
    )
    return SH.read_analyses(spark, path).join(extras, "id").select(
        "id", "url", "domain", "headline", "body_preview", "composite_score", "verdict",
        "ml_probability", "ml_label", "word_count", "scrape_engine",
        *[F.get_json_object("domain_info", f"$.{n}").alias(n) for n in AN.RATING_FIELDS],
        "ner_entity_count", "negatively_framed_entities", "categories",
    )


@query(
    "rejected_pages",
    f"SELECT page_id, url, error FROM ({FALLBACK_SQL}) JOIN pages USING (page_id) WHERE success = 0",
)
def rejected_pages(spark, sf_dir):
    return AN.rejected_pages(extract_fallback(read_pages(spark, sf_dir)))


_STAMP = "strftime(created_at, '%Y-%m-%d %H:%M:%S')"


def _stamp_text(df: DataFrame, name: str = "created_at") -> DataFrame:
    return df.withColumn(name, F.date_format(name, "yyyy-MM-dd HH:mm:ss"))


@query(
    "append_analyses",
    B.with_ctes(*HISTORY_CTES)
    + f" SELECT id, url, domain, substr(headline, 1, 2000) AS headline, body_preview, composite_score, verdict, ml_probability, ml_label, word_count, "
    f"{_STAMP} AS created_at, 'text_input' AS scrape_engine, 'v2.0' AS analysis_version, headline_score, end_score, lexicon_score FROM hist",
)
def append_analyses(spark, sf_dir):
    return _stamp_text(analyses(spark, sf_dir)).select(
        "id", "url", "domain", "headline", "body_preview", "composite_score", "verdict",
        "ml_probability", "ml_label", "word_count", "created_at", "scrape_engine",
        "analysis_version", "engine_scores.headline_score", "engine_scores.end_score",
        "engine_scores.lexicon_score",
    )


@query("append_history_log", B.with_ctes(*HISTORY_CTES) + " SELECT * FROM log")
def append_history_log(spark, sf_dir):
    return raw_log(spark, sf_dir)


@query("history_row", B.with_ctes(*HISTORY_CTES) + " SELECT * FROM log")
def history_row(spark, sf_dir):
    """All columns of the log, so no engine and no entity is left out."""
    return _with_bad_stamps(HI.history_row(full_report(spark, sf_dir)))


@query(
    "load_history",
    B.with_ctes(*HISTORY_CTES)
    + " SELECT strftime(try_cast(timestamp AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS timestamp, source_label, composite_score FROM log",
)
def load_history(spark, sf_dir):
    path = scratch_path(spark, "loaded-log")
    raw_log(spark, sf_dir).write.parquet(path)
    return _stamp_text(SH.load_history(spark, path), "timestamp").select(
        "timestamp", "source_label", "composite_score"
    )


_PAGE = (
    f" SELECT id, url, domain, substr(headline, 1, 2000) AS headline, composite_score, verdict, ml_label, {_STAMP} AS created_at FROM hist "
    "{where} ORDER BY hist.created_at DESC NULLS LAST, id LIMIT 50 OFFSET 50"
)


@query("history_page", B.with_ctes(*HISTORY_CTES) + _PAGE.format(where=""))
def history_page(spark, sf_dir):
    return _stamp_text(HI.history_page(analyses(spark, sf_dir), page=2, per_page=50))


@query("history_page_after", B.with_ctes(*HISTORY_CTES) + _PAGE.format(where=""))
def history_page_after(spark, sf_dir):
    """The second page, by the last row of the first."""
    stored_rows = analyses(spark, sf_dir)
    last = HI.history_page(stored_rows, page=1, per_page=50).collect()[-1]  # one page
    page = HI.history_page_after(stored_rows, last["created_at"], last["id"], per_page=50)
    return _stamp_text(page)


_VERDICT = "Slightly Opinionated"


@query(
    "history_page_filtered",
    B.with_ctes(*HISTORY_CTES)
    + _PAGE.format(where="WHERE domain = 'cnn.com'").replace("OFFSET 50", "OFFSET 0"),
)
def history_page_filtered(spark, sf_dir):
    page = HI.history_page(analyses(spark, sf_dir), page=1, per_page=50, domain="cnn.com")
    return _stamp_text(page)


@query(
    "history_total",
    B.with_ctes(*HISTORY_CTES)
    + f" SELECT count(*)::BIGINT AS total FROM hist WHERE verdict = '{_VERDICT}'",
)
def history_total(spark, sf_dir):
    return HI.history_total(analyses(spark, sf_dir), verdict=_VERDICT)


@query(
    "history_lookup",
    B.with_ctes(*HISTORY_CTES)
    + f" SELECT id, composite_score, verdict, ml_probability, ml_label, {_STAMP} AS created_at, analysis_version FROM hist WHERE id = md5('7')",
)
def history_lookup(spark, sf_dir):
    found = HI.history_lookup(analyses(spark, sf_dir), "8f14e45fceea167a5a36dedd4bea2543")
    return _stamp_text(found).select(
        "id", "composite_score", "verdict", "ml_probability", "ml_label", "created_at",
        "analysis_version",
    )


_MEAN = "(sum(composite_score::DECIMAL(18,6))::DOUBLE / nullif(count(composite_score), 0))"


@query(
    "source_ranking",
    B.with_ctes(*HISTORY_CTES)
    + f" SELECT source_label, count(*)::BIGINT AS analyses, {_MEAN} AS mean_composite FROM log WHERE source_label IS NOT NULL GROUP BY source_label",
)
def source_ranking(spark, sf_dir):
    return HI.source_ranking(raw_log(spark, sf_dir))


@query(
    "verdict_counts",
    B.with_ctes(*HISTORY_CTES) + " SELECT verdict, count(*)::BIGINT AS n FROM log GROUP BY verdict",
)
def verdict_counts(spark, sf_dir):
    return HI.verdict_counts(raw_log(spark, sf_dir))


_EDGES = (
    "coalesce(strftime(min(try_cast(timestamp AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S'), 'N/A') AS {a}, "
    "coalesce(strftime(max(try_cast(timestamp AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S'), 'N/A') AS {b}"
)


@query(
    "date_range",
    B.with_ctes(*HISTORY_CTES) + f" SELECT {_EDGES.format(a='first', b='last')} FROM log",
)
def date_range(spark, sf_dir):
    return HI.date_range(raw_log(spark, sf_dir))


def _sql_mean(column: str) -> str:
    return B.round_to(f"sum({column}::DECIMAL(18,6))::DOUBLE / nullif(count({column}), 0)")


@query(
    "summary_stats",
    B.with_ctes(*HISTORY_CTES)
    + f", ranked AS (SELECT source_label, {_MEAN} AS m FROM log WHERE source_label IS NOT NULL GROUP BY source_label) "
    f"SELECT count(*)::BIGINT AS total_analyses, {_sql_mean('composite_score')} AS avg_composite, {_sql_mean('ml_probability')} AS avg_ml_prob, "
    f"{_sql_mean('opinion_ratio')} AS avg_opinion_ratio, (SELECT source_label FROM ranked ORDER BY m DESC NULLS LAST, source_label LIMIT 1) AS most_biased_source, "
    f"{_EDGES.format(a='first_analysis', b='last_analysis')} FROM log",
)
def summary_stats(spark, sf_dir):
    return HI.summary_stats(raw_log(spark, sf_dir))


@query(
    "domain_stats",
    B.with_ctes(*HISTORY_CTES, RATINGS)
    + f" SELECT s.domain, total_articles, avg_bias_score, last_updated, leaning, factual, country FROM (SELECT domain, count(*)::BIGINT AS total_articles, "
    f"{_sql_mean('composite_score')} AS avg_bias_score, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_updated FROM hist GROUP BY domain) s "
    "LEFT JOIN merged m ON m.domain = s.domain",
)
def domain_stats(spark, sf_dir):
    stats = HI.domain_stats(analyses(spark, sf_dir), merged_ratings(spark, sf_dir))
    return _stamp_text(stats, "last_updated")


def _kept_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial sums after two arrivals of analyses; the second renewal runs twice, as after a failure."""
    report = stored_report(spark, sf_dir)
    path, sums = scratch_path(spark, "kept-analyses"), scratch_path(spark, "kept-sums")
    for part in (0, 1):
        RO.append_with_sums(report.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == part), path, sums)
    RO.renew_sums(spark, path, sums, [None, *[r[0] for r in RO.read_sums(spark, sums).select("created_date").distinct().collect()]])
    return RO.read_sums(spark, sums)


@query(
    "daily_sums",
    B.with_ctes(*HISTORY_CTES)
    + " SELECT strftime(created_at, '%Y-%m-%d') AS created_date, domain, verdict, count(*)::BIGINT AS n, "
    "sum(composite_score::DECIMAL(18,6))::DOUBLE AS composite_sum, count(composite_score)::BIGINT AS composite_n, "
    "strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_at "
    "FROM hist GROUP BY 1, 2, 3",
)
def daily_sums(spark, sf_dir):
    sums = _kept_sums(spark, sf_dir)
    sums = _stamp_text(_stamp_text(sums, "first_at"), "last_at")
    return sums.select(
        F.date_format("created_date", "yyyy-MM-dd").alias("created_date"), "domain", "verdict", "n",
        F.col("composite_sum").cast("double").alias("composite_sum"), "composite_n", "first_at", "last_at",
    )


@query(
    "domain_stats_kept",
    B.with_ctes(*HISTORY_CTES, RATINGS)
    + f" SELECT s.domain, total_articles, avg_bias_score, last_updated, leaning, factual, country FROM (SELECT domain, count(*)::BIGINT AS total_articles, "
    f"{_sql_mean('composite_score')} AS avg_bias_score, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_updated FROM hist GROUP BY domain) s "
    "LEFT JOIN merged m ON m.domain = s.domain",
)
def domain_stats_kept(spark, sf_dir):
    """The same statistics from partial sums alone."""
    return _stamp_text(RO.domain_stats_of(_kept_sums(spark, sf_dir), merged_ratings(spark, sf_dir)), "last_updated")


@query(
    "read_articles",
    "SELECT 'doc-' || doc_id AS article_id, "
    f"{B.strip('''split_part(text, '.', 1)''')} AS headline, {B.word_count('text')}::BIGINT AS word_count, 'text_input' AS engine, "
    "md5(text) AS body_md5, NULL AS domain FROM documents "
    "UNION ALL SELECT 'page-' || page_id, headline, word_count, engine, md5(body_text), domain FROM (SELECT f.*, h.domain FROM ("
    + FALLBACK_SQL
    + f") f JOIN (SELECT page_id, {_HOST} AS domain FROM pages) h USING (page_id))",
)
def articles(spark, sf_dir):
    return read_articles(spark, sf_dir).select(
        "article_id", "headline", "word_count", "engine",
        F.md5(F.col("body_text").cast("binary")).alias("body_md5"), "domain",
    )
