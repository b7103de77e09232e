"""Queries for corpora, TF-IDF, evaluation and exploration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope import constants as C
from framescope.functions.numeric import round_to
from framescope.operators import corpus as G
from framescope.operators import explore as XP
from framescope.operators import metrics as M
from framescope.operators import tfidf as T
from framescope.operators.features import linguistic_features
from framescope.operators.sentiment import auxiliary_scores
from framescope.plans import oracle_base as B
from framescope.plans.engine_queries import FEATURES
from framescope.plans.planted import (
    BIAS,
    WEIGHTS,
    fitted_tfidf,
    labelled_documents,
    pick,
    planted_documents,
    predictions,
)
from framescope.plans.registry import query
from framescope.plans.text_queries import LEANINGS
from framescope.session import scratch_path
from framescope.sources import corpora as SC

# --- reading and preparing corpora ---------------------------------------------------

_RAW_LABEL = (
    "CASE WHEN d.doc_id % 13 = 0 THEN '2' WHEN d.doc_id % 17 = 0 THEN NULL WHEN d.doc_id % 5 = 0 THEN (1 - l.quality) || '.0' "
    "ELSE (1 - l.quality)::VARCHAR END"
)
_RAW_TEXT = "CASE WHEN d.doc_id % 11 = 0 THEN '  ' WHEN d.doc_id % 23 = 0 THEN NULL ELSE d.text END"
_BASE_SQL = (
    f"raw AS (SELECT d.doc_id, {_RAW_TEXT} AS text, {_RAW_LABEL} AS label, 'documents' AS source FROM documents d JOIN labels l USING (doc_id))"
)


def raw_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").alias("d")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").alias("l")
    joined = docs.join(labels, "doc_id")
    label = F.expr(
        "CASE WHEN doc_id % 13 = 0 THEN '2' WHEN doc_id % 17 = 0 THEN NULL "
        "WHEN doc_id % 5 = 0 THEN concat(1 - quality, '.0') ELSE string(1 - quality) END"
    )
    text = F.expr("CASE WHEN doc_id % 11 = 0 THEN '  ' WHEN doc_id % 23 = 0 THEN NULL ELSE text END")
    return joined.select(
        "doc_id", text.alias("text"), label.alias("label"), F.lit("documents").alias("source")
    )


@query(
    "read_labeled_corpus",
    B.with_ctes(_BASE_SQL)
    + f" SELECT doc_id, md5({B.strip('text')}) AS text_md5, label::DOUBLE::BIGINT AS label FROM raw "
    f"WHERE text IS NOT NULL AND label IS NOT NULL AND {B.word_count('text')} >= 5",
)
def read_labeled_corpus(spark, sf_dir):
    path = scratch_path(spark, "corpus")
    SC.write_corpus(raw_corpus(spark, sf_dir), path)
    read = SC.read_labeled_corpus(spark, f"{path}-missing", fallback=path, min_words=5)
    return read.select(
        "doc_id",
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
        F.col("label").cast("bigint").alias("label"),
    )


@query(
    "discover_columns",
    f"SELECT conv_id, turn, md5(text) AS text_md5, {B.pick(LEANINGS, 'conv_id + turn')} AS raw_label FROM conversations",
)
def discover_columns(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    named = turns.select(
        "conv_id",
        "turn",
        F.col("text").alias("Content"),
        pick(LEANINGS, F.col("conv_id") + F.col("turn")).alias("Political_Leaning"),
    )
    return SC.discover_columns(named, keep=("conv_id", "turn")).select(
        "conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("text_md5"), "raw_label"
    )


_CLEAN = (
    f"cleaned AS (SELECT doc_id, text, label::DOUBLE::BIGINT AS label FROM raw WHERE text IS NOT NULL AND {B.strip('text')} <> '' "
    "AND label::DOUBLE IN (0, 1))"
)


def base_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.clean_dataset(raw_corpus(spark, sf_dir), keep=("doc_id",))


@query(
    "clean_dataset",
    B.with_ctes(_BASE_SQL, _CLEAN) + " SELECT doc_id, md5(text) AS text_md5, label FROM cleaned",
)
def clean_dataset(spark, sf_dir):
    return base_corpus(spark, sf_dir).select(
        "doc_id",
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
        F.col("label").cast("bigint").alias("label"),
    )


_LEAN = B.pick(LEANINGS, "conv_id + turn")
_LEANING_SQL = (
    f"leaning AS (SELECT conv_id * 1000 + turn AS row_id, text, CASE lower(trim({_LEAN})) WHEN 'center' THEN 0 ELSE 1 END::BIGINT AS label, "
    f"'conversations' AS source FROM conversations WHERE lower(trim({_LEAN})) IN ('left', 'lean left', 'center', 'lean right', 'right'))"
)


def leaning_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        "text",
        pick(LEANINGS, F.col("conv_id") + F.col("turn")).alias("leaning"),
    )
    return G.map_leaning_labels(turns, "leaning", "conversations", keep=("row_id",))


@query(
    "map_leaning_labels",
    B.with_ctes(_LEANING_SQL) + " SELECT row_id, label, source FROM leaning",
)
def map_leaning_labels(spark, sf_dir):
    return leaning_corpus(spark, sf_dir).select(
        "row_id", F.col("label").cast("bigint").alias("label"), "source"
    )


@query(
    "length_filter",
    f"SELECT conv_id, turn FROM conversations WHERE {B.word_count('text')} BETWEEN 5 AND 100",
)
def length_filter(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return G.length_filter(turns, 5, 100).drop("text")


# Documents are in the corpus twice, once in capitals under another id, so that copies exist. Only
# ASCII letters are changed: the engines disagree on the capital of a sharp s.
_SMALL = "abcdefghijklmnopqrstuvwxyz"
_LARGE = _SMALL.upper()
_MERGED = (
    f"merged AS (SELECT 0 AS priority, row_id, {B.strip('text')} AS text, label, source FROM "
    "(SELECT doc_id AS row_id, text, label, 'documents' AS source FROM cleaned) "
    f"UNION ALL SELECT 1, row_id, {B.strip('text')}, label, source FROM leaning "
    f"UNION ALL SELECT 2, doc_id, {B.strip(f"translate(text, '{_SMALL}', '{_LARGE}')")}, 0, 'copies' FROM documents)"
)


def _frames(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    base = base_corpus(spark, sf_dir).select(
        F.col("doc_id").alias("row_id"), "text", "label", F.lit("documents").alias("source")
    )
    copies = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("row_id"),
        F.translate("text", _SMALL, _LARGE).alias("text"),
        F.lit(0).alias("label"),
        F.lit("copies").alias("source"),
    )
    return [base, leaning_corpus(spark, sf_dir), copies]


_CORPUS = (_BASE_SQL, _CLEAN, _LEANING_SQL, _MERGED)


@query(
    "merge_corpora",
    B.with_ctes(*_CORPUS)
    + " SELECT priority::BIGINT AS priority, row_id, md5(text) AS text_md5, label, source FROM merged",
)
def merge_corpora(spark, sf_dir):
    return G.merge_corpora(_frames(spark, sf_dir)).select(
        F.col("priority").cast("bigint").alias("priority"),
        "row_id",
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
        F.col("label").cast("bigint").alias("label"),
        "source",
    )


_DEDUP = (
    f"longer AS (SELECT * FROM merged WHERE {B.word_count('text')} >= 5),\n"
    "deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY priority, row_id) AS rn FROM longer) WHERE rn = 1)"
)


@query(
    "dedup_text",
    B.with_ctes(*_CORPUS, _DEDUP)
    + " SELECT priority::BIGINT AS priority, row_id, label, source FROM deduped",
)
def dedup_text(spark, sf_dir):
    return G.build_corpus(_frames(spark, sf_dir)).select(
        F.col("priority").cast("bigint").alias("priority"),
        "row_id",
        F.col("label").cast("bigint").alias("label"),
        "source",
    )


@query(
    "write_corpus",
    B.with_ctes(*_CORPUS, _DEDUP)
    + " SELECT row_id, md5(text) AS text_md5, label, source FROM deduped",
)
def write_corpus(spark, sf_dir):
    path = scratch_path(spark, "merged")
    corpus = G.build_corpus(_frames(spark, sf_dir)).select("row_id", "text", "label", "source")
    SC.write_corpus(corpus, path)
    schema = "row_id bigint, text string, label string, source string"
    return SC.read_labeled_corpus(spark, path, schema=schema).select(
        "row_id",
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
        F.col("label").cast("bigint").alias("label"),
        "source",
    )


@query(
    "corpus_summary",
    B.with_ctes(*_CORPUS, _DEDUP)
    + " SELECT 'total' AS dimension, 'all' AS value, count(*)::BIGINT AS row_count FROM deduped "
    "UNION ALL SELECT 'label', label::VARCHAR, count(*) FROM deduped GROUP BY label "
    "UNION ALL SELECT 'source', source, count(*) FROM deduped GROUP BY source",
)
def corpus_summary(spark, sf_dir):
    return G.corpus_summary(G.build_corpus(_frames(spark, sf_dir)))


RANKED = (
    "ranked AS (SELECT doc_id, toxic::BIGINT AS label, row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || doc_id), doc_id) AS r, "
    "count(*) OVER (PARTITION BY toxic) AS n FROM labels)"
)


def _label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select("doc_id", F.col("toxic").cast("bigint").alias("label"))


@query(
    "stratified_split",
    B.with_ctes(RANKED)
    + " SELECT doc_id, label, CASE WHEN r <= floor(n * 0.2e0 + 0.5e0) THEN 'test' ELSE 'train' END AS split FROM ranked",
)
def stratified_split(spark, sf_dir):
    return G.stratified_split(_label_rows(spark, sf_dir))


@query(
    "stratified_folds",
    B.with_ctes(RANKED) + " SELECT doc_id, label, ((r - 1) % 5)::BIGINT AS fold FROM ranked",
)
def stratified_folds(spark, sf_dir):
    folds = G.stratified_folds(_label_rows(spark, sf_dir))
    return folds.withColumn("fold", F.col("fold").cast("bigint"))


@query(
    "class_weights",
    "SELECT toxic::BIGINT AS label, count(*)::BIGINT AS class_count, "
    "(SELECT count(*) FROM labels)::DOUBLE / ((SELECT count(DISTINCT toxic) FROM labels)::DOUBLE * count(*)) AS weight FROM labels GROUP BY toxic",
)
def class_weights(spark, sf_dir):
    return G.class_weights(_label_rows(spark, sf_dir))


# --- TF-IDF ------------------------------------------------------------------------------

_TFIDF = (
    B.PLANTED, B.VOCABULARY,
    "traw AS (SELECT doc_id, term, tf, (1e0 + ln(tf::DOUBLE)) * idf AS raw, idf FROM dcounts JOIN vocab USING (term)),\n"
    "tfidf AS (SELECT doc_id, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM traw)",
)


def _tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tfidf(planted_documents(spark, sf_dir).select("doc_id", "text"))


@query(
    "tfidf",
    B.with_ctes(*_TFIDF)
    + f" SELECT term, count(*)::BIGINT AS docs, sum(tf)::BIGINT AS total, {B.round_to('sum(weight)', 5)} AS weight_sum, "
    f"{B.round_to('max(weight)', 6)} AS weight_max FROM tfidf GROUP BY term",
)
def tfidf(spark, sf_dir):
    return _tfidf(spark, sf_dir).groupBy("term").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum("tf").alias("total"),
        round_to(F.sum("weight"), 5).alias("weight_sum"),
        round_to(F.max("weight"), 6).alias("weight_max"),
    )


@query(
    "tfidf_rows",
    B.with_ctes(*_TFIDF)
    + f" SELECT doc_id, count(*)::BIGINT AS terms, {B.round_to('sum(weight)', 5)} AS weight_sum, "
    f"{B.round_to('sum(weight * weight)', 6)} AS squared_norm FROM tfidf GROUP BY doc_id",
)
def tfidf_rows(spark, sf_dir):
    """The row-local transform of the fitted vocabulary."""
    docs = planted_documents(spark, sf_dir).select("doc_id", "text")
    weighed = fitted_tfidf(spark, sf_dir).weigh(docs, "text", "w")

    def total(body):
        return F.aggregate("w", F.lit(0.0), lambda a, e: a + body(e["weight"]))

    return weighed.filter(F.size("w") > 0).select(
        "doc_id",
        F.size("w").cast("bigint").alias("terms"),
        round_to(total(lambda x: x), 5).alias("weight_sum"),
        round_to(total(lambda x: x * x), 6).alias("squared_norm"),
    )


@query(
    "linear_score",
    B.with_ctes(*_TFIDF, B.WEIGHT_TABLE)
    + f" SELECT doc_id, {B.round_to(f'1e0 / (1e0 + exp(-(sum(weight * coalesce(c, 0e0)) + ({BIAS}e0))))', 6)} AS ml_probability "
    "FROM tfidf LEFT JOIN coefs USING (term) GROUP BY doc_id",
)
def linear_score(spark, sf_dir):
    weights = spark.createDataFrame(list(WEIGHTS.items()), "term string, coefficient double")
    scored = T.linear_score(_tfidf(spark, sf_dir), weights, BIAS)
    return scored.withColumn("ml_probability", round_to(F.col("ml_probability"), 6))


# --- evaluation ----------------------------------------------------------------------------


@query(
    "predictions",
    B.with_ctes(*B.ALL_PREDICTIONS) + " SELECT doc_id, label, probability, prediction FROM predictions",
)
def prediction_rows(spark, sf_dir):
    return predictions(spark, sf_dir)


@query(
    "confusion_matrix",
    B.with_ctes(*B.ALL_PREDICTIONS)
    + " SELECT label, prediction, count(*)::BIGINT AS n FROM predictions GROUP BY ALL",
)
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(predictions(spark, sf_dir))


_REPORT = (
    "classes AS (SELECT unnest([0, 1]) AS c),\n"
    "pc AS (SELECT c, count(*) FILTER (label = c AND prediction = c) AS tp, count(*) FILTER (label = c) AS support, "
    "count(*) FILTER (prediction = c) AS predicted FROM predictions, classes GROUP BY c),\n"
    "pr AS (SELECT c, tp, support, tp::DOUBLE / greatest(predicted, 1) AS p, tp::DOUBLE / greatest(support, 1) AS r, "
    "2e0 * tp / greatest(predicted + support, 1) AS f FROM pc WHERE support + predicted > 0),\n"
    "allrows AS (SELECT c::VARCHAR AS row, p, r, f, support FROM pr "
    "UNION ALL SELECT 'macro', avg(p), avg(r), avg(f), sum(support) FROM pr "
    "UNION ALL SELECT 'weighted', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM pr "
    "UNION ALL SELECT 'accuracy', sum(tp)::DOUBLE / sum(support), sum(tp)::DOUBLE / sum(support), sum(tp)::DOUBLE / sum(support), sum(support) FROM pr)"
)


@query(
    "classification_report",
    B.with_ctes(*B.ALL_PREDICTIONS, _REPORT)
    + f" SELECT row, {B.round_to('p', 6)} AS precision, {B.round_to('r', 6)} AS recall, {B.round_to('f', 6)} AS f1, support::BIGINT AS support FROM allrows",
)
def classification_report(spark, sf_dir):
    report = M.classification_report(predictions(spark, sf_dir))
    return report.select(
        "row", *[round_to(F.col(n), 6).alias(n) for n in ("precision", "recall", "f1")], "support"
    )


@query(
    "roc_auc",
    B.with_ctes(*B.ALL_PREDICTIONS)
    + ", pairs AS (SELECT a.probability AS pa, b.probability AS pb FROM predictions a, predictions b WHERE a.label = 1 AND b.label <> 1) "
    "SELECT sum(CASE WHEN pa > pb THEN 2 WHEN pa = pb THEN 1 ELSE 0 END)::BIGINT AS doubled_wins, "
    "(SELECT count(*) FROM predictions WHERE label = 1)::BIGINT AS positives, (SELECT count(*) FROM predictions WHERE label <> 1)::BIGINT AS negatives, "
    f"{B.round_to('sum(CASE WHEN pa > pb THEN 2 WHEN pa = pb THEN 1 ELSE 0 END) / (2e0 * count(*))', 6)} AS roc_auc FROM pairs",
)
def roc_auc(spark, sf_dir):
    auc = M.roc_auc(predictions(spark, sf_dir))
    return auc.withColumn("roc_auc", round_to(F.col("roc_auc"), 6))


@query(
    "roc_pr_points",
    B.with_ctes(*B.ALL_PREDICTIONS)
    + ", c AS (SELECT probability AS threshold, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM predictions GROUP BY 1), "
    "cum AS (SELECT threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c WINDOW w AS (ORDER BY threshold DESC)) "
    "SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, tp::DOUBLE / p::DOUBLE AS tpr, fp::DOUBLE / n::DOUBLE AS fpr, tp::DOUBLE / (tp + fp)::DOUBLE AS precision FROM cum",
)
def roc_pr_points(spark, sf_dir):
    return M.roc_pr_points(predictions(spark, sf_dir))


_BIN = "least(floor(probability * 10), 9)::BIGINT"


@query(
    "calibration_bins",
    B.with_ctes(*B.ALL_PREDICTIONS)
    + f" SELECT {_BIN} AS bin, count(*)::BIGINT AS n, sum(probability::DECIMAL(18,6))::DOUBLE / count(*) AS mean_predicted, "
    "count(*) FILTER (label = 1)::DOUBLE / count(*) AS observed FROM predictions GROUP BY 1",
)
def calibration_bins(spark, sf_dir):
    return M.calibration_bins(predictions(spark, sf_dir))


@query(
    "probability_histogram",
    B.with_ctes(*B.ALL_PREDICTIONS)
    + f" SELECT label, {_BIN} AS bin, count(*)::BIGINT AS n FROM predictions GROUP BY ALL",
)
def probability_histogram(spark, sf_dir):
    return M.probability_histogram(predictions(spark, sf_dir))


@query(
    "error_analysis",
    B.with_ctes(*B.ALL_PREDICTIONS)
    + " SELECT doc_id, label, probability, prediction, CASE WHEN prediction = 1 THEN 'false positive' ELSE 'false negative' END AS error_type, "
    "text FROM predictions JOIN planted USING (doc_id) WHERE label <> prediction",
)
def error_analysis(spark, sf_dir):
    return M.error_analysis(predictions(spark, sf_dir, keep=("text",)))


_TERM_TOTALS = (
    "labelledtok AS (SELECT label, unnest(" + B.vector_tokens("text") + ") AS term FROM labelled),\n"
    "termtotals AS (SELECT label, term, count(*) AS n FROM labelledtok GROUP BY ALL)"
)


@query(
    "top_coefficients",
    B.with_ctes(B.PLANTED, B.LABELLED, B.VOCABULARY, _TERM_TOTALS)
    + ", w AS (SELECT term, (b - n)::DOUBLE / (b + n + 1)::DOUBLE AS coefficient, idf FROM (SELECT term, sum(CASE WHEN label = 1 THEN n ELSE 0 END) AS b, "
    "sum(CASE WHEN label <> 1 THEN n ELSE 0 END) AS n FROM termtotals GROUP BY term) JOIN vocab USING (term)) "
    "SELECT 'biased' AS side, term, coefficient, " + B.round_to("coefficient * idf", 6) + " AS coefficient_idf FROM (SELECT * FROM w ORDER BY coefficient DESC, term LIMIT 20) "
    "UNION ALL SELECT 'neutral', term, coefficient, " + B.round_to("coefficient * idf", 6) + " FROM (SELECT * FROM w ORDER BY coefficient, term LIMIT 20)",
)
def top_coefficients(spark, sf_dir):
    totals = XP.term_totals(labelled_documents(spark, sf_dir)).groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("b"),
        F.sum(F.when(F.col("label") != 1, F.col("n")).otherwise(0)).alias("n"),
    )
    coefficient = (F.col("b") - F.col("n")) / (F.col("b") + F.col("n") + 1)
    weights = totals.join(fitted_tfidf(spark, sf_dir).table(spark), "term").select(
        "term", coefficient.alias("coefficient"), "idf"
    )
    return M.top_coefficients(weights).select(
        "side", "term", "coefficient",
        round_to(F.col("coefficient_idf"), 6).alias("coefficient_idf"),
    )


# --- exploration -----------------------------------------------------------------------------

_LAB = (B.PLANTED, B.LABELLED)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_documents(spark, sf_dir).withColumn("label", F.col("label").cast("bigint"))


@query(
    "class_distribution",
    "SELECT toxic::BIGINT AS label, count(*)::BIGINT AS n, count(*) * 100e0 / (SELECT count(*) FROM labels) AS percent FROM labels GROUP BY toxic",
)
def class_distribution(spark, sf_dir):
    return XP.class_distribution(_label_rows(spark, sf_dir))


_RAW_WORDS = B.raw_words("text")
_MEAN_LENGTH = B.ratio(
    f"coalesce(list_sum(list_transform({_RAW_WORDS}, lambda q: length(q))), 0)", B.word_count("text")
)
_LENGTHS = (
    f"len0 AS (SELECT label, length(text)::BIGINT AS chars, {B.word_count('text')}::BIGINT AS words, len({B.fragments('text')})::BIGINT AS sentences, "
    f"{_MEAN_LENGTH} AS avg_word_length FROM labelled)"
)


@query(
    "text_length_stats",
    B.with_ctes(*_LAB, _LENGTHS)
    + " SELECT label, sum(chars)::DOUBLE / count(*) AS mean_chars, sum(words)::DOUBLE / count(*) AS mean_words, "
    f"{B.round_to('avg(avg_word_length)', 6)} AS mean_word_length, sum(sentences)::DOUBLE / count(*) AS mean_sentences, "
    "quantile_cont(words, 0.25)::DOUBLE AS words_q1, quantile_cont(words, 0.5)::DOUBLE AS words_median, quantile_cont(words, 0.75)::DOUBLE AS words_q3 "
    "FROM len0 GROUP BY label",
)
def text_length_stats(spark, sf_dir):
    return XP.text_length_stats(XP.with_lengths(_labelled(spark, sf_dir)))


_FEAT = (
    B.PLANTED, B.DOCS_AS_S, B.WORD_TABLE, B.EMOTION_WORDS, B.EMOTION, B.SUBJECTIVITY, FEATURES,
    "lf AS (SELECT toxic::BIGINT AS label, "
    + ", ".join(f"{B.round_to(n, 6)} AS {n}" for n in C.FEATURE_NAMES)
    + f", length(text)::BIGINT AS chars, {B.word_count('text')}::BIGINT AS words, {B.round_to(_MEAN_LENGTH, 6)} AS avg_word_length"
    + " FROM feat JOIN labels USING (doc_id) JOIN planted USING (doc_id))",
)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, ten features rounded to six digits, lengths)."""
    featured = XP.with_lengths(linguistic_features(_labelled(spark, sf_dir)))
    names = [*C.FEATURE_NAMES, "avg_word_length"]
    return featured.select(
        "label", "chars", "words", *[round_to(F.col(n), 6).alias(n) for n in names]
    )


_LENGTH_COLUMNS = ["chars", "words", "avg_word_length"]
_CORR_COLUMNS = [*C.FEATURE_NAMES, *_LENGTH_COLUMNS]
_PAIRS = [
    (a, b) for i, a in enumerate(_CORR_COLUMNS) for b in _CORR_COLUMNS[i + 1 :]
]


@query(
    "feature_correlation",
    B.with_ctes(*_FEAT)
    + " "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {B.round_to(f'corr({a}, {b})', 6)} AS correlation FROM lf"
        for a, b in _PAIRS
    ),
)
def feature_correlation(spark, sf_dir):
    return XP.feature_correlation(_features(spark, sf_dir), _CORR_COLUMNS)


@query(
    "feature_label_correlation",
    B.with_ctes(*_FEAT)
    + " "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature, {B.round_to(f'corr({a}, label)', 6)} AS correlation FROM lf"
        for a in _CORR_COLUMNS
    ),
)
def feature_label_correlation(spark, sf_dir):
    return XP.feature_label_correlation(_features(spark, sf_dir), _CORR_COLUMNS)


@query(
    "feature_distribution",
    B.with_ctes(*_FEAT)
    + " SELECT label, feature, greatest(0, least(floor(v / 0.1e0), 9))::BIGINT AS bin, count(*)::BIGINT AS n FROM "
    + f"(FROM lf UNPIVOT (v FOR feature IN ({', '.join(C.FEATURE_NAMES)}))) GROUP BY ALL",
)
def feature_distribution(spark, sf_dir):
    return XP.feature_distribution(_features(spark, sf_dir), C.FEATURE_NAMES)


@query(
    "feature_quantiles",
    B.with_ctes(*_FEAT[:-1], f"uf AS (SELECT toxic::BIGINT AS label, {', '.join(C.FEATURE_NAMES)} FROM feat JOIN labels USING (doc_id))")
    + " SELECT label, feature, "
    + ", ".join(
        f"{B.round_to(f'quantile_cont(v, {p})', 6)} AS {n}"
        for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
    )
    + f" FROM (FROM uf UNPIVOT (v FOR feature IN ({', '.join(C.FEATURE_NAMES)}))) GROUP BY ALL",
)
def feature_quantiles(spark, sf_dir):
    """Of the features as they are; only the quartiles are rounded, to be compared."""
    featured = linguistic_features(_labelled(spark, sf_dir))
    quantiles = XP.feature_quantiles(featured, C.FEATURE_NAMES)
    return quantiles.select(
        "label", "feature",
        *[round_to(F.col(n), 6).alias(n) for n in ("q1", "median", "q3")],
    )


_TOP = (
    " SELECT label, term, n::BIGINT AS n, position::BIGINT AS position FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, term) AS position "
    "FROM {rows}) WHERE position <= 20"
)


@query(
    "top_unigrams",
    B.with_ctes(*_LAB, _TERM_TOTALS)
    + _TOP.format(rows=f"(SELECT * FROM termtotals WHERE term NOT IN {B.sql_in(C.STOP_WORDS)})"),
)
def top_unigrams(spark, sf_dir):
    return XP.top_unigrams(_labelled(spark, sf_dir))


def _ngram_totals(n: int) -> str:
    joined = " || ' ' || ".join(f"t[i + {k}]" for k in range(n))
    return (
        f"ng0 AS (SELECT label, {B.vector_tokens('text')} AS t FROM labelled),\n"
        f"ng AS (SELECT label, term, count(*) AS n FROM (SELECT label, unnest(list_transform(range(1, greatest(len(t) - {n - 2}, 1)), lambda i: {joined})) AS term FROM ng0) GROUP BY ALL)"
    )


for _n, _name in ((2, "top_bigrams"), (3, "top_trigrams")):

    @query(_name, B.with_ctes(*_LAB, _ngram_totals(_n)) + _TOP.format(rows="ng"))
    def top_ngrams(spark, sf_dir, n=_n):
        return XP.top_ngrams(_labelled(spark, sf_dir), n)


@query(
    "exclusive_vocabulary",
    B.with_ctes(*_LAB, _TERM_TOTALS)
    + ", v AS (SELECT term, sum(CASE WHEN label = 1 THEN n ELSE 0 END)::BIGINT AS biased, sum(CASE WHEN label <> 1 THEN n ELSE 0 END)::BIGINT AS neutral, "
    "sum(n)::BIGINT AS total FROM termtotals GROUP BY term) SELECT term, biased, neutral, total, greatest(biased, neutral)::DOUBLE / total::DOUBLE AS class_share, "
    "(biased > neutral)::BIGINT AS main_class FROM v WHERE total >= 5 AND greatest(biased, neutral)::DOUBLE / total::DOUBLE >= 0.9e0",
)
def exclusive_vocabulary(spark, sf_dir):
    found = XP.exclusive_vocabulary(_labelled(spark, sf_dir))
    return found.withColumn("main_class", F.col("main_class").cast("bigint"))


@query(
    "polarity_subjectivity_grid",
    B.with_ctes(B.PLANTED, B.DOCS_AS_S, B.WORD_TABLE, B.EMOTION_WORDS, B.SUBJECTIVITY)
    + f", g AS (SELECT toxic::BIGINT AS label, {B.round_to('polarity', 6)} AS p, {B.round_to('subjectivity', 6)} AS q FROM subj JOIN labels USING (doc_id)) "
    "SELECT label, greatest(0, least(floor((p + 1e0) / 2e0 * 10), 9))::BIGINT AS polarity_bin, greatest(0, least(floor(q * 10), 9))::BIGINT AS subjectivity_bin, "
    "count(*)::BIGINT AS n FROM g GROUP BY ALL",
)
def polarity_subjectivity_grid(spark, sf_dir):
    scored = (
        auxiliary_scores(_labelled(spark, sf_dir))
        .withColumn("polarity", round_to(F.col("polarity"), 6))
        .withColumn("subjectivity", round_to(F.col("subjectivity"), 6))
    )
    return XP.polarity_subjectivity_grid(scored)
