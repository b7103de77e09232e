"""Queries for the scoring engines, entities, composite score and article report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope import constants as C
from framescope.functions import text as X
from framescope.functions.numeric import round_to
from framescope.operators import attribution as Q
from framescope.operators import composite as K
from framescope.operators import entities as N
from framescope.operators import hedging as HG
from framescope.operators import lexicon as LX
from framescope.operators import passive as P
from framescope.operators import sentiment as V
from framescope.operators.features import LinguisticFeatures, feature_map, linguistic_features
from framescope.plans import oracle_base as B
from framescope.plans.planted import (
    gazetteer,
    planted_articles,
    planted_documents,
    planted_model,
)
from framescope.plans.registry import query


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted_documents(spark, sf_dir).select("doc_id", "text")


# --- loaded vocabulary -----------------------------------------------------------

_LEX = (B.PLANTED, B.DOCS_AS_S, B.LEXICON_TABLE, B.TOKENS, B.LEX)


@query(
    "lexicon_scan",
    B.with_ctes(*_LEX)
    + f" SELECT doc_id, total_tokens, loaded_word_count, unique_loaded_words, words AS loaded_words, loaded_rate, "
    f"{B.lexicon_label('loaded_rate', 'total_tokens')} AS lexicon_label FROM lex",
)
def lexicon_scan(spark, sf_dir):
    words = F.array_join(F.transform("loaded_words", lambda m: m["word"]), ",")
    return LX.lexicon_scan(_docs(spark, sf_dir)).select(
        "doc_id", "total_tokens", "loaded_word_count", "unique_loaded_words",
        words.alias("loaded_words"), "loaded_rate", "lexicon_label",
    )


@query(
    "category_counts",
    B.with_ctes(*_LEX)
    + " SELECT doc_id, category, count(*)::BIGINT AS match_count FROM lexhits GROUP BY ALL",
)
def category_counts(spark, sf_dir):
    return LX.category_counts(LX.lexicon_scan(_docs(spark, sf_dir)))


@query(
    "unique_loaded_words",
    B.with_ctes(*_LEX)
    + " SELECT doc_id, count(DISTINCT word)::BIGINT AS unique_loaded_words FROM lexhits GROUP BY doc_id",
)
def unique_loaded_words(spark, sf_dir):
    return (
        LX.lexicon_scan(_docs(spark, sf_dir))
        .filter("loaded_word_count > 0")
        .select("doc_id", "unique_loaded_words")
    )


TOP_WORDS = (
    "topw AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, word) AS rn "
    "FROM lexhits GROUP BY doc_id, word),\n"
    "toplist AS (SELECT doc_id, string_agg(word, ', ' ORDER BY rn) AS top_loaded_words FROM topw WHERE rn <= 6 GROUP BY doc_id)"
)


@query(
    "top_loaded_words",
    B.with_ctes(*_LEX, TOP_WORDS)
    + " SELECT doc_id, coalesce(top_loaded_words, '') AS top_loaded_words FROM planted LEFT JOIN toplist USING (doc_id)",
)
def top_loaded_words(spark, sf_dir):
    return LX.top_loaded_words(LX.lexicon_scan(_docs(spark, sf_dir)))


_TERMS = ["threat", "vile", "idiot", "(no!", "it is"]


@query(
    "highlight_terms",
    B.with_ctes(B.PLANTED)
    + " SELECT doc_id, md5(h) AS digest, ((length(h) - length(replace(h, '<mark>', ''))) // 6)::BIGINT AS marks FROM "
    "(SELECT doc_id, regexp_replace(text, '(?i)(threat|vile|idiot|\\(no!|it is)', '<mark>\\1</mark>', 'g') AS h FROM planted)",
)
def highlight_terms(spark, sf_dir):
    marked = X.highlight_terms(F.col("text"), _TERMS).alias("h")
    count = (F.length("h") - F.length(F.replace("h", F.lit("<mark>"), F.lit("")))) / 6
    return (
        _docs(spark, sf_dir)
        .select("doc_id", marked)
        .select(
            "doc_id",
            F.md5(F.col("h").cast("binary")).alias("digest"),
            count.cast("bigint").alias("marks"),
        )
    )


@query(
    "lexicon_term_frequency",
    B.with_ctes(*_LEX)
    + " SELECT word, category, count(*)::BIGINT AS mentions FROM lexhits GROUP BY ALL",
)
def lexicon_term_frequency(spark, sf_dir):
    return LX.term_frequency(LX.lexicon_scan(_docs(spark, sf_dir)))


# --- hedging ----------------------------------------------------------------------

_HEDGE = (B.PLANTED, B.DOCS_AS_S, B.SENTENCES, B.HEDGE)


@query(
    "hedge_matches",
    B.with_ctes(*_HEDGE)
    + " SELECT doc_id, idx::BIGINT AS sentence_idx, 'epistemic' AS kind, unnest(e) AS phrase, sentence FROM hedgerows "
    "UNION ALL SELECT doc_id, idx::BIGINT, 'inflation', unnest(f), sentence FROM hedgerows",
)
def hedge_matches(spark, sf_dir):
    return HG.hedge_matches(HG.hedge_scan(_docs(spark, sf_dir))).select(
        "doc_id", "sentence_idx", "kind", "phrase", "sentence"
    )


@query(
    "hedge_score",
    B.with_ctes(*_HEDGE)
    + " SELECT doc_id, hedge_sentences, epistemic_count, inflation_count, epistemic_rate, inflation_rate, hedge_score, "
    f"{B.hedge_label('hedge_score', B.is_blank('text'))} AS hedge_label FROM hed JOIN s USING (doc_id, section)",
)
def hedge_score(spark, sf_dir):
    return HG.hedge_scan(_docs(spark, sf_dir)).select(
        "doc_id", "hedge_sentences", "epistemic_count", "inflation_count", "epistemic_rate",
        "inflation_rate", "hedge_score", "hedge_label",
    )


@query(
    "flagged_sentences",
    B.with_ctes(*_HEDGE)
    + " SELECT doc_id, idx::BIGINT AS sentence_idx, sentence, array_to_string(e, '|') AS epistemic_phrases, "
    "array_to_string(f, '|') AS inflation_phrases, CASE WHEN len(e) > 0 AND len(f) > 0 THEN 'both' "
    "WHEN len(e) > 0 THEN 'epistemic' ELSE 'inflation' END AS flag_type FROM hedgerows",
)
def flagged_sentences(spark, sf_dir):
    return HG.flagged_sentences(HG.hedge_scan(_docs(spark, sf_dir))).select(
        "doc_id", "sentence_idx", "sentence",
        F.array_join("epistemic_phrases", "|").alias("epistemic_phrases"),
        F.array_join("inflation_phrases", "|").alias("inflation_phrases"),
        "flag_type",
    )


_SUMMARY = (
    "CASE WHEN hedge_score < 0.05e0 THEN 'No significant hedging language detected.' ELSE "
    f"{B.hedge_label('hedge_score', 'false')} || ' detected (score ' || "
    "(floor(hedge_score * 1e2 + 0.5e0)::BIGINT // 100) || '.' || "
    "lpad((floor(hedge_score * 1e2 + 0.5e0)::BIGINT % 100)::VARCHAR, 2, '0') || '). ' || concat_ws(' ', "
    "CASE WHEN epistemic_count > 0 THEN epistemic_count || ' epistemic hedge(s) found — claims presented without verified attribution.' END, "
    "CASE WHEN inflation_count > 0 THEN inflation_count || ' certainty inflator(s) found — editorial opinion presented as fact.' END) END"
)


@query("hedge_summary", B.with_ctes(*_HEDGE) + f" SELECT doc_id, {_SUMMARY} AS hedge_summary FROM hed")
def hedge_summary(spark, sf_dir):
    scanned = HG.hedge_scan(_docs(spark, sf_dir))
    return HG.hedge_summary(scanned).select("doc_id", "hedge_summary")


# --- passive voice ----------------------------------------------------------------

_PASSIVE = (B.PLANTED, B.DOCS_AS_S, B.SENTENCES, B.PASSIVE)


@query(
    "passive_sentences",
    B.with_ctes(*_PASSIVE)
    + " SELECT doc_id, idx::BIGINT AS sentence_idx, sentence, 'auxpass' AS pattern, aux_verb, main_verb FROM pasrows",
)
def passive_sentences(spark, sf_dir):
    return P.passive_sentences(P.passive_scan(_docs(spark, sf_dir))).drop("is_gap")


@query(
    "responsibility_gap",
    B.with_ctes(*_PASSIVE)
    + " SELECT doc_id, idx::BIGINT AS sentence_idx, is_gap::BIGINT AS is_gap FROM pasrows",
)
def responsibility_gap(spark, sf_dir):
    return P.passive_sentences(P.passive_scan(_docs(spark, sf_dir))).select(
        "doc_id", "sentence_idx", F.col("is_gap").cast("bigint").alias("is_gap")
    )


@query(
    "passive_score",
    B.with_ctes(*_PASSIVE)
    + " SELECT doc_id, passive_total, passive_count, gap_count, passive_rate, passive_score, "
    f"CASE WHEN {B.is_blank('text')} THEN 'N/A' ELSE {B.bucket('passive_score', C.PASSIVE_CUTS, C.PASSIVE_LABELS)} END "
    "AS passive_label FROM pas JOIN s USING (doc_id, section)",
)
def passive_score(spark, sf_dir):
    return P.passive_score(P.passive_scan(_docs(spark, sf_dir))).select(
        "doc_id", "passive_total", "passive_count", "gap_count", "passive_rate", "passive_score",
        "passive_label",
    )


@query(
    "passive_signal",
    B.with_ctes(*_PASSIVE)
    + " SELECT doc_id, CASE WHEN passive_total = 0 THEN 'No text provided.' WHEN passive_count = 0 THEN "
    "'No passive voice detected. Article uses clear, direct language.' ELSE concat_ws(' ', "
    "passive_count || ' of ' || passive_total || ' sentences use passive voice (' || floor(passive_rate * 1e2 + 0.5e0)::BIGINT || '%).', "
    "CASE WHEN gap_count > 0 THEN gap_count || ' sentence(s) use agentless passive — responsibility is completely obscured.' END) END "
    "AS passive_signal FROM pas",
)
def passive_signal(spark, sf_dir):
    scored = P.passive_score(P.passive_scan(_docs(spark, sf_dir)))
    return scored.select("doc_id", "passive_signal")


# --- attribution -------------------------------------------------------------------

_OPINION = (B.PLANTED, B.DOCS_AS_S, B.PLAIN, B.OPINION)


@query(
    "sentence_class",
    B.with_ctes(B.PLANTED, B.DOCS_AS_S, B.PLAIN)
    + " SELECT doc_id, idx::BIGINT AS sentence_idx, sentence_class FROM classified",
)
def sentence_class(spark, sf_dir):
    return (
        Q.classify_sentences(_docs(spark, sf_dir))
        .select("doc_id", F.inline("classified"))
        .drop("sentence")
    )


@query(
    "opinion_ratios",
    B.with_ctes(*_OPINION)
    + " SELECT doc_id, total_sentences, quoted_sentences, attributed_sentences, opinion_sentences, opinion_ratio, quote_ratio, "
    f"attribution_ratio, CASE WHEN {B.is_blank('text')} THEN 'N/A' ELSE "
    f"{B.bucket('opinion_ratio', C.OPINION_CUTS, C.OPINION_LABELS)} END AS opinion_label FROM op JOIN s USING (doc_id, section)",
)
def opinion_ratios(spark, sf_dir):
    return Q.opinion_ratios(Q.classify_sentences(_docs(spark, sf_dir))).drop("text", "classified")


@query(
    "opinion_examples",
    B.with_ctes(B.PLANTED, B.DOCS_AS_S, B.PLAIN)
    + " SELECT doc_id, sentence_class, position::BIGINT AS position, substr(sentence, 1, 200) AS example FROM "
    "(SELECT *, row_number() OVER (PARTITION BY doc_id, sentence_class ORDER BY idx) AS position FROM classified) WHERE position <= 3",
)
def opinion_examples(spark, sf_dir):
    return Q.opinion_examples(Q.classify_sentences(_docs(spark, sf_dir)))


# --- sentiment and features ------------------------------------------------------------

_AUX = (B.PLANTED, B.DOCS_AS_S, B.WORD_TABLE, B.EMOTION_WORDS, B.EMOTION, B.SUBJECTIVITY)
_SENTIMENT = (
    "CASE WHEN compound >= 0.05e0 THEN 'Positive' WHEN compound <= -0.05e0 THEN 'Negative' ELSE 'Neutral' END"
)
_EMOTION_LABEL = B.bucket("emotion_intensity", C.EMOTION_CUTS, C.EMOTION_LABELS)
_SUBJ_LABEL = B.bucket("subjectivity_score", C.SUBJECTIVITY_CUTS, C.SUBJECTIVITY_LABELS)


@query(
    "emotion_intensity",
    B.with_ctes(*_AUX)
    + f" SELECT doc_id, {B.round_to('compound', 6)} AS compound, emotion_intensity, {_EMOTION_LABEL} AS emotion_label, "
    f"{_SENTIMENT} AS sentiment FROM emo",
)
def emotion_intensity(spark, sf_dir):
    return V.emotion_intensity(_docs(spark, sf_dir)).select(
        "doc_id", round_to(F.col("compound"), 6).alias("compound"), "emotion_intensity",
        "emotion_label", "sentiment",
    )


@query(
    "subjectivity",
    B.with_ctes(*_AUX)
    + f" SELECT doc_id, subjectivity_score, {B.round_to('polarity', 6)} AS polarity, {_SUBJ_LABEL} AS subjectivity_label FROM subj",
)
def subjectivity(spark, sf_dir):
    return V.subjectivity(_docs(spark, sf_dir)).select(
        "doc_id", "subjectivity_score", round_to(F.col("polarity"), 6).alias("polarity"),
        "subjectivity_label",
    )


@query(
    "auxiliary_scores",
    B.with_ctes(*_AUX)
    + f" SELECT doc_id, emotion_intensity, {_EMOTION_LABEL} AS emotion_label, subjectivity_score, "
    f"{_SUBJ_LABEL} AS subjectivity_label FROM emo JOIN subj USING (doc_id, section)",
)
def auxiliary_scores(spark, sf_dir):
    return V.auxiliary_scores(_docs(spark, sf_dir)).select(
        "doc_id", "emotion_intensity", "emotion_label", "subjectivity_score", "subjectivity_label"
    )


def _share(words: list[str]) -> str:
    hits = f"len(list_filter(raw, lambda q: q IN {B.sql_in(words)}))"
    return B.ratio(hits, "len(raw)")


_PASSIVE_FRAGMENT = " OR ".join(
    f"contains(lower(q), {B.quoted(p)})" for p in C.PASSIVE_INDICATORS
)
_COUNT = "(length(text) - length(replace(text, '{c}', '')))"
FEATURES = (
    f"feat0 AS (SELECT doc_id, section, text, {B.raw_words('text')} AS raw, {B.fragments('text')} AS frags FROM s),\n"
    f"feat1 AS (SELECT *, list_transform(frags, lambda q: {B.word_count('q')}::BIGINT) AS lens FROM feat0),\n"
    "feat2 AS (SELECT *, len(frags)::BIGINT AS nf, coalesce(list_sum(lens), 0)::BIGINT AS ls, "
    "coalesce(list_sum(list_transform(lens, lambda q: q * q)), 0)::BIGINT AS lq FROM feat1),\n"
    "feat AS (SELECT doc_id, "
    f"{B.ratio(f'len(list_filter(frags, lambda q: {_PASSIVE_FRAGMENT}))', 'nf')} AS passive_rate, "
    f"{_share(LX.loaded_words())} AS lexicon_score, subjectivity, abs(compound) AS emotion_intensity, "
    "CASE WHEN nf > 1 THEN least((nf * lq - ls * ls)::DOUBLE / (nf * nf)::DOUBLE / 1e2, 1e0) ELSE 0e0 END AS sent_length_variance, "
    f"{B.ratio(_COUNT.format(c='!') + ' + ' + _COUNT.format(c='?'), 'len(raw)')} AS punctuation_density, "
    f"{_share(C.FIRST_PERSON)} AS first_person_rate, "
    "1e0 - least(" + B.ratio("(" + _COUNT.format(c='"') + " // 2)", "nf") + ", 1e0) AS quote_density_inverted, "
    f"{B.ratio('len(list_distinct(raw))', 'len(raw)')} AS unique_word_ratio, {_share(C.STOP_WORDS)} AS stop_word_ratio "
    "FROM feat2 JOIN emo USING (doc_id, section) JOIN subj USING (doc_id, section))"
)
_ROUNDED = ", ".join(f"{B.round_to(n, 6)} AS {n}" for n in C.FEATURE_NAMES)


@query(
    "linguistic_features", B.with_ctes(*_AUX, FEATURES) + f" SELECT doc_id, {_ROUNDED} FROM feat"
)
def features(spark, sf_dir):
    featured = linguistic_features(_docs(spark, sf_dir))
    return featured.select(
        "doc_id", *[round_to(F.col(n), 6).alias(n) for n in C.FEATURE_NAMES]
    )


@query(
    "linguistic_feature_map",
    B.with_ctes(*_AUX, FEATURES)
    + " SELECT doc_id, feature, value FROM (SELECT doc_id, "
    + ", ".join(f"{B.round_to(n)} AS {n}" for n in C.FEATURE_NAMES)
    + f" FROM feat) UNPIVOT (value FOR feature IN ({', '.join(C.FEATURE_NAMES)}))",
)
def linguistic_feature_map(spark, sf_dir):
    featured = LinguisticFeatures(inputCol="text").transform(_docs(spark, sf_dir))
    return feature_map(featured).select("doc_id", F.explode_outer("linguistic").alias("feature", "value"))


# --- entities --------------------------------------------------------------------------


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.entity_mentions(_docs(spark, sf_dir), gazetteer(spark))


@query("entity_mentions", B.with_ctes(*B.ALL_MENTIONS) + " SELECT * FROM mentions")
def entity_mentions(spark, sf_dir):
    return _mentions(spark, sf_dir)


@query(
    "entity_counts",
    B.with_ctes(*B.ALL_MENTIONS)
    + " SELECT doc_id, entity, count(*)::BIGINT AS mention_count, max_by(entity_type, sent_idx * 100000 + pos) AS entity_type "
    "FROM mentions WHERE length(entity) >= 2 GROUP BY ALL",
)
def entity_counts(spark, sf_dir):
    return N.entity_counts(_mentions(spark, sf_dir)).drop("first_place")


@query(
    "entities_by_type",
    B.with_ctes(*B.ALL_MENTIONS)
    + " SELECT doc_id, entity_type, string_agg(entity, '|' ORDER BY first_at) AS entities FROM (SELECT doc_id, entity_type, entity, "
    "min(sent_idx * 100000 + pos) AS first_at FROM mentions GROUP BY ALL) GROUP BY ALL",
)
def entities_by_type(spark, sf_dir):
    return N.entities_by_type(_mentions(spark, sf_dir)).withColumn(
        "entities", F.array_join("entities", "|")
    )


@query(
    "entity_framing",
    B.with_ctes(*B.ALL_MENTIONS, B.FRAMING)
    + " SELECT doc_id, entity, positive, negative, net, frame_label FROM framing",
)
def entity_framing(spark, sf_dir):
    return N.entity_framing(_mentions(spark, sf_dir)).drop("first_place")


_TYPE_NAME = "CASE type_code " + " ".join(
    f"WHEN {B.quoted(k)} THEN {B.quoted(v)}" for k, v in C.ENTITY_TYPES.items()
) + " ELSE 'Unknown' END"


@query(
    "top_entities",
    B.with_ctes(*B.ALL_MENTIONS, B.FRAMING)
    + f" SELECT doc_id, position, entity, mention_count, {_TYPE_NAME} AS type_name, type_code, frame_label FROM ("
    "SELECT doc_id, entity, count(*)::BIGINT AS mention_count, max_by(entity_type, sent_idx * 100000 + pos) AS type_code, "
    "row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(sent_idx * 100000 + pos), entity)::BIGINT AS position "
    "FROM mentions GROUP BY doc_id, entity) JOIN framing USING (doc_id, entity) WHERE position <= 5",
)
def top_entities(spark, sf_dir):
    return N.top_entities(_mentions(spark, sf_dir))


FRAMED = (
    "framed AS (SELECT doc_id, "
    + ", ".join(
        f"coalesce(string_agg(entity, '|' ORDER BY first_at) FILTER (frame_label = '{label} Framing'), '') AS {alias}"
        for label, alias in (("Negative", "negatively_framed"), ("Positive", "positively_framed"))
    )
    + ", array_to_string(coalesce(list(entity ORDER BY first_at) FILTER (frame_label = 'Negative Framing'), [])[1:5], ' | ') "
    "AS negatively_framed_entities, "
    "coalesce(list(entity ORDER BY first_at) FILTER (frame_label = 'Negative Framing'), []) AS nl, "
    "coalesce(list(entity ORDER BY first_at) FILTER (frame_label = 'Positive Framing'), []) AS pl FROM framing GROUP BY doc_id)"
)


@query(
    "framed_entity_lists",
    B.with_ctes(*B.ALL_MENTIONS, B.FRAMING, FRAMED)
    + " SELECT doc_id, negatively_framed, positively_framed, negatively_framed_entities FROM framed",
)
def framed_entity_lists(spark, sf_dir):
    return (
        N.framed_entity_lists(_mentions(spark, sf_dir))
        .withColumn("negatively_framed", F.array_join("negatively_framed", "|"))
        .withColumn("positively_framed", F.array_join("positively_framed", "|"))
    )


NER = (
    "nertotals AS (SELECT doc_id, count(DISTINCT entity)::BIGINT AS total_unique, count(DISTINCT entity_type) AS types FROM mentions GROUP BY doc_id),\n"
    "ner AS (SELECT p.doc_id, coalesce(total_unique, 0)::BIGINT AS total_unique, coalesce(negatively_framed_entities, '') AS negatively_framed_entities, "
    f"CASE WHEN {B.is_blank('p.text')} THEN 'No text provided.' WHEN coalesce(total_unique, 0) = 0 THEN 'No named entities detected.' ELSE concat_ws(' ', "
    "total_unique || ' named entities detected across ' || types || ' categories.', "
    "CASE WHEN len(nl) > 0 THEN 'Negative framing detected around: ' || array_to_string(nl[1:3], ', ') || '.' END, "
    "CASE WHEN len(pl) > 0 THEN 'Positive framing detected around: ' || array_to_string(pl[1:3], ', ') || '.' END) END AS summary "
    "FROM planted p LEFT JOIN nertotals USING (doc_id) LEFT JOIN framed USING (doc_id))"
)


@query(
    "ner_summary",
    B.with_ctes(*B.ALL_MENTIONS, B.FRAMING, FRAMED, NER) + " SELECT * FROM ner",
)
def ner_summary(spark, sf_dir):
    return N.gazetteer_summary(_docs(spark, sf_dir), gazetteer(spark))


# --- composite score and report -----------------------------------------------------------

_DOC_SCORED = (B.PLANTED, B.DOCS_AS_S, *B.ENGINES)


@query(
    "composite_score",
    B.with_ctes(*_DOC_SCORED)
    + " SELECT doc_id, ml_probability, emotion_intensity, subjectivity_score, passive_score, lexicon_score, hedge_score, composite_score, "
    f"{B.verdict('composite_score', 'blank')} AS verdict FROM scored",
)
def composite_score(spark, sf_dir):
    model = planted_model(spark, sf_dir)
    return K.score_text(_docs(spark, sf_dir), "text", model).select(
        "doc_id", "ml_probability", "emotion_intensity", "subjectivity_score", "passive_score",
        "lexicon_score", "hedge_score", "composite_score", "verdict",
    )


_BLANKED = B.PLANTED + (
    ",\nblanked AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' || chr(10) || ' ' "
    "WHEN 2 THEN NULL ELSE text END AS text FROM planted),\n"
    "s AS (SELECT doc_id, '' AS section, coalesce(text, '') AS text FROM blanked)"
)
_NA = "CASE WHEN blank THEN 'N/A' ELSE {} END"


@query(
    "empty_section",
    B.with_ctes(_BLANKED, *B.ENGINES)
    + f" SELECT doc_id, composite_score, {B.verdict('composite_score', 'blank')} AS verdict, "
    f"CASE WHEN blank THEN 'grey' ELSE {B.bucket('composite_score', C.VERDICT_CUTS, C.VERDICT_COLORS)} END AS color, "
    f"{_NA.format(_EMOTION_LABEL)} AS emotion_label, {_NA.format(_SUBJ_LABEL)} AS subjectivity_label, "
    f"{_NA.format(B.hedge_label('raw_hedge', 'false'))} AS hedge_label, "
    "CASE WHEN blank THEN '(no text)' WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS text_preview FROM scored",
)
def empty_section(spark, sf_dir):
    text = F.expr(
        "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' \\n ' WHEN 2 THEN NULL ELSE text END"
    )
    docs = _docs(spark, sf_dir).withColumn("text", text)
    return K.score_text(docs, "text", planted_model(spark, sf_dir)).select(
        "doc_id", "composite_score", "verdict", "color", "emotion_label", "subjectivity_label",
        "hedge_label", "text_preview",
    )


@query(
    "section_scores",
    B.with_ctes(*B.ALL_SCORED)
    + f" SELECT doc_id, section, composite_score, {B.verdict('composite_score', 'blank')} AS verdict, ml_probability, hedge_score, passive_score FROM scored",
)
def section_scores(spark, sf_dir):
    return K.score_sections(planted_articles(spark, sf_dir), planted_model(spark, sf_dir)).select(
        "doc_id", "section", "composite_score", "verdict", "ml_probability", "hedge_score",
        "passive_score",
    )


# Attribution of the body, next to the section scores.
BODY_OPINION = (B.PLAIN + ",\n" + B.OPINION).replace("FROM s)", "FROM s WHERE section = 'Full Body')")
REPORT_CTES = (*B.ALL_REPORT, BODY_OPINION)
REPORT_COLUMNS = (
    f"doc_id, headline, composite_score, {B.verdict('composite_score', 'blank')} AS verdict, ml_probability, "
    "(ml_probability >= 0.5)::BIGINT AS ml_label, CASE WHEN ml_probability >= 0.5 THEN 'Biased' ELSE 'Neutral' END AS ml_verdict, "
    "emotion_intensity, subjectivity_score, passive_score, least(lexicon_rate * 10e0, 1e0) AS lexicon_score, lexicon_rate, hedge_score, "
    f"{B.hedge_label('raw_hedge', 'blank', 'N/A')} AS hedge_label, loaded_word_count, unique_loaded_words, words AS loaded_words, "
    f"opinion_ratio, CASE WHEN blank THEN 'N/A' ELSE {B.bucket('opinion_ratio', C.OPINION_CUTS, C.OPINION_LABELS)} END AS opinion_label, "
    "quote_ratio, attribution_ratio, body_preview, word_count, headline_score, beginning_score, middle_score, end_score, 'v2.0' AS analysis_version"
)


def planted_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.article_report(planted_articles(spark, sf_dir), planted_model(spark, sf_dir))


@query(
    "article_report",
    B.with_ctes(*REPORT_CTES) + f" SELECT {REPORT_COLUMNS} FROM report JOIN op USING (doc_id)",
)
def article_report(spark, sf_dir):
    return (
        planted_report(spark, sf_dir)
        .withColumn("loaded_words", F.array_join("loaded_words", ","))
        .drop("distinct_loaded_words", "category_counts")
    )


@query(
    "engine_profile",
    B.with_ctes(*B.ALL_REPORT)
    + " SELECT doc_id, subject, floor(score * 1e2 + 0.5e0)::BIGINT AS percent FROM (SELECT doc_id, ml_probability AS ML, "
    "emotion_intensity AS Emotion, subjectivity_score AS Subjectivity, passive_score AS Passive, least(lexicon_rate * 10e0, 1e0) AS Lexicon, "
    "hedge_score AS Hedge FROM report) UNPIVOT (score FOR subject IN (ML, Emotion, Subjectivity, Passive, Lexicon, Hedge))",
)
def engine_profile(spark, sf_dir):
    return K.engine_profile(planted_report(spark, sf_dir))


_COMPARED = ["composite_score", *K.ENGINES]


@query(
    "compare_articles",
    B.with_ctes(*B.ALL_REPORT)
    + ", r AS (SELECT * , least(lexicon_rate * 10e0, 1e0) AS lexicon_score, "
    + f"{B.verdict('composite_score', 'blank')} AS verdict FROM report) "
    "SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, a.verdict AS verdict_a, b.verdict AS verdict_b, "
    + ", ".join(
        f"{B.round_to(f'a.{c} - b.{c}', 6)} AS {c}_difference" for c in _COMPARED
    )
    + " FROM r a JOIN r b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0",
)
def compare_articles(spark, sf_dir):
    report = planted_report(spark, sf_dir)
    pairs = (
        planted_documents(spark, sf_dir)
        .filter("doc_id % 2 = 0")
        .select(F.col("doc_id").alias("doc_id_a"), (F.col("doc_id") + 1).alias("doc_id_b"))
    )
    return K.compare_articles(report, pairs).select(
        "doc_id_a", "doc_id_b", "verdict_a", "verdict_b",
        *[
            round_to(F.col(f"{c}_difference"), 6).alias(f"{c}_difference") for c in _COMPARED
        ],
    )
