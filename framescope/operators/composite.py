"""Composite score, article report, engine profile and comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope import constants as C
from framescope.functions import labels
from framescope.functions.numeric import round_to
from framescope.functions.text import is_blank, preview, split_sentences_abbrev, word_count
from framescope.functions.binding import settle, where_equal
from framescope.operators.attribution import classify_sentences, opinion_ratios
from framescope.operators.hedging import hedge_scan
from framescope.operators.lexicon import lexicon_scan
from framescope.operators.linear_model import LinearTextModel
from framescope.operators.passive import passive_scan, passive_score
from framescope.operators.sentiment import WordTable, auxiliary_scores
from framescope.operators.shaping import section_texts

ENGINES = list(C.COMPOSITE_WEIGHTS)


def weighted_score(weights: Mapping[str, float], scores: Mapping[str, Column]) -> Column:
    total = None
    for name, weight in weights.items():
        part = F.lit(float(weight)) * scores[name]
        total = part if total is None else total + part
    return round_to(total)


def score_text(
    df: DataFrame,
    text: str = "text",
    model: LinearTextModel | None = None,
    words: WordTable = C.SENTIMENT_WORDS,
    weights: Mapping[str, float] = C.COMPOSITE_WEIGHTS,
) -> DataFrame:
    """Run all engines on a text column and add their scores, labels and the verdict.

    Every engine is row-local, so scoring adds no shuffle. With no model, an existing
    ``ml_probability`` column is used. Blank texts get zeros and the ``N/A`` labels. The engines'
    columns are settled: filters on scores and labels read them and do not score again.
    """
    # The classifier may hand rows to Python, so it sees them before the engines add their lists.
    scored = df if model is None else model.score(df, text)
    scored = lexicon_scan(scored, text)
    scored = auxiliary_scores(scored, text, words)
    # Passive voice and hedging read the same sentences.
    scored = scored.withColumn("_sentences", split_sentences_abbrev(text))
    scored = passive_score(passive_scan(scored, text, split=F.col("_sentences")), text)
    scored = hedge_scan(scored, text, split=F.col("_sentences")).drop("_sentences")
    if model is not None:
        last = [c for c in scored.columns if c == "ml_probability"]
        scored = scored.select(*[c for c in scored.columns if c not in last], *last)
    scored = scored.withColumn("_blank", is_blank(text))
    scored = settle(scored, *[c for c in scored.columns if c not in df.columns])
    blank = F.col("_blank")
    score = {
        "ml_probability": F.col("ml_probability"),
        "emotion_intensity": F.col("emotion_intensity"),
        "subjectivity_score": F.col("subjectivity_score"),
        "passive_score": F.col("passive_score"),
        "lexicon_score": F.least(F.col("lexicon_score") * 10.0, F.lit(1.0)),
        "hedge_score": F.col("hedge_score"),
    }
    composite = F.col("composite_score")

    def unless_blank(value: Column, empty: str) -> Column:
        return F.when(blank, F.lit(empty)).otherwise(value)

    return (
        scored.withColumn("ml_probability", round_to(F.col("ml_probability")))
        .withColumn("hedge_score", round_to(F.col("hedge_score")))
        .withColumn("lexicon_score", round_to(F.col("loaded_rate")))
        .withColumn(
            "composite_score",
            F.when(blank, F.lit(0.0)).otherwise(weighted_score(weights, score)),
        )
        .withColumn("verdict", unless_blank(labels.verdict(composite), "No text provided"))
        .withColumn("color", unless_blank(labels.verdict_color(composite), "grey"))
        .withColumn("emoji", unless_blank(labels.verdict_emoji(composite), "⚪"))
        .withColumn("ml_label", labels.ml_label(F.col("ml_probability")).cast("bigint"))
        .withColumn(
            "ml_label_name",
            unless_blank(labels.ml_label_name(F.col("ml_label")), "N/A"),
        )
        .withColumn("emotion_label", unless_blank(F.col("emotion_label"), "N/A"))
        .withColumn("sentiment", unless_blank(F.col("sentiment"), "N/A"))
        .withColumn("subjectivity_label", unless_blank(F.col("subjectivity_label"), "N/A"))
        .withColumn("hedge_label", unless_blank(F.col("hedge_label"), "N/A"))
        .withColumn("text_preview", unless_blank(preview(text), "(no text)"))
        .drop("_blank")
    )


SECTION_COLUMNS = [
    "text_preview", "composite_score", "verdict", "color", "emoji", "ml_probability", "ml_label",
    "ml_label_name", "emotion_intensity", "emotion_label", "sentiment", "compound",
    "subjectivity_score", "subjectivity_label", "passive_score", "loaded_words",
    "loaded_word_count", "unique_loaded_words", "lexicon_score", "hedge_score", "hedge_label",
]


def score_sections(
    articles: DataFrame,
    model: LinearTextModel | None,
    key: str = "doc_id",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Scores of the five sections of every article, one row per section."""
    return _score_texts(articles, model, key, carry).select(
        key, *carry, F.explode("sections").alias("section"), "section_text", *SECTION_COLUMNS
    )


def _score_texts(
    articles: DataFrame, model: LinearTextModel | None, key: str, carry: Sequence[str]
) -> DataFrame:
    """The scores of every article's different texts, with the sections that have them."""
    return score_text(section_texts(articles, key, carry), "section_text", model).select(
        key, *carry, "sections", "section_text", *SECTION_COLUMNS
    )


def _category_map() -> Column:
    """Loaded words per lexicon category, only categories that occur."""
    names = list(C.LOADED_WORDS)
    counts = [F.size(where_equal("loaded_words", "category", n)).cast("bigint") for n in names]
    table = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*counts))
    return F.map_filter(table, lambda _, n: n > 0)


def article_report(
    articles: DataFrame,
    model: LinearTextModel | None,
    key: str = "doc_id",
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per article: body scores, section scores, lists and attribution statistics.

    Sections with the same text are scored once. The only shuffle regroups at most five short score rows
    per article; texts do not travel. Columns to ``carry`` along, such as address and time, come with the
    row of the body.
    """
    def has(label: str) -> Column:
        return F.array_contains("sections", label)

    body = has(C.SECTIONS[0])
    sections = _score_texts(articles, model, key, carry)
    # Attribution is only read for the body; other sections are scanned as null, which is free.
    extra = opinion_ratios(
        classify_sentences(
            sections.withColumn("_body", F.when(body, F.col("section_text"))), "_body"
        ),
        "_body",
    )
    distinct_words = F.array_distinct(F.transform("loaded_words", lambda m: m["word"]))
    kept = F.struct(
        "composite_score", "verdict", "ml_probability", "ml_label", "emotion_intensity",
        "subjectivity_score", "passive_score",
        F.least(F.col("lexicon_score") * 10.0, F.lit(1.0)).alias("lexicon_score"),
        F.col("lexicon_score").alias("lexicon_rate"),
        "hedge_score", "hedge_label", "loaded_word_count", "unique_loaded_words",
        F.transform("loaded_words", lambda m: m["word"]).alias("loaded_words"),
        distinct_words.alias("distinct_loaded_words"),
        _category_map().alias("category_counts"),
        "opinion_ratio", "opinion_label", "quote_ratio", "attribution_ratio",
        F.substring("section_text", 1, 500).alias("body_preview"),
        word_count("section_text").cast("bigint").alias("word_count"),
        *carry,
    )
    slim = extra.select(
        key,
        "sections",
        "composite_score",
        F.when(body, kept).alias("body"),
        F.when(has(C.SECTIONS[1]), F.col("section_text")).alias("headline"),
    )
    section_scores = [
        F.max(F.when(has(label), F.col("composite_score"))).alias(alias)
        for label, alias in zip(
            C.SECTIONS[1:],
            ["headline_score", "beginning_score", "middle_score", "end_score"],
            strict=True,
        )
    ]
    return (
        slim.groupBy(key)
        .agg(
            F.first("body", ignorenulls=True).alias("body"),
            F.max("headline").alias("headline"),
            *section_scores,
        )
        .select(
            key, "headline", "body.*", "headline_score", "beginning_score", "middle_score",
            "end_score", F.lit(C.ANALYSIS_VERSION).alias("analysis_version"),
        )
        .withColumn("ml_verdict", labels.ml_label_name(F.col("ml_label")))
    )


def engine_scores(report: DataFrame) -> DataFrame:
    """Pack the engine columns of a report into the ``engine_scores`` struct."""
    fields = [
        "ml_probability", "ml_label", "ml_verdict", "emotion_intensity", "subjectivity_score",
        "passive_score", "lexicon_score", "hedge_score", "headline_score", "beginning_score",
        "middle_score", "end_score", "loaded_words", "unique_loaded_words", "hedge_label",
        "opinion_ratio", "opinion_label",
    ]
    return report.withColumn("engine_scores", F.struct(*fields))


PROFILE_NAMES = ["ML", "Emotion", "Subjectivity", "Passive", "Lexicon", "Hedge"]


def engine_profile(report: DataFrame, key: str = "doc_id") -> DataFrame:
    """Six rows per article: engine name and score as a whole percentage."""
    named = report.select(
        key,
        *[
            F.col(engine).cast("double").alias(name)
            for engine, name in zip(ENGINES, PROFILE_NAMES, strict=True)
        ],
    )
    return named.unpivot(key, PROFILE_NAMES, "subject", "score").select(
        key,
        "subject",
        F.floor(F.col("score") * 100.0 + 0.5).cast("bigint").alias("percent"),
    )


def compare_articles(
    report: DataFrame, pairs: DataFrame, key: str = "doc_id"
) -> DataFrame:
    """Put the two articles of every ``(key_a, key_b)`` pair side by side, engine by engine.

    Each pair becomes two rows, so the report is read and joined once, not once per side.
    """
    key_a, key_b = f"{key}_a", f"{key}_b"
    columns = ["composite_score", *ENGINES]
    sides = pairs.select(
        key_a,
        key_b,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(side).alias("side"), F.col(f"{key}_{side}").alias(key))
                    for side in ("a", "b")
                ]
            )
        ),
    )
    joined = sides.join(report.select(key, "verdict", *columns), key)

    def of(side: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(column))).alias(f"{column}_{side}")

    wide = joined.groupBy(key_a, key_b).agg(
        *[of(side, c) for c in ("verdict", *columns) for side in ("a", "b")]
    )
    complete = wide.filter(
        F.col("composite_score_a").isNotNull() & F.col("composite_score_b").isNotNull()
    )
    return complete.select(
        "*", *[(F.col(f"{c}_a") - F.col(f"{c}_b")).alias(f"{c}_difference") for c in columns]
    )
