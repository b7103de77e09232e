"""Loaded-vocabulary scan. Row-local: the word list is an ``InSet`` literal, nothing shuffles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope import constants as C
from framescope.functions.binding import let, where_equal
from framescope.functions.labels import lexicon_label
from framescope.functions.lookup import literal_lookup
from framescope.functions.numeric import ratio
from framescope.functions.text import tokenize


def _word_categories(lexicon: Mapping[str, Sequence[str]]) -> dict[str, str]:
    return {word: category for category, words in lexicon.items() for word in words}


def loaded_words() -> list[str]:
    return list(_word_categories(C.LOADED_WORDS))


def lexicon_scan(
    df: DataFrame, text: str = "text", lexicon: Mapping[str, Sequence[str]] = C.LOADED_WORDS
) -> DataFrame:
    """Add token count, matches in order, distinct matches, loaded rate and its label."""
    words = _word_categories(lexicon)
    category = literal_lookup(words, "string")
    hits = F.filter(F.col("_tokens"), lambda t: t.isin(list(words)))
    return (
        df.withColumn("_tokens", tokenize(text))
        .withColumn("_hits", hits)
        .withColumn("total_tokens", F.size("_tokens").cast("bigint"))
        .withColumn("loaded_word_count", F.size("_hits").cast("bigint"))
        .withColumn(
            "loaded_words",
            F.transform(
                "_hits", lambda w: F.struct(w.alias("word"), category(w).alias("category"))
            ),
        )
        .withColumn("unique_loaded_words", F.size(F.array_distinct("_hits")).cast("bigint"))
        .withColumn("loaded_rate", ratio(F.col("loaded_word_count"), F.col("total_tokens")))
        .withColumn("lexicon_label", lexicon_label(F.col("loaded_rate"), F.col("total_tokens")))
        .drop("_tokens", "_hits")
    )


def category_counts(
    scanned: DataFrame, key: str = "doc_id", lexicon: Mapping[str, Sequence[str]] = C.LOADED_WORDS
) -> DataFrame:
    """Matches per document and category, in long form, without a shuffle."""
    counts = F.array(
        *[
            F.struct(
                F.lit(name).alias("category"),
                F.size(where_equal("loaded_words", "category", name))
                .cast("bigint")
                .alias("match_count"),
            )
            for name in lexicon
        ]
    )
    hits = F.filter(counts, lambda c: c["match_count"] > 0)
    return scanned.select(key, F.inline_outer(hits)).filter("category IS NOT NULL")


def top_loaded_words(scanned: DataFrame, key: str = "doc_id", k: int = 6) -> DataFrame:
    """Distinct matched words per document, most frequent first, ties by word."""

    def counted_words(words: Column) -> Column:
        return F.transform(
            F.array_distinct(words),
            lambda w: F.struct(
                (-F.size(F.filter(words, lambda m: m == w))).alias("order"), w.alias("word")
            ),
        )

    counted = let(F.transform("loaded_words", lambda m: m["word"]), counted_words)
    ranked = F.transform(F.slice(F.array_sort(counted), 1, k), lambda s: s["word"])
    return scanned.select(key, F.array_join(ranked, ", ").alias("top_loaded_words"))


def term_frequency(scanned: DataFrame) -> DataFrame:
    """Corpus-wide (word, category) report; partial aggregation leaves a lexicon-sized shuffle."""
    return (
        scanned.select(F.inline_outer("loaded_words"))
        .filter("word IS NOT NULL")
        .groupBy("word", "category")
        .agg(F.count(F.lit(1)).alias("mentions"))
        .orderBy("word", "category")
    )
