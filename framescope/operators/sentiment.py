"""Emotional intensity and subjectivity from word tables.

The valence rules are those of Hutto and Gilbert (2014): negation, boosters and dampeners within
three preceding words, capitals, contrast and punctuation emphasis. All rules look at most three
words back, so they are evaluated on the word array of the row; no window, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope import constants as C
from framescope.functions import labels
from framescope.functions.binding import let
from framescope.functions.lookup import (
    MAX_SHARED_ENTRIES,
    TooManyEntries,
    fits_literal,
    literal_lookup,
    shared_lookup,
)
from framescope.functions.numeric import round_to
from framescope.functions.text import SPACE, count_char

WordTable = Mapping[str, tuple[float, float]]
#: Word lists of up to this length are tested as a set.
MAX_SET_WORDS = 1_000


def read_word_table(table: DataFrame, limit: int = MAX_SHARED_ENTRIES) -> dict[str, tuple[float, float]]:
    """Load a ``(word, valence, subjectivity)`` table, refusing more rows than ``limit``."""
    rows = table.select("word", "valence", "subjectivity").limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooManyEntries(f"word table has more than {limit} rows")
    return {r["word"]: (r["valence"], r["subjectivity"]) for r in rows}


def emotion_words(text: Column) -> Column:
    """Case-preserving words without surrounding punctuation, at least two characters long."""
    # Punctuation next to whitespace is part of the separator, so words need no cleaning of their own.
    # The look-behind keeps long runs of punctuation linear.
    trimmed = F.regexp_replace(
        F.coalesce(text, F.lit("")), r"^\p{Punct}+|(?<!\p{Punct})\p{Punct}+$", ""
    )
    words = F.split(trimmed, rf"(?:(?<!\p{{Punct}})\p{{Punct}}+)?[{SPACE}]+\p{{Punct}}*")
    # No character has more than four bytes, so most words need not be counted.
    return F.filter(words, lambda w: (F.octet_length(w) > 4) | (F.length(w) > 1))


def _is_upper(word: Column) -> Column:
    """The test that most words fail comes first."""
    return (F.lower(word) != word) & (F.upper(word) == word)


class Modifiers(NamedTuple):
    """Words that change the valence of what follows, unless they have a valence themselves."""

    boosters: Sequence[str] = C.BOOSTERS
    dampeners: Sequence[str] = C.DAMPENERS
    negators: Sequence[str] = C.NEGATORS


class _Values(NamedTuple):
    """Valence and subjectivity of the words of a lower-cased array, by place; null where a word is not listed."""

    valence: Callable[[Column, Column], Column]
    subjectivity: Callable[[Column, Column], Column]
    #: Whether a lower-cased word, with its place, has a valence.
    listed: Callable[[Column, Column], Column]


def _listed_places(values: _Values, words: Column, lowered: bool = True) -> Column:
    """Places of the words with a valence, ascending; words that are not ``lowered`` yet are for the test."""

    def listed(i: Column) -> Column:
        word = F.get(words, i)
        return values.listed(word if lowered else F.lower(word), i)

    # Of no words the places are 0 and -1, where none is found.
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), listed)


def _word_values(df: DataFrame, words: WordTable, split: Column) -> tuple[DataFrame, _Values]:
    """The frame with what it needs, and access to the values of the words of ``split``.

    A table that fits is a literal in the expression; a larger one is matched beforehand, into
    arrays as long as the word array (``_valences`` and ``_subjectivities``, to be dropped later).
    """
    valence, subjectivity = ({w: v[i] for w, v in words.items()} for i in (0, 1))
    if fits_literal(words):
        v, s = literal_lookup(valence, "double"), literal_lookup(subjectivity, "double")
        listed = [w for w, known in valence.items() if known is not None]

        def is_listed(word: Column, i: Column) -> Column:
            # Nearly every word is absent, which a set tells fastest; a long one is slow to plan.
            return word.isin(listed) if len(listed) <= MAX_SET_WORDS else v(word).isNotNull()

        return df, _Values(lambda lower, i: v(F.get(lower, i)), lambda lower, i: s(F.get(lower, i)), is_listed)
    tables = {"_valences": (valence, "double"), "_subjectivities": (subjectivity, "double")}
    matched = shared_lookup(df, F.transform(split, F.lower), tables)
    return matched, _Values(
        lambda lower, i: F.get(F.col("_valences"), i),
        lambda lower, i: F.get(F.col("_subjectivities"), i),
        lambda word, i: F.get(F.col("_valences"), i).isNotNull(),
    )


def _valence_sum(
    values: _Values, raw: Column, modifiers: Modifiers, lower: Column | None = None, places: Column | None = None
) -> Column:
    """Sum of the adjusted valences of a word array.

    ``lower`` is the array in lower case and ``places`` those of its words with a valence, when at hand.
    """
    decays = F.array(*[F.lit(d) for d in C.BOOST_DECAY])

    def adjusted(index: Column, raw: Column, lower: Column, mixed: Column, but: Column) -> Column:
        base = values.valence(lower, index)
        capital = mixed & _is_upper(F.get(raw, index))
        start = base + F.when(capital, F.signum(base) * C.CAPS_STEP).otherwise(0.0)

        def look_back(value: Column, distance: Column) -> Column:
            place = index - distance
            before = F.when(place >= 0, F.get(lower, place)).otherwise(F.lit(""))
            written = F.when(place >= 0, F.get(raw, place)).otherwise(F.lit(""))
            caps = F.when(mixed & _is_upper(written), F.lit(C.CAPS_STEP)).otherwise(0.0)
            step = (
                F.when(before.isin(list(modifiers.boosters)), caps + C.BOOST_STEP)
                .when(before.isin(list(modifiers.dampeners)), caps - C.BOOST_STEP)
                .otherwise(F.lit(0.0))
            )
            negates = before.isin(list(modifiers.negators)) | before.rlike(C.NEGATED_ENDING)
            factor = F.when(negates, C.NEGATION_FACTOR).otherwise(F.lit(1.0))
            changed = (value + F.signum(value) * step * F.get(decays, distance - 1)) * factor
            listed = (place >= 0) & values.listed(F.get(lower, place), place)
            return F.when(listed, value).otherwise(changed)

        value = F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), start, look_back)
        contrast = (
            F.when(but == 0, F.lit(1.0))
            .when(index < but - 1, F.lit(C.BUT_BEFORE))
            .otherwise(F.lit(C.BUT_AFTER))
        )
        return value * contrast

    def total(state: Column) -> Column:
        raw, lower = state["raw"], state["lower"]
        flags = F.struct(
            (F.exists(raw, lambda w: ~_is_upper(w)) & F.exists(raw, _is_upper)).alias("mixed"),
            F.array_position(lower, C.CONTRAST).alias("but"),
        )

        def summed(hits: Column) -> Column:
            added = let(
                flags,
                lambda f: F.aggregate(
                    hits,
                    F.lit(0.0),
                    lambda acc, i: acc + adjusted(i, raw, lower, f["mixed"], f["but"]),
                ),
            )
            return F.when(F.size(hits) > 0, added).otherwise(F.lit(0.0))

        return let(_listed_places(values, lower) if places is None else places, summed)

    def cased(r: Column) -> Column:
        return F.struct(r.alias("raw"), (F.transform(r, F.lower) if lower is None else lower).alias("lower"))

    return let(raw, lambda r: let(cased(r), total))


def emotion_intensity(
    df: DataFrame,
    text: str = "text",
    words: WordTable = C.SENTIMENT_WORDS,
    split: Column | None = None,
    modifiers: Modifiers = Modifiers(),
) -> DataFrame:
    """Add compound in [-1, 1], its absolute value, the intensity label and the sentiment.

    A preceding word modifies only if it is not in ``words``; words in n't negate like the negators.
    ``split`` is the word array of the text, when it is already at hand. Tables of any size up to
    ``MAX_SHARED_ENTRIES`` give the same scores.
    """
    tokens = emotion_words(F.col(text)) if split is None else split
    matched, values = _word_values(df, words, tokens)
    return _emotion(matched, text, values, tokens, modifiers).drop("_valences", "_subjectivities")


def _emotion(
    df: DataFrame,
    text: str,
    values: _Values,
    tokens: Column,
    modifiers: Modifiers,
    lower: Column | None = None,
    places: Column | None = None,
) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    questions = count_char(body, "?")
    emphasis = F.least(count_char(body, "!"), F.lit(C.EXCLAMATION_MAX)) * C.EXCLAMATION_STEP + (
        F.when(questions <= 1, F.lit(0.0))
        .when(questions <= 3, questions * C.QUESTION_STEP)
        .otherwise(F.lit(C.QUESTION_MAX))
    )

    def compound(total: Column) -> Column:
        # A sum of cancelling valences is zero up to rounding.
        shifted = total + F.signum(total) * emphasis
        return F.when(F.abs(total) < 1e-9, F.lit(0.0)).otherwise(
            shifted / F.sqrt(shifted * shifted + C.COMPOUND_ALPHA)
        )

    return (
        df.withColumn("compound", let(_valence_sum(values, tokens, modifiers, lower, places), compound))
        .withColumn("emotion_intensity", round_to(F.abs("compound")))
        .withColumn("emotion_label", labels.emotion_label(F.col("emotion_intensity")))
        .withColumn("sentiment", labels.sentiment(F.col("compound")))
    )


def subjectivity(
    df: DataFrame,
    text: str = "text",
    words: WordTable = C.SENTIMENT_WORDS,
    boosters: Sequence[str] = C.BOOSTERS,
    dampeners: Sequence[str] = C.DAMPENERS,
    boost: float = 1.3,
    dampen: float = 0.7,
    split: Column | None = None,
) -> DataFrame:
    """Add the mean subjectivity of listed words (0 when none) and mean polarity.

    A modifier scales the next word; a scaled value is capped at 1.
    """
    tokens = emotion_words(F.col(text)) if split is None else split
    matched, values = _word_values(df, words, tokens)
    scored = _subjectivity(matched, values, tokens, boosters, dampeners, boost, dampen)
    return scored.drop("_valences", "_subjectivities")


def _subjectivity(
    df: DataFrame,
    values: _Values,
    tokens: Column,
    boosters: Sequence[str],
    dampeners: Sequence[str],
    boost: float = 1.3,
    dampen: float = 0.7,
    lowered: Column | None = None,
    places: Column | None = None,
) -> DataFrame:
    def hits(lower: Column) -> Column:
        def scored(index: Column) -> Column:
            before = F.when(index > 0, F.get(lower, index - 1)).otherwise(F.lit(""))
            factor = (
                F.when(before.isin(list(boosters)), F.lit(boost))
                .when(before.isin(list(dampeners)), F.lit(dampen))
                .otherwise(F.lit(1.0))
            )
            return F.struct(
                F.least(values.subjectivity(lower, index) * factor, F.lit(1.0)).alias("s"),
                values.valence(lower, index).alias("v"),
            )

        return F.transform(_listed_places(values, lower) if places is None else places, scored)

    def means(found: Column) -> Column:
        count = F.greatest(F.size(found), F.lit(1))

        def mean(field: str) -> Column:
            return F.aggregate(found, F.lit(0.0), lambda acc, h: acc + h[field]) / count

        return F.struct(mean("s").alias("s"), mean("v").alias("v"))

    lower = F.transform(tokens, F.lower) if lowered is None else lowered
    polarity = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_means.v") / 4.0))
    return (
        df.withColumn("_means", let(let(lower, hits), means))
        .withColumn("subjectivity", F.col("_means.s"))
        .withColumn("polarity", polarity)
        .withColumn("subjectivity_score", round_to(F.col("subjectivity")))
        .withColumn("subjectivity_label", labels.subjectivity_label(F.col("subjectivity_score")))
        .drop("_means")
    )


def auxiliary_scores(
    df: DataFrame,
    text: str = "text",
    words: WordTable = C.SENTIMENT_WORDS,
    modifiers: Modifiers = Modifiers(),
) -> DataFrame:
    """Both scores in one pass over the rows; the text is split into words once."""
    split, lower, places = (F.col(c) for c in ("_emotion_words", "_emotion_lower", "_emotion_places"))
    matched, values = _word_values(df.withColumn("_emotion_words", emotion_words(F.col(text))), words, split)
    matched = matched.withColumn("_emotion_places", _listed_places(values, split, lowered=False))
    # The words around a listed one are read in lower case; most texts without any need no other array.
    matched = matched.withColumn(
        "_emotion_lower", F.when(F.size(places) > 0, F.transform(split, F.lower)).otherwise(F.slice(split, 1, 0))
    )
    scored = _emotion(matched, text, values, split, modifiers, lower, places)
    scored = _subjectivity(
        scored, values, split, modifiers.boosters, modifiers.dampeners, lowered=lower, places=places
    )
    return scored.drop("_emotion_words", "_emotion_lower", "_emotion_places", "_valences", "_subjectivities")
