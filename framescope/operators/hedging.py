"""Hedging: epistemic hedges and certainty inflators per sentence.

The definition is a sentence x phrase containment join. Both sides of it live in one row, so it is
evaluated inside the row: the whole text is searched once for all phrases together, only phrases that occur
at all are then looked up sentence by sentence, and only sentences that contain one are split into
words to check the word bounds.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope import constants as C
from framescope.functions.binding import let, where_equal
from framescope.functions.labels import hedge_label
from framescope.functions.numeric import ratio
from framescope.functions.text import is_blank, mark_phrase, mark_words, split_sentences_abbrev

PHRASES: dict[str, list[str]] = {
    "epistemic": C.EPISTEMIC_PHRASES,
    "inflation": C.CERTAINTY_PHRASES,
}


def _phrase_literals(phrases: Mapping[str, Sequence[str]]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(phrase).alias("phrase"),
                F.lit(kind).alias("kind"),
                F.lit(mark_phrase(phrase)).alias("mark"),
            )
            for kind, group in phrases.items()
            for phrase in group
        ]
    )


def _trie_pattern(phrases: Sequence[str]) -> str:
    """Regex for the longest of the phrases at a place; common beginnings are tested once."""
    ends = "" in phrases
    rests: dict[str, list[str]] = {}
    for phrase in phrases:
        if phrase:
            rests.setdefault(phrase[0], []).append(phrase[1:])
    branches = "|".join(first + _trie_pattern(rest) for first, rest in sorted(rests.items()))
    if ends:
        return f"(?:{branches})?" if branches else ""
    return branches if len(rests) == 1 else f"(?:{branches})"


def present_phrases(text: Column, phrases: Mapping[str, Sequence[str]] = PHRASES) -> Column:
    """The phrases that a text may contain as whole words, as (phrase, kind, mark), in their order.

    Phrases of plain words are searched in one pass over the word starts; the others one by one. None that occurs is left out.
    """
    literals = _phrase_literals(phrases)
    plain = sorted({p for group in phrases.values() for p in group if re.fullmatch(r"[a-z]+( [a-z]+)*", p)})
    others = [p for group in phrases.values() for p in group if p not in set(plain)]

    def chosen(lowered: Column) -> Column:
        if not plain:
            return F.filter(literals, lambda p: lowered.contains(p["phrase"]))
        # Of the phrases that begin at one place the longest is found, and the others are its beginnings.
        rule = f"(?<![a-z])(?=({_trie_pattern(plain)}))"

        def of_found(found: Column) -> Column:
            def occurs(p: Column) -> Column:
                hit = F.exists(found, lambda f: f.startswith(p["phrase"]))
                return hit | (p["phrase"].isin(others) & lowered.contains(p["phrase"])) if others else hit

            some = F.filter(literals, occurs)
            return some if others else F.when(F.size(found) > 0, some).otherwise(F.slice(literals, 1, 0))

        return let(F.array_distinct(F.regexp_extract_all(lowered, F.lit(rule), F.lit(1))), of_found)

    return let(F.lower(F.coalesce(text, F.lit(""))), chosen)


def hedge_scan(
    df: DataFrame,
    text: str = "text",
    phrases: Mapping[str, Sequence[str]] = PHRASES,
    weights: Mapping[str, float] = C.HEDGE_WEIGHTS,
    split: Column | None = None,
) -> DataFrame:
    """Add ``hedge_matches`` plus counts, rates, score and label.

    A phrase counts once per sentence however often it occurs there; rates are over distinct
    flagged sentences. ``split`` is the sentence array of the text, when it is already at hand.
    """
    def matches_of(sentence: Column, idx: Column, present: Column) -> Column:
        """Plain containment first; word bounds are only checked where it holds."""
        nothing = F.filter(present, lambda p: F.lit(False))
        return F.transform(
            let(
                let(F.lower(sentence), lambda lowered: F.filter(present, lambda p: lowered.contains(p["phrase"]))),
                lambda likely: F.when(F.size(likely) == 0, nothing).otherwise(
                    let(
                        mark_words(sentence),
                        lambda marked: F.filter(likely, lambda p: marked.contains(p["mark"])),
                    )
                ),
            ),
            lambda p: F.struct(
                idx.cast("bigint").alias("sentence_idx"),
                p["phrase"].alias("phrase"),
                p["kind"].alias("kind"),
                sentence.alias("sentence"),
            ),
        )

    def match_sentences(sentences: Column, present: Column) -> Column:
        read = F.when(F.size(present) > 0, sentences).otherwise(F.slice(sentences, 1, 0))
        return F.flatten(F.transform(read, lambda s, i: matches_of(s, i, present)))

    present = present_phrases(F.col(text), phrases)
    scanned = let(
        split_sentences_abbrev(text) if split is None else split,
        lambda sentences: F.struct(
            F.size(sentences).cast("bigint").alias("n"),
            let(present, lambda found: match_sentences(sentences, found)).alias("matches"),
        ),
    )
    out = (
        df.withColumn("_hedge", scanned)
        .withColumn("hedge_matches", F.col("_hedge.matches"))
        .withColumn("hedge_sentences", F.col("_hedge.n"))
    )
    for kind in ("epistemic", "inflation"):
        of_kind = where_equal("hedge_matches", "kind", kind)
        flagged = F.array_distinct(F.transform(of_kind, lambda m: m["sentence_idx"]))
        out = out.withColumn(f"{kind}_count", F.size(of_kind).cast("bigint")).withColumn(
            f"{kind}_rate", ratio(F.size(flagged), F.col("hedge_sentences"))
        )
    score = F.least(
        F.lit(weights["epistemic"]) * F.col("epistemic_rate")
        + F.lit(weights["inflation"]) * F.col("inflation_rate"),
        F.lit(1.0),
    )
    return (
        out.withColumn("hedge_score", score)
        .withColumn("hedge_label", hedge_label(F.col("hedge_score"), is_blank(text)))
        .drop("_hedge")
    )


def hedge_matches(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Long form: one row per (sentence, phrase)."""
    rows = scanned.select(key, F.inline_outer("hedge_matches"))
    return rows.filter("sentence_idx IS NOT NULL")


def flagged_sentences(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per flagged sentence with its phrases by kind and its type."""

    def flagged(matches: Column) -> Column:
        def phrases_of(idx: Column, kind: str) -> Column:
            chosen = F.filter(
                matches, lambda m: (m["sentence_idx"] == idx) & (m["kind"] == F.lit(kind))
            )
            return F.transform(chosen, lambda m: m["phrase"])

        return F.transform(
            F.array_distinct(
                F.transform(matches, lambda m: F.struct(m["sentence_idx"], m["sentence"]))
            ),
            lambda s: F.struct(
                s["sentence_idx"].alias("sentence_idx"),
                s["sentence"].alias("sentence"),
                phrases_of(s["sentence_idx"], "epistemic").alias("epistemic_phrases"),
                phrases_of(s["sentence_idx"], "inflation").alias("inflation_phrases"),
            ),
        )

    kind = (
        F.when((F.size("epistemic_phrases") > 0) & (F.size("inflation_phrases") > 0), "both")
        .when(F.size("epistemic_phrases") > 0, "epistemic")
        .otherwise("inflation")
    )
    return (
        scanned.select(key, F.inline_outer(let(F.col("hedge_matches"), flagged)))
        .filter("sentence_idx IS NOT NULL")
        .withColumn("flag_type", kind)
    )


def hedge_summary(scanned: DataFrame) -> DataFrame:
    """Add a one-sentence summary of the hedging result."""
    label = F.concat(
        F.upper(F.substring("hedge_label", 1, 1)),
        F.lower(F.expr("substring(hedge_label, 2)")),
    )
    cents = F.floor(F.col("hedge_score") * 100.0 + 0.5).cast("bigint")
    score = F.concat(
        F.floor(cents / 100).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad((cents % 100).cast("string"), 2, "0"),
    )
    epistemic = F.concat(
        F.col("epistemic_count").cast("string"),
        F.lit(C.EPISTEMIC_FOUND),
    )
    inflation = F.concat(
        F.col("inflation_count").cast("string"),
        F.lit(C.INFLATION_FOUND),
    )
    details = F.concat_ws(
        " ",
        F.when(F.col("epistemic_count") > 0, epistemic),
        F.when(F.col("inflation_count") > 0, inflation),
    )
    summary = F.when(
        F.col("hedge_score") < 0.05, F.lit(C.NO_HEDGING)
    ).otherwise(F.concat(label, F.lit(C.HEDGING_DETECTED), score, F.lit("). "), details))
    return scanned.withColumn("hedge_summary", summary)
