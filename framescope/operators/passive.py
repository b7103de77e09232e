"""Passive voice by rule: be-form, optional adverb, participle.

A dependency parser can be plugged in with :func:`passive_with_parser`; the default rule stays in
the JVM and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope import constants as C
from framescope.functions.binding import let
from framescope.functions.labels import passive_label
from framescope.functions.numeric import ratio, round_to
from framescope.functions.text import WORD, WS, is_blank, split_sentences_abbrev


def passive_pattern(
    be_forms: Sequence[str] = C.BE_FORMS, participles: Sequence[str] = C.IRREGULAR_PARTICIPLES
) -> str:
    """Regex with two groups: auxiliary verb and main verb."""
    be = "|".join(be_forms)
    verb = "|".join([r"\p{L}+ed", *participles])
    return (
        rf"(?i)(?:^|[^{WORD}])({be})[{WS}]+(?:\p{{L}}+ly[{WS}]+)?({verb})(?:$|[^{WORD}])"
    )


def responsibility_gap(sentence: Column) -> Column:
    """A passive indicator without an agent introduced by ``by``."""
    lowered = F.lower(sentence)
    indicated = None
    for indicator in C.PASSIVE_INDICATORS:
        test = lowered.contains(indicator)
        indicated = test if indicated is None else indicated | test
    return indicated & ~lowered.contains(" by ")


def passive_scan(
    df: DataFrame,
    text: str = "text",
    pattern: str | None = None,
    excluded: Sequence[str] = C.NOT_PARTICIPLES,
    split: Column | None = None,
) -> DataFrame:
    """Add ``passive_sentences`` (array of structs) and ``passive_total``, the sentence count.

    A sentence is passive by its first match whose verb is not ``excluded``. ``split`` is the sentence array of
    the text, when it is already at hand.
    """
    rule = pattern or passive_pattern()

    def flag(sentences: Column) -> Column:
        tested = F.transform(
            sentences,
            lambda s, i: F.struct(
                i.cast("bigint").alias("sentence_idx"),
                s.alias("sentence"),
                F.regexp_extract(s, rule, 1).alias("aux_verb"),
            ),
        )
        # Few sentences match at all; only those are searched for all their matches.
        matched = F.transform(
            F.filter(tested, lambda p: p["aux_verb"] != ""),
            lambda p: F.struct(
                p["sentence_idx"].alias("sentence_idx"),
                p["sentence"].alias("sentence"),
                F.lit("auxpass").alias("pattern"),
                F.get(
                    F.filter(
                        F.arrays_zip(
                            F.regexp_extract_all(p["sentence"], F.lit(rule), F.lit(1)).alias("aux"),
                            F.regexp_extract_all(p["sentence"], F.lit(rule), F.lit(2)).alias("verb"),
                        ),
                        lambda m: ~F.lower(m["verb"]).isin(list(excluded)),
                    ),
                    F.lit(0),
                ).alias("verbs"),
                responsibility_gap(p["sentence"]).alias("is_gap"),
            ),
        )
        return F.transform(
            F.filter(matched, lambda p: p["verbs"].isNotNull()),
            lambda p: F.struct(
                p["sentence_idx"].alias("sentence_idx"),
                p["sentence"].alias("sentence"),
                p["pattern"].alias("pattern"),
                p["verbs"]["aux"].alias("aux_verb"),
                p["verbs"]["verb"].alias("main_verb"),
                p["is_gap"].alias("is_gap"),
            ),
        )

    scanned = let(
        split_sentences_abbrev(text) if split is None else split,
        lambda sentences: F.struct(
            F.size(sentences).cast("bigint").alias("n"), flag(sentences).alias("flagged")
        ),
    )
    return (
        df.withColumn("_passive", scanned)
        .withColumn("passive_total", F.col("_passive.n"))
        .withColumn("passive_sentences", F.col("_passive.flagged"))
        .drop("_passive")
    )


def passive_score(scanned: DataFrame, text: str = "text") -> DataFrame:
    """Add counts, 4-digit rate, agentless penalty, score, label and the signal message."""
    percent = F.floor(F.col("passive_rate") * 100.0 + 0.5).cast("bigint").cast("string")
    message = F.concat_ws(
        " ",
        F.concat(
            F.col("passive_count").cast("string"),
            F.lit(" of "),
            F.col("passive_total").cast("string"),
            F.lit(" sentences use passive voice ("),
            percent,
            F.lit("%)."),
        ),
        F.when(
            F.col("gap_count") > 0,
            F.concat(
                F.col("gap_count").cast("string"),
                F.lit(C.PASSIVE_GAPS),
            ),
        ),
    )
    gaps = F.filter("passive_sentences", lambda p: p["is_gap"])
    penalty = F.least(F.col("gap_count") * F.lit(0.1), F.lit(0.3))
    return (
        scanned.withColumn("passive_count", F.size("passive_sentences").cast("bigint"))
        .withColumn("gap_count", F.size(gaps).cast("bigint"))
        .withColumn(
            "passive_rate", round_to(ratio(F.col("passive_count"), F.col("passive_total")))
        )
        .withColumn(
            "passive_score",
            round_to(F.least(F.col("passive_rate") + penalty, F.lit(1.0))),
        )
        .withColumn("passive_label", passive_label(F.col("passive_score"), is_blank(text)))
        .withColumn(
            "passive_signal",
            F.when(F.col("passive_total") == 0, F.lit(C.NO_TEXT))
            .when(
                F.col("passive_count") == 0,
                F.lit(C.NO_PASSIVE),
            )
            .otherwise(message),
        )
    )


def passive_sentences(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Long form: one row per passive sentence."""
    rows = scanned.select(key, F.inline_outer("passive_sentences"))
    return rows.filter("sentence_idx IS NOT NULL")


PARSED = T.ArrayType(
    T.StructType(
        [
            T.StructField("sentence_idx", T.LongType()),
            T.StructField("sentence", T.StringType()),
            T.StructField("pattern", T.StringType()),
            T.StructField("aux_verb", T.StringType()),
            T.StructField("main_verb", T.StringType()),
            T.StructField("is_gap", T.BooleanType()),
        ]
    )
)


def passive_with_parser(
    df: DataFrame, parse: Callable[[str], tuple[int, list[dict]]], text: str = "text"
) -> DataFrame:
    """Same columns as :func:`passive_scan`, from a user-supplied parser.

    ``parse`` maps a text to (sentence count, passive sentences); it runs in Arrow batches next to
    the data, so a loaded model is shared by the batches of a task.
    """
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("passive_total", T.LongType()),
            T.StructField("passive_sentences", PARSED),
        ]
    )

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            parsed = [parse(value or "") for value in batch[text]]
            yield batch.assign(
                passive_total=[p[0] for p in parsed], passive_sentences=[p[1] for p in parsed]
            )

    return df.mapInPandas(run, schema)
