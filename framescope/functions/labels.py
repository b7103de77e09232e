"""Score bucketing: one generic operator and the tables that drive it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from framescope import constants as C


def bucket_label(
    value: Column, bounds: Sequence[float], labels: Sequence[object], closed: bool = False
) -> Column:
    """Label of the first bound above ``value``; ``closed`` makes upper bounds inclusive."""
    branch = None
    for bound, label in zip(bounds, labels, strict=False):
        test = value <= F.lit(bound) if closed else value < F.lit(bound)
        branch = F.when(test, F.lit(label)) if branch is None else branch.when(test, F.lit(label))
    return branch.otherwise(F.lit(labels[len(bounds)]))


def verdict(score: Column) -> Column:
    return bucket_label(score, C.VERDICT_CUTS, C.VERDICT_LABELS)


def verdict_color(score: Column) -> Column:
    return bucket_label(score, C.VERDICT_CUTS, C.VERDICT_COLORS)


def verdict_emoji(score: Column) -> Column:
    return bucket_label(score, C.VERDICT_CUTS, C.VERDICT_EMOJI)


def gauge_bin(score: Column) -> Column:
    return bucket_label(score, C.VERDICT_CUTS, C.GAUGE_LABELS, closed=True)


def score_band(score: Column) -> Column:
    return bucket_label(score, C.BAND_CUTS, C.BAND_LABELS)


def lexicon_label(rate: Column, tokens: Column) -> Column:
    return (
        F.when(tokens == 0, F.lit(C.LEXICON_EMPTY))
        .when(rate == 0, F.lit(C.LEXICON_CLEAN))
        .otherwise(bucket_label(rate, C.LEXICON_CUTS, C.LEXICON_LABELS))
    )


def hedge_label(score: Column, blank: Column) -> Column:
    return F.when(blank, F.lit(C.HEDGE_EMPTY)).otherwise(
        bucket_label(score, C.HEDGE_CUTS, C.HEDGE_LABELS)
    )


def passive_label(score: Column, blank: Column) -> Column:
    return F.when(blank, F.lit("N/A")).otherwise(
        bucket_label(score, C.PASSIVE_CUTS, C.PASSIVE_LABELS)
    )


def subjectivity_label(score: Column) -> Column:
    return bucket_label(score, C.SUBJECTIVITY_CUTS, C.SUBJECTIVITY_LABELS)


def emotion_label(intensity: Column) -> Column:
    return bucket_label(intensity, C.EMOTION_CUTS, C.EMOTION_LABELS)


def sentiment(compound: Column) -> Column:
    return (
        F.when(compound >= 0.05, F.lit("Positive"))
        .when(compound <= -0.05, F.lit("Negative"))
        .otherwise(F.lit("Neutral"))
    )


def opinion_label(ratio: Column, blank: Column) -> Column:
    return F.when(blank, F.lit("N/A")).otherwise(
        bucket_label(ratio, C.OPINION_CUTS, C.OPINION_LABELS)
    )


def frame_label(net: Column) -> Column:
    return (
        F.when(net > 0, F.lit("Positive Framing"))
        .when(net < 0, F.lit("Negative Framing"))
        .otherwise(F.lit("Neutral Framing"))
    )


def ml_label(probability: Column) -> Column:
    return F.when(probability >= 0.5, F.lit(1)).otherwise(F.lit(0))


def ml_label_name(label: Column) -> Column:
    return F.when(label == 1, F.lit("Biased")).otherwise(F.lit("Neutral"))


def leaning_to_label(leaning: Column) -> Column:
    """1 for a leaning, 0 for the centre, -1 for anything unknown."""
    from framescope.functions.text import strip

    cleaned = strip(F.lower(leaning))
    branch = None
    for name, label in C.LEANING_LABELS.items():
        test = cleaned == F.lit(name)
        branch = F.when(test, F.lit(label)) if branch is None else branch.when(test, F.lit(label))
    return branch.otherwise(F.lit(-1))
