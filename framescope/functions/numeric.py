"""Rounding with one definition that any IEEE engine reproduces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(value: Column, digits: int = 4) -> Column:
    """Round half up with plain double arithmetic: ``floor(x * 10^d + 0.5) / 10^d``."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def ratio(part: Column, whole: Column) -> Column:
    """``part / max(whole, 1)`` as a double; safe under ANSI mode."""
    return part.cast("double") / F.greatest(whole.cast("double"), F.lit(1.0))
