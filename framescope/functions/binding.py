"""Evaluate an expression once and use it many times, inside one expression.

Staging a value in a helper column is not enough: when a later filter or generator is pushed below
the projection, the helper is copied into every place that uses it, and inside a lambda that means
once per array element. A value bound here is a lambda variable, which no rule can copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def where_equal(array: Column | str, field: str, value: object) -> Column:
    """Elements of an array of structs whose field has a constant value."""
    return F.filter(array, lambda e: e[field] == F.lit(value))


def settle(df: DataFrame, *names: str) -> DataFrame:
    """Compute the named columns once per row, wherever they are used later.

    Spark pushes a filter on a computed column below the projection and copies the whole expression into
    it. Columns that come out of a generator stay where they are: one struct per row goes through an
    outer one, which no filter crosses. No shuffle; the columns are computed even if not selected.
    """
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline_outer(F.array(F.struct(*names)))).select(*df.columns)
