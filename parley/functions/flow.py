"""Shaping how an expression is evaluated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use ``value`` several times in ``body`` but compute it once per row."""
    return F.transform(F.array(value), body)[0]


def hold(df: DataFrame, *names: str) -> DataFrame:
    """Keep the computed columns as they are in later expressions.

    Spark merges stacked projections, which repeats a costly column wherever
    it is used and cannot place a Python function inside a lambda. A
    one-element generator between the two keeps them apart.
    """
    rest = [F.col(c) for c in df.columns if c not in names]
    kept = F.inline(F.array(F.struct(*[F.col(n) for n in names])))
    return df.select(*rest, kept)
