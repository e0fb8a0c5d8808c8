"""Local names inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once and use it many times, so the expression stays small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settled(df: DataFrame) -> DataFrame:
    """The same rows with costly columns computed here: later filters, join keys and projections
    use their values instead of repeating the expressions."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
