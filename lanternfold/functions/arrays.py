"""Small helpers for higher-order functions over row-local arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unnest(df: DataFrame, array: Column | str, pos: str, item: str, *keep: str) -> DataFrame:
    """``posexplode`` for computed arrays.

    The inner form makes the optimizer infer a "not empty" filter, which it pushes
    below the projections by repeating the whole array expression. The outer form
    does not, and dropping its empty rows afterwards gives the same result.
    """
    kept = [F.col(c) for c in keep] or [F.col("*")]
    return df.select(*kept, F.posexplode_outer(array).alias(pos, item)).filter(F.col(item).isNotNull())


def at(array: Column, index: Column) -> Column:
    """Zero-based element, NULL outside the array."""
    return F.get(array, index)


def string_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")
