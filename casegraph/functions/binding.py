"""Name a value once inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once. Without this, an expression that mentions its input many times
    is copied into the plan that often, and nesting such functions multiplies the copies."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_bound(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and join keys refer to by name.

    After a plain `withColumn`, a filter on the new column is pushed below it with the whole expression copied in (and
    again for every inferred not-null test), so costly text expressions run several times. A one-row generator keeps
    the computed value and the filter on it apart."""
    packed = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(packed)))


def explode_rows(df: DataFrame, array: Column, name: str, *keep: str | Column, position: str | None = None) -> DataFrame:
    """`keep` columns plus one row per array element (NULL elements dropped).

    A plain `explode` of an expression makes the optimizer test `size(expression) > 0` in a filter below it, which runs
    the expression twice; the outer form followed by a filter on the generated column runs it once."""
    if position:
        rows = df.select(*keep, F.posexplode_outer(array).alias(position, name))
    else:
        rows = df.select(*keep, F.explode_outer(array).alias(name))
    return rows.filter(F.col(name).isNotNull())
