"""One aggregation: fact, LEFT JOINs to dimensions, WHERE, GROUP BY."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import ident
from ..plans.spec import Branch, DimJoin

#: Gives the DataFrame of a dataset (group, name) or, with group None, of a dimension.
Table = Callable[["str | None", str], DataFrame]

AGGREGATES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}


def join_dimension(fact: DataFrame, dim: DataFrame, j: DimJoin) -> DataFrame:
    """LEFT JOIN with the dimension's columns under names that clash with none of the fact's.

    The strategy is left to Catalyst: small dimensions are broadcast by their size, others are
    shuffled, and adaptive execution splits skewed keys.
    """
    key = f"{j.prefix}::__key"
    cols = [F.col(ident(c)).alias(f"{j.prefix}::{c}") for c in j.columns]
    dim = dim.select(F.col(ident(j.right_key)).alias(key), *cols)
    return fact.join(dim, F.col(ident(j.left_key)) == F.col(ident(key)), "left")


def branch_frame(b: Branch, table: Table) -> DataFrame:
    df = table(b.group, b.dataset)
    for j in b.joins:
        df = join_dimension(df, table(None, j.dimension), j)
    for test in b.filters:
        df = df.where(F.expr(test))
    keys = [F.expr(sql).alias(name) for name, sql in b.keys]
    sums = [AGGREGATES[how](F.expr(sql)).alias(name) for name, how, sql in b.measures]
    if not sums and keys:
        df = df.select(*keys).distinct()
    else:
        df = df.groupBy(*keys).agg(*(sums or [F.count(F.lit(1)).alias("m::rows")]))
    return df.select(*(F.expr(sql).alias(name) for name, sql in b.outputs))
