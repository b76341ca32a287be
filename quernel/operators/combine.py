"""How branches come together: side by side, one below the other, summed up, sorted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import ident
from ..plans.spec import Stitch


def full_join(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """FULL OUTER JOIN on all keys, nulls equal to each other; keys are coalesced.

    Both sides are aggregated to one row a key before, so neither fans out.
    """
    other = b.select(*(F.col(ident(k)).alias(f"r::{k}") if k in keys else F.col(ident(k)) for k in b.columns))
    on = reduce(lambda x, y: x & y, (F.col(ident(k)).eqNullSafe(F.col(ident(f"r::{k}"))) for k in keys))
    merged = [F.coalesce(F.col(ident(k)), F.col(ident(f"r::{k}"))).alias(k) for k in keys]
    rest = [F.col(ident(c)) for c in [*a.columns, *b.columns] if c not in keys]
    return a.join(other, on, "full").select(*merged, *rest)


def stitch(frames: list[DataFrame], s: Stitch) -> DataFrame:
    """The parts of a Stitch joined, then its outputs."""
    one = reduce(lambda a, b: full_join(a, b, s.keys) if s.keys else a.crossJoin(b), frames)
    return one.select(*(F.expr(sql).alias(name) for name, sql in s.outputs))


def join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str) -> DataFrame:
    """An equality join on one key a side: inner, left, right or full; all columns of both."""
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"unknown join type {how!r}")
    return left.join(right, left[ident(left_key)] == right[ident(right_key)], how)


def join_counts(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str, left_column: str, right_column: str) -> DataFrame:
    """How many rows ``join`` has (``n``), and how many with a value in a column of either side.

    Both sides are counted by key before, and two keys that meet stand for the product of their rows:
    the join has a row a key, however many rows share one.
    """

    def by_key(df: DataFrame, side: str, key: str, column: str) -> DataFrame:
        return df.groupBy(F.col(ident(key)).alias(f"{side}::key")).agg(F.count(F.lit(1)).alias(f"{side}::n"), F.count(F.col(ident(column))).alias(f"{side}::known"))

    both = join(by_key(left, "l", left_key, left_column), by_key(right, "r", right_key, right_column), "l::key", "r::key", how)
    a, b = (F.coalesce(F.col(ident(f"{side}::n")), F.lit(1)) for side in "lr")  # what has no match stands once for each of its rows
    counts = {"n": a * b, "left_rows": F.col(ident("l::known")) * b, "right_rows": F.col(ident("r::known")) * a}
    return both.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(name) for name, x in counts.items()))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """By position, duplicates kept; every branch selects the same outputs in order."""
    return reduce(DataFrame.union, frames)


def summed(df: DataFrame, keys: list[str], sums: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*(F.col(ident(k)) for k in keys)).agg(*(F.sum(F.col(ident(m))).alias(m) for m in sums))


def in_order(df: DataFrame, paths: tuple[str, ...], descending: bool = False) -> DataFrame:
    """Sorted by output columns, nulls last in either direction."""
    if not paths:
        return df
    return df.orderBy(*((F.col(ident(p)).desc_nulls_last() if descending else F.col(ident(p)).asc_nulls_last()) for p in paths))


def values(spark: SparkSession, names: tuple[str, ...], types: tuple[str, ...], rows: tuple[tuple, ...]) -> DataFrame:
    """Rows that need no table; none at all is an empty result with its schema."""
    return spark.createDataFrame(list(rows), ", ".join(f"{ident(n)} {t}" for n, t in zip(names, types, strict=True)))
