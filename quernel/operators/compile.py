"""QuerySpec to DataFrame.  Nothing runs here; Catalyst plans the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spec import QuerySpec, Stitch
from . import combine
from .branch import Table, branch_frame


def part_frame(part, table: Table) -> DataFrame:
    if isinstance(part, Stitch):
        return combine.stitch([branch_frame(b, table) for b in part.parts], part)
    return branch_frame(part, table)


def compile_spec(spark: SparkSession, spec: QuerySpec, table: Table, ordered: bool = True) -> DataFrame:
    """``ordered=False`` leaves out the final sort, for callers that aggregate or write on."""
    if spec.combine == "values":
        df = combine.values(spark, spec.outputs, spec.types, spec.values)
    else:
        df = combine.union_all([part_frame(p, table) for p in spec.parts])
        if spec.combine == "union_sum":
            df = combine.summed(df, [o for o in spec.outputs if o not in spec.sums], spec.sums)
        elif spec.combine == "empty":
            df = df.where(F.lit(False))
    return combine.in_order(df, spec.sort) if ordered else df
