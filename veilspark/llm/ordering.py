"""Places of rows within groups, by ranges of one total order: no group is a window, however large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import stored


def placed(rows: DataFrame, group: list[str], order: list[Column], out: str = "__place") -> DataFrame:
    """``rows`` with ``out``: the place (from 0) of a row within its group, by ``order``.

    All rows are dealt into ranges of (group, order, place in the input) and
    sorted there, so a group with a third of all rows, or as many rows that tie,
    lies in many ranges.  A row's place is its place in its range and the sizes
    of the ranges before, less where its group starts; what is added up is one
    number a range and one a group.  Rows that tie keep no order of their own.
    The numbered rows are a stored table, so a lost executor renumbers nothing.
    """
    tie, at = "__tie", "__at"
    keys = [*(F.col(g).asc_nulls_first() for g in group), *order, F.col(tie).asc()]
    dealt = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = stored(dealt.drop(tie).withColumn(at, F.monotonically_increasing_id()), "placed")
    part = F.shiftright(at, 33)
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    sizes = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    whole = dealt.withColumn("__part", part).join(sizes, "__part").withColumn("__all", F.col("__start") + F.col(at).bitwiseAND((1 << 33) - 1)).drop("__part", "__start", at)
    firsts = whole.groupBy(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group))).agg(F.min("__all").alias("__first"))
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return whole.join(firsts, same).withColumn(out, F.col("__all") - F.col("__first")).drop("__all", "__first", *(f"__g{i}" for i in range(len(group))))
