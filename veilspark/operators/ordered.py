"""Order within groups without one window a group: rows meet in stretches of the order, and stretches add up.

A group that holds a third of all rows would be one task as a window.  Here only
a stretch of it is a window; what a row needs to know of the stretches before it
(how many rows, how far they reach) comes from one small row a stretch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the first order column that make one stretch, where a caller names no width.
WIDTH = 1 << 20
#: Stretches that a group's values are cut into where their range is unknown.
SPLITS = 256


def joined(left: DataFrame, right: DataFrame, keys: dict[str, str], how: str = "inner") -> DataFrame:
    """A join on columns of other names, in which nulls are equal; the right keys go."""
    on = reduce(Column.__and__, (F.col(a).eqNullSafe(F.col(b)) for a, b in keys.items()), F.lit(True))
    return left.join(right, on, how).drop(*keys.values())


def _keys(group: list[str]) -> dict[str, str]:
    return {c: f"__k{i}" for i, c in enumerate(group)}


def row_numbers(rows: DataFrame, order: list[str], group: list[str], width: int = WIDTH) -> DataFrame:
    """``rows`` with __row (from 0, by ``order`` within the group) and __size (rows of the group).

    ``order`` starts with a number; ``width`` of its values make one stretch.
    Rows that tie in all of ``order`` get their numbers in any order.
    """
    keys = _keys(group)
    staged = rows.withColumn("__lead", F.floor(F.col(order[0]) / width))
    counts = staged.groupBy(*group, "__lead").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__lead").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*(F.col(a).alias(b) for a, b in keys.items()), F.col("__lead").alias("__l"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(whole).alias("__size"))
    own = staged.withColumn("__own", F.row_number().over(Window.partitionBy(*group, "__lead").orderBy(*order)) - 1)
    return joined(own, counts, keys | {"__lead": "__l"}).withColumn("__row", F.col("__start") + F.col("__own")).drop("__lead", "__start", "__own")


def reached(intervals: DataFrame, by: list[str], start: str, end: str, width: int) -> DataFrame:
    """``intervals`` with __reached: the largest end of the group's intervals that come before by (start, end), null for the first."""
    keys = _keys(by)
    staged = intervals.withColumn("__lead", F.floor(F.col(start) / width))
    tops = staged.groupBy(*by, "__lead").agg(F.max(end).alias("__top"))
    before = Window.partitionBy(*by).orderBy("__lead").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*(F.col(a).alias(b) for a, b in keys.items()), F.col("__lead").alias("__l"), F.max("__top").over(before).alias("__carried"))
    own = F.max(end).over(Window.partitionBy(*by, "__lead").orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    return joined(staged.withColumn("__own", own), tops, keys | {"__lead": "__l"}).withColumn("__reached", F.greatest("__own", "__carried")).drop("__lead", "__own", "__carried")


def percentiles(df: DataFrame, by: list[str], value: str, percents: tuple[float, ...], *aggregates: Column) -> DataFrame:
    """``by``, ``aggregates`` and exact nearest-rank percentiles p50, p95, ... of the values that are not null.

    Equal values are counted first.  Approximate quantiles, of bounded size, cut
    a group's values into SPLITS stretches, whose counts say in which stretch a
    percentile lies; only these stretches are then put in order.
    """
    keys = _keys(by)
    cuts = F.percentile_approx(value, F.array(*(F.lit(i / SPLITS) for i in range(1, SPLITS))))
    groups = df.groupBy(*by).agg(*aggregates, F.count(value).alias("__m"), cuts.alias("__cuts"))
    bounds = groups.select(*(F.col(a).alias(b) for a, b in keys.items()), "__m", "__cuts")
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    counts = joined(counts, bounds, keys).withColumn("__lead", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts")
    before = Window.partitionBy(*by).orderBy("__lead").rowsBetween(Window.unboundedPreceding, -1)
    stretches = counts.groupBy(*by, "__lead").agg(F.sum("__c").alias("__n"), F.first("__m").alias("__m"))
    stretches = stretches.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    ranks = F.array(*(F.struct(F.lit(f"p{round(p * 100)}").alias("name"), F.greatest(F.ceil(F.col("__m") * p), F.lit(1)).alias("rank")) for p in percents))
    wanted = F.filter(ranks, lambda r: (r["rank"] > F.col("__start")) & (r["rank"] <= F.col("__start") + F.col("__n")))
    stretches = stretches.withColumn("__wanted", wanted).where(F.size("__wanted") > 0)
    stretches = stretches.select(*(F.col(a).alias(b) for a, b in keys.items()), F.col("__lead").alias("__l"), "__start", "__wanted")
    near = joined(counts, stretches, keys | {"__lead": "__l"})
    upto = F.col("__start") + F.sum("__c").over(Window.partitionBy(*by, "__lead").orderBy("__v"))
    hits = near.withColumn("__upto", upto).withColumn("__hit", F.explode("__wanted")).where("__hit.rank > __upto - __c and __hit.rank <= __upto")
    found = hits.groupBy(*(F.col(a).alias(b) for a, b in keys.items())).agg(*(F.max(F.when(F.col("__hit.name") == (n := f"p{round(p * 100)}"), F.col("__v"))).alias(n) for p in percents))
    return joined(groups.drop("__m", "__cuts"), found, keys, "left")
