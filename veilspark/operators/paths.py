"""Paths against contents: values that were masked in a file and still stand open in its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import text as T
from veilspark.functions.arrays import let
from veilspark.operators.mapping import TOKEN

#: Letters and digits that a value has at least; shorter ones meet paths by chance.
MIN_SIGNS = 3


def joined_key(value: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")


def part_runs(path: Column) -> Column:
    """All runs of parts in a row of a path, each joined to one string; placeholders separate, they are no parts."""
    parts = F.filter(F.split(T.spaced(F.regexp_replace(path, TOKEN, "/")), " "), lambda p: p != "")

    def runs(parts: Column) -> Column:
        return F.flatten(F.transform(parts, lambda _, i: F.transform(F.sequence(F.lit(1), F.size(parts) - i), lambda n: F.array_join(F.slice(parts, i + 1, n), ""))))

    return F.array_distinct(F.coalesce(let(F.transform(parts, F.lower), runs), F.array().cast("array<string>")))


def content_mismatches(files: DataFrame, masked: DataFrame, key: str = "doc_id", path: str = "masked_path", value: str = "value") -> DataFrame:
    """(key, n_open): files whose path still shows values that were masked in them, and how many.

    ``files`` (key, path), ``masked`` (key, value).  A value is shown if parts in a
    row of the path, joined, are the value's letters and digits; so ``tc`` is not
    shown by ``tcpPort``.  A path gives all runs of its parts, and these meet the
    file's own values in one join by file and run.  Both sides grow with the
    files, however small the tables they come from look to Spark, so both are
    shuffled and neither is sent to the driver.  Values of fewer than MIN_SIGNS
    signs are left out, equal ones count once.
    """
    wanted = masked.select(F.col(key).alias("__k"), joined_key(F.col(value)).alias("__run")).where(F.length("__run") >= MIN_SIGNS).distinct()
    dealt = files.select(key, path).repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, path)  # a small file of paths is one task, but many runs
    runs = dealt.select(key, F.explode(F.filter(part_runs(F.col(path)), lambda r: F.length(r) >= MIN_SIGNS)).alias("__r"))
    met = runs.join(wanted.hint("merge"), runs[key].eqNullSafe(wanted["__k"]) & (F.col("__r") == F.col("__run")), "left_semi").distinct()
    return met.groupBy(key).agg(F.count("*").alias("n_open"))
