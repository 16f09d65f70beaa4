"""Reports over metadata: runs, contexts, audit, warnings, timings.  All are joins and aggregations by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.operators import ordered


def latest_by_context(contexts: DataFrame, runs: DataFrame) -> DataFrame:
    """Each context with its last start, contexts without runs last."""
    last = runs.groupBy("context_id").agg(F.max("started_at").alias("last_started"), F.count("*").alias("n_runs"))
    return contexts.join(last, "context_id", "left").select("context_id", "project", "last_started", F.coalesce("n_runs", F.lit(0)).alias("n_runs"))


def list_runs(runs: DataFrame, contexts: DataFrame, n: int = 50, **filters: str) -> DataFrame:
    """The ``n`` latest runs with their contexts; ``filters`` are equalities on columns of the contexts."""
    for column, value in filters.items():
        contexts = contexts.where(F.col(column) == value)
    return runs.join(contexts, "context_id").orderBy(F.desc_nulls_last("started_at"), F.desc("run_id")).limit(n)


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc_nulls_last("started_at"), F.desc("run_id")).limit(1)


def file_summary(audit: DataFrame, file: str = "file_ref", action: str = "action") -> DataFrame:
    """Counts of each kind of audit row by file."""
    n = lambda x: F.count_if(F.col(action) == x).alias(f"n_{x}")
    return audit.groupBy(file).agg(F.count("*").alias("n_rows"), n("matched"), n("replaced"), n("skipped"), n("error"))


def failed_checks(warnings: DataFrame, file: str = "file_ref", check: str = "failed_check", order: tuple[str, ...] = ("ts", "warning_id")) -> DataFrame:
    """By check: the files whose first warning it is, and all its warnings."""
    first = warnings.groupBy(file).agg(F.min(F.struct(*order, check))[check].alias(check))
    firsts = first.groupBy(check).agg(F.count("*").alias("n_files"))
    return warnings.groupBy(check).agg(F.count("*").alias("n_warnings"), F.countDistinct(file).alias("n_distinct_files")).join(firsts, check, "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))


def nearest_rank(df: DataFrame, by: list[str], value: str, percents: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """n, mean, min, max and nearest-rank percentiles."""
    return ordered.percentiles(df, by, value, percents, F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))


def union_length(intervals: DataFrame, by: list[str], start: str = "start", end: str = "end", width: int = 86_400_000_000) -> DataFrame:
    """Length of the union of intervals by key; touching intervals merge.

    ``width`` (a day of microseconds, unless named) is the stretch of starts that is put in order at a time.
    """
    reached = F.col("__reached")
    covered = F.greatest(F.col(end) - F.greatest(F.col(start), F.coalesce(reached, F.col(start))), F.lit(0))
    island = F.when(reached.isNull() | (F.col(start) > reached), 1).otherwise(0)
    return ordered.reached(intervals, by, start, end, width).withColumns({"__covered": covered, "__island": island}).groupBy(*by).agg(F.sum("__covered").alias("busy"), F.sum("__island").alias("n_islands"), F.count("*").alias("n"))


def advisor(tokens: DataFrame, mappings: DataFrame, least: int = 20, ratio: float = 0.5) -> DataFrame:
    """Which context the tokens of a text come from: the one that knows most of them, if it knows enough."""
    distinct = tokens.select("token").distinct()
    hits = distinct.join(mappings.select("token", "context_id").distinct(), "token").groupBy("context_id").agg(F.count("*").alias("n_known"))
    total = distinct.agg(F.count("*").alias("n_tokens"))
    best = hits.orderBy(F.desc("n_known"), "context_id").limit(1)
    return best.join(F.broadcast(total), F.lit(True)).where((F.col("n_tokens") >= least) & (F.col("n_known") >= F.col("n_tokens") * ratio))


def jaccard_of_sets(values: DataFrame, group: str, value: str) -> DataFrame:
    """Similarity of the value sets of every two groups that share a value: pairs from a join on the value, sizes from aggregation."""
    v = values.select(F.col(group).alias("g"), F.col(value).alias("v")).distinct()
    sizes = v.groupBy("g").agg(F.count("*").alias("n"))
    both = v.select(F.col("g").alias("a"), "v").join(v.select(F.col("g").alias("b"), "v"), "v").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_both"))
    out = both.join(sizes.select(F.col("g").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("g").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", "n_both", F.round(F.col("n_both") / (F.col("na") + F.col("nb") - F.col("n_both")), 6).alias("jaccard"))


def manifest_diff(expected: DataFrame, actual: DataFrame, key: str = "path", digest: str = "digest") -> DataFrame:
    """Files that are missing, unexpected or changed."""
    missing = expected.join(actual, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    extra = actual.join(expected, key, "left_anti").select(key, F.lit("unexpected").alias("problem"))
    changed = expected.select(key, F.col(digest).alias("d1")).join(actual.select(key, F.col(digest).alias("d2")), key).where("d1 <> d2").select(key, F.lit("changed").alias("problem"))
    return missing.unionByName(extra).unionByName(changed)


def usage(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, total, mean, median and 95th percentile."""
    return ordered.percentiles(df, by, value, (0.5, 0.95), F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def first_of(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def transitions(review: DataFrame, decided: DataFrame) -> DataFrame:
    """Review rows after decisions (run_id, file_ref, value, entity, status): pending rows that equal a decided one follow it."""
    d = decided.groupBy("run_id", "file_ref", "value", "entity").agg(F.min_by("status", "decision_id").alias("__new"))
    return review.join(d, ["run_id", "file_ref", "value", "entity"], "left").withColumn("status", F.when((F.col("status") == "pending") & F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col("status"))).drop("__new")


def entries_of_run(audit: DataFrame, run_id: int, key: str = "entry_id") -> DataFrame:
    """The audit rows of one run, oldest first."""
    return audit.where(F.col("run_id") == run_id).orderBy(key)


def pending_reviews(review: DataFrame, runs: DataFrame, contexts: DataFrame, **filters: str) -> DataFrame:
    """Open reviews of runs that came to an end, with their contexts, oldest first; ``filters`` are equalities on columns of the contexts.

    The rows of an unfinished or failed run are not shown: nothing of it was published.
    """
    for column, value in filters.items():
        contexts = contexts.where(F.col(column) == value)
    ended = runs.where(F.col("status").isin("completed", "completed_with_warnings")).drop("status")
    return review.where("status = 'pending'").join(ended, "run_id").join(contexts, "context_id").orderBy("created_at", "review_id")


def busy_contexts(runs: DataFrame) -> DataFrame:
    """Contexts that may not start a masking run, as one is in progress: how many are, and the first."""
    return runs.where("operation = 'mask' and status = 'in_progress'").groupBy("context_id").agg(F.count("*").alias("n_running"), F.min("run_id").alias("first_run"))


def unambiguous(mappings: DataFrame, context: Column | int) -> DataFrame:
    """Mappings by which one context's texts are restored: rows without a run whose token another context also gave, without a run, are left out."""
    own = mappings.where(F.col("context_id") == context)
    others = mappings.where((F.col("context_id") != context) & F.col("run_id").isNull()).select(F.col("token").alias("__token")).distinct()
    return own.join(others, F.col("run_id").isNull() & (F.col("token") == F.col("__token")), "left_anti")


def combined(repetitions: DataFrame, by: list[str], measures: list[str], counts: list[str]) -> DataFrame:
    """Repetitions of a measurement as one row a condition: their number, mean, least and largest of each measure, sums of each count."""
    parts = [f(c).alias(f"{c}_{n}") for c in measures for f, n in ((F.avg, "mean"), (F.min, "min"), (F.max, "max"))]
    return repetitions.groupBy(*by).agg(F.count("*").alias("n_repetitions"), *parts, *(F.sum(c).alias(c) for c in counts))
