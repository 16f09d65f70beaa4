"""Lines that differ in numbers only: one stands for all, and what is found in it is carried to the others."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import text as T
from veilspark.operators import rows

#: Signs of the shortest line that may be represented by another.
MIN_CHARS = 8
#: Runs of digits, and what stands between them.
_RUNS = re.compile(r"[0-9]+|[^0-9]+")
_DIGITS = frozenset("0123456789")


def line_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row_key, line_no, start, line, first_no, kept_start) of all lines of different rows.

    ``first_no`` is the first line of the class: lines whose digits alone differ,
    of at least ``min_chars`` signs; ``kept_start`` is where that line stands in
    the text of first lines (a line end after each), null for other lines.
    """
    own = rows.keyed(docs, text, doc_id).dropDuplicates([rows.ROW])
    body = F.coalesce(F.col(text), F.lit(""))
    lines = own.select(F.col(doc_id).alias("doc_id"), rows.ROW, F.posexplode(F.split(body, "\n", -1)).alias("line_no", "raw"))
    of = Window.partitionBy(rows.ROW)
    before = of.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("start", F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0)).cast("int")).withColumn("line", F.rtrim("raw", F.lit("\r")))
    key = F.when(F.length(F.trim("line")) >= min_chars, T.digit_key(F.col("line"))).otherwise(F.concat(F.lit("\n"), F.col("line_no").cast("string")))
    lines = lines.withColumn("class", key).withColumn("first_no", F.min("line_no").over(Window.partitionBy(rows.ROW, "class")))
    kept = F.col("line_no") == F.col("first_no")
    lines = lines.withColumn("at", F.coalesce(F.sum(F.when(kept, F.length("line") + 1).otherwise(0)).over(before), F.lit(0)).cast("int"))
    return lines.select("doc_id", rows.ROW, "line_no", "start", "line", "first_no", F.when(kept, F.col("at")).alias("kept_start"))


def kept_texts(classes: DataFrame) -> DataFrame:
    """(doc_id, row_key, text): the first lines of the classes, each with a line end."""
    kept = classes.where("kept_start is not null").groupBy("doc_id", rows.ROW).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    return kept.select("doc_id", rows.ROW, F.concat(F.array_join(F.transform("x", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def moved_spans(first: str, other: str, spans: list[tuple[int, int]]) -> list[tuple[int, int] | None]:
    """Where spans of the line ``first`` stand in ``other``, whose digits alone differ.

    Limits inside a run of digits move to the run's limits.  Each limit is looked
    up among the runs by halving.
    """
    runs, others = ([m.span() for m in _RUNS.finditer(line)] for line in (first, other))
    if len(runs) != len(others):
        return [None] * len(spans)
    lows, highs = [a for a, _ in runs], [b for _, b in runs]
    out: list[tuple[int, int] | None] = []
    for start, end in spans:
        if not (0 <= start < end <= len(first)):
            out.append(None)
            continue
        i, j = bisect_right(lows, start) - 1, bisect_left(highs, end)
        low = others[i][0] if first[lows[i]] in _DIGITS else others[i][0] + start - lows[i]
        high = others[j][1] if first[lows[j]] in _DIGITS else others[j][0] + end - lows[j]
        out.append((low, high) if low < high else None)
    return out


def member_spans(classes: DataFrame, findings: DataFrame) -> DataFrame:
    """``findings`` of kept texts (row_key, start, end, ...) at all their places in the sources: one row a line of the class, with start and end of the source.

    Findings that reach over the end of a line have no place elsewhere and are
    left out.  The findings of a line meet each line of its class as one array,
    so that a line is cut into runs once for all of them.
    """
    keep = [c for c in findings.columns if c not in (rows.ROW, "start", "end", "doc_id")]
    firsts = classes.where("kept_start is not null").select(F.col(rows.ROW).alias("__row"), F.col("first_no").alias("__first"), "kept_start", F.col("line").alias("__line"))
    # A finding's line is the last that begins at or before it: lines and findings in one order, not all lines against all findings of a row.
    marks = firsts.select("__row", F.col("kept_start").alias("__at"), F.lit(0).alias("__kind"), F.struct("__first", "kept_start", F.length("__line").alias("n")).alias("__of"), F.lit(None).cast(findings.select(F.struct("start", "end", *keep)).schema[0].dataType).alias("__f"))
    hits = findings.select(F.col(rows.ROW).alias("__row"), F.col("start").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(marks.schema["__of"].dataType).alias("__of"), F.struct("start", "end", *keep).alias("__f"))
    held = marks.unionByName(hits).withColumn("__of", F.last("__of", ignorenulls=True).over(Window.partitionBy("__row").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)))
    held = held.where((F.col("__kind") == 1) & F.col("__of").isNotNull()).where("__f.end <= __of.kept_start + __of.n")
    low, high = (F.col(f"__f.{c}") - F.col("__of.kept_start") for c in ("start", "end"))
    found = held.groupBy(F.col("__row").alias("__r"), F.col("__of.__first").alias("__n")).agg(F.collect_list(F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), *(F.col(f"__f.{c}").alias(c) for c in keep))).alias("__spans"))
    at = firsts.join(found, (F.col("__row") == F.col("__r")) & (F.col("__first") == F.col("__n"))).select("__row", "__first", "__line", "__spans")
    met = at.join(classes.drop("kept_start"), (F.col("__row") == F.col(rows.ROW)) & (F.col("__first") == F.col("first_no")))

    def move(firsts: pd.Series, lines: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.Series:
        return pd.Series([[None if m is None else {"start": m[0], "end": m[1]} for m in moved_spans(f, o, list(zip(a, b, strict=True)))] for f, o, a, b in zip(firsts, lines, lows, highs, strict=True)], dtype=object)

    moved = F.pandas_udf(move, "array<struct<start:int,end:int>>")("__line", "line", F.col("__spans.low"), F.col("__spans.high"))
    out = met.withColumn("__to", moved).select("doc_id", rows.ROW, "line_no", F.col("start").alias("__start"), F.explode(F.arrays_zip("__spans", "__to")).alias("x")).where("x.__to is not null")
    return out.select("doc_id", rows.ROW, *(F.col(f"x.__spans.{c}").alias(c) for c in keep), "line_no", (F.col("__start") + F.col("x.__to.start")).alias("start"), (F.col("__start") + F.col("x.__to.end")).alias("end"))
