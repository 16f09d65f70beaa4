"""Consistency across documents: a value masked in one is masked in all; what must not be seen is searched for in the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import text as T
from veilspark.operators import phrases, rows
from veilspark.sources.shared import stored

# Types whose shape alone makes them trusted.
STRUCTURED = ("EMAIL_ADDRESS", "IP_ADDRESS", "CREDIT_CARD", "IBAN_CODE", "CRYPTO", "email", "ip")


def registry(findings: DataFrame) -> DataFrame:
    """One row for each value, case ignored: its first spelling, types, detectors, first rule, and whether it is trusted."""
    trusted = (F.col("source") == "dictionary") | F.col("entity").isin(*STRUCTURED) & (F.col("confidence") == "yuksek")
    return findings.groupBy(F.lower("value").alias("value_key")).agg(
        F.min(F.struct("doc_id", "start", "value"))["value"].alias("value"),
        F.array_join(F.array_sort(F.collect_set("entity")), ",").alias("entities"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.min(F.struct("priority", "rule"))["rule"].alias("rule"),
        F.bool_or(trusted).alias("authoritative"),
        F.count("*").alias("n_findings"),
        F.countDistinct("doc_id").alias("n_docs"),
    )


def open_occurrences(docs: DataFrame, reg: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, value_key, n_occurrences, rule): how often each registered value, of any number of words, stands in each document between word limits.

    See :mod:`veilspark.operators.phrases`: a large registry meets only texts
    that hold its values' rarest words.
    """
    reg = stored(reg.select("value", "value_key", "rule"), "registry")  # used three times
    found = phrases.places(docs, reg.select("value"), doc_id, text, every=True)
    counted = found.groupBy("doc_id", "phrase").agg(F.count("*").alias("n_occurrences")).withColumnRenamed("doc_id", doc_id)
    named = phrases.phrase_table(reg).join(reg.select("value", "value_key", "rule"), "value").groupBy("phrase").agg(F.min(F.struct("value_key", "rule")).alias("of"))
    return counted.join(named, "phrase").select(doc_id, F.col("of.value_key").alias("value_key"), "n_occurrences", F.col("of.rule").alias("rule"))


def leaks(docs: DataFrame, terms: DataFrame, min_letters: int = 6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents in which terms still stand, whatever their case or marks: (doc_id, term, n).

    A term stands where its words follow each other, whatever is between them, or
    where they are written as one; terms have at least ``min_letters`` letters
    and digits.  Both sides are folded alike.
    """
    letters = F.regexp_replace(T.fold_turkish(F.col("term")), r"[^\p{L}\p{N}]", "")
    needles = terms.select("term", letters.alias("needle")).where(F.length("needle") >= min_letters).groupBy("needle").agg(F.collect_set("term").alias("terms"))
    forms = needles.withColumn("term", F.explode("terms")).select("needle", F.explode(F.array("term", "needle", T.spaced(F.col("term")))).alias("value"))
    found = phrases.places(docs, forms, doc_id, text, exact=False, turkish=True, every=True)
    named = phrases.phrase_table(forms, turkish=True).join(forms, "value").select("phrase", "needle").distinct()
    # A place counts once for a term, in as many of its forms as it may be found; equal rows have equal places.
    spans = found.join(named, "phrase").groupBy("doc_id", rows.ROW, "start", "end", "needle", "phrase").agg(F.count("*").alias("n"))
    spans = spans.groupBy("doc_id", rows.ROW, "start", "end", "needle").agg(F.max("n").alias("n"))
    # One form may lie within another, as ``x`` in ``x™``.
    before = Window.partitionBy("doc_id", rows.ROW, "needle").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reached", F.max("end").over(before)).where(F.col("reached").isNull() | (F.col("reached") < F.col("end")))
    counted = spans.groupBy(F.col("doc_id").alias(doc_id), "needle").agg(F.sum("n").alias("n"))
    return counted.join(needles.select("needle", F.array_min("terms").alias("term")), "needle").select(doc_id, "term", "n")


def suppressed(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings that no learned decision suppresses: same scope, value and type (case of the value ignored)."""
    d = decisions.select(F.col("scope").alias("__s"), F.lower("value").alias("__v"), F.col("entity").alias("__e")).distinct()
    return findings.join(d, (F.col("scope") == F.col("__s")) & (F.lower("value") == F.col("__v")) & (F.col("entity") == F.col("__e")), "left_anti")


def policy(decisions: DataFrame, contexts: DataFrame, project: str, sicil: str) -> DataFrame:
    """Decisions that count for a context: sensitive ones of its project, suppressions of its project and person; the first of each value stays."""
    own = contexts.where(F.col("project") == project)
    sensitive = decisions.where("kind = 'sensitive'").join(own.select("context_id").distinct(), "context_id", "left_semi")
    suppress = decisions.where("kind = 'suppression'").join(own.where(F.col("sicil") == sicil).select("context_id").distinct(), "context_id", "left_semi")
    both = sensitive.unionByName(suppress)
    first = both.groupBy("kind", "scope", "value", "entity").agg(F.min("decision_id").alias("decision_id"))
    return both.join(first.select("decision_id"), "decision_id", "left_semi")
