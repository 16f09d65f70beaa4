"""The engine in three calls: mask, unmask, and reports (veilspark.operators.reports)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators import boundary, consistency, detect, mapping, outcome, remediate, rows, validate
from veilspark.operators import rules as R
from veilspark.operators import spans as S
from veilspark.sources.shared import stored


@dataclass
class Masked:
    """What masking gives: documents, the mapping (the only table with plain values), findings, audit rows and verdicts."""

    documents: DataFrame
    mapping: DataFrame
    findings: DataFrame
    audit: DataFrame
    outcomes: DataFrame


def mask(docs: DataFrame, rules: list[R.Rule] | None = None, terms: DataFrame | None = None, external: DataFrame | None = None, claims: DataFrame | None = None, code: bool = False) -> Masked:
    """Mask documents (doc_id, text, and suffix if ``code``); ids may be null or repeated, each row is masked and judged for itself.

    ``external``: findings of outside detectors (doc_id, value, entity,
    confidence).  ``terms``: words that must not stand in the result (term).
    ``claims``: an outside auditor's quotes (doc_id, quote).  With ``code`` spans
    keep to strings, comments and tokens, and syntax is checked.
    """
    rules = R.bound((*R.RULES, *R.RECOGNISERS)) if rules is None else rules
    own = rows.keyed(docs.drop("findings", rows.ROW))
    found = detect.detect(own, rules)
    fixed = detect.long(found, keep=("doc_id", rows.ROW))
    if code:
        limits = boundary.bound(found.dropDuplicates([rows.ROW]), doc_id=rows.ROW).where("reason is null").select(rows.ROW, "ord", "start", "end", "value")
        fixed = fixed.drop("start", "end", "value").join(limits, [rows.ROW, "ord"])
    if external is not None:
        outside = detect.external(own, external)
        fixed = fixed.unionByName(outside.select("doc_id", rows.ROW, F.lit(None).cast("string").alias("rule"), F.lit("llm").alias("kind"), "entity", "source", "confidence", F.lit(0).alias("authority"), F.lit(100).alias("priority"), detect.prefix_of(F.col("entity")).alias("prefix"), "start", "end", "value", F.lit(0).alias("ord")))
    routed = fixed.where(detect.route(F.col("confidence"), F.col("value"), F.lit(False)) == "mask")
    fields = ["rule", "kind", "entity", "source", "confidence", "authority", "priority", "prefix", "start", "end", "value"]
    arrays = routed.groupBy(rows.ROW).agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_set(F.struct("start", "priority", *(c for c in fields if c not in ("start", "priority"))))).alias("s"))
    spans = F.transform("s", lambda x, i: F.struct(*(x[c].alias(c) for c in fields), i.alias("ord")))
    arrays = arrays.select("doc_id", rows.ROW, spans.alias("s"))
    judged = arrays.select("doc_id", rows.ROW, F.explode(S.resolve(F.col("s"))).alias("x")).select("doc_id", rows.ROW, "x.span.*", "x.accepted", "x.winner")
    judged = stored(judged, "findings")
    chosen = judged.where("accepted")
    table = stored(mapping.mapping_of(chosen), "mapping")
    done, table = remediate.consistent(mapping.masked(own, chosen, table), chosen, table)
    done, table = stored(done, "masked"), stored(table, "mapping")
    back = mapping.unmasked(done, table)
    checked = back.select("doc_id", rows.ROW, F.col("n_findings").alias("match_count"), (~mapping.round_trip(F.coalesce("text", F.lit("")), F.col("restored"))).alias("round_trip_error"))
    checked = _flag(checked, remediate.encoded_leaks(done.select(rows.ROW, F.col("masked_text").alias("text")).dropDuplicates([rows.ROW]), rules, doc_id=rows.ROW), "encoded_leak")
    if terms is not None:
        checked = _flag(checked, consistency.leaks(done, terms, doc_id=rows.ROW, text="masked_text"), "leaked_term")
    if claims is not None:
        checked = _flag(checked, validate.audit_verdicts(done, claims).where("risky"), "audit_risky", "doc_id")
    if code:
        checked = _flag(checked, validate.validated(done, doc_id=rows.ROW), "syntax_error")
    return Masked(done.drop(rows.ROW), table, chosen.drop(rows.ROW), mapping.audit(judged), outcome.outcomes(checked).drop(rows.ROW))


def _flag(checked: DataFrame, bad: DataFrame, name: str, key: str = rows.ROW) -> DataFrame:
    """``checked`` with the flag ``name`` for the rows whose key is among ``bad``; null keys meet null keys."""
    marked = bad.select(F.col(key).alias("__of")).distinct().withColumn(name, F.lit(True))
    return rows.attached(checked, marked, key).withColumn(name, F.coalesce(name, F.lit(False)))


def unmask(masked: DataFrame, table: DataFrame) -> DataFrame:
    """Masked documents (doc_id, masked_text) with restored and unresolved."""
    return mapping.unmasked(masked, table)
