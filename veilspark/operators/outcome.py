"""The verdict on each document: the first failed check, the state it leads to, and the buckets of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Checks in the order in which they are made, with the status and the final state of a failure.
LADDER = (
    ("detector_crash", "tespit_katmani", "quarantined_pending_audit", "SECURITY_QUARANTINE"),
    ("encoded_leak", "kodlanmis_veri", "quarantined_pending_audit", "SECURITY_QUARANTINE"),
    ("llm_error", "llm_tespit", "failed_detection", "SECURITY_QUARANTINE"),
    ("review_pending", "inceleme", "quarantined_pending_audit", "REVIEW_REQUIRED"),
    ("leaked_term", "acik_terim", "quarantined_pending_audit", "SECURITY_QUARANTINE"),
    ("audit_error", "llm_denetimi_tamamlanamadi", "quarantined_pending_audit", "REVIEW_REQUIRED"),
    ("audit_risky", "llm_denetimi", "quarantined_pending_audit", "REVIEW_REQUIRED"),
    ("syntax_error", "sozdizimi", "failed_syntax_validation", "VALIDATION_FAILED"),
    ("write_error", "yazma", "error", "VALIDATION_FAILED"),
    ("round_trip_error", "geri_donus", "failed_round_trip_validation", "VALIDATION_FAILED"),
    ("consistency_error", "tutarlilik", "failed_consistency_validation", "VALIDATION_FAILED"),
)
FLAGS = tuple(x[0] for x in LADDER)


def _first(pick: int, default: Column) -> Column:
    return F.coalesce(*(F.when(F.coalesce(F.col(x[0]), F.lit(False)), F.lit(x[pick])) for x in LADDER), default)


def outcomes(checked: DataFrame) -> DataFrame:
    """``checked`` (a flag for each check, and match_count) with failed_check, status and final_state; a missing flag column did not fail."""
    for flag in FLAGS:
        if flag not in checked.columns:
            checked = checked.withColumn(flag, F.lit(False))
    clean = F.when(F.col("match_count") > 0, "masked").otherwise("copied_text_no_match")
    return checked.withColumns({"failed_check": _first(1, F.lit(None).cast("string")), "status": _first(2, clean), "final_state": _first(3, F.lit("READY"))})


def buckets(done: DataFrame) -> DataFrame:
    return done.groupBy("status").agg(F.count("*").alias("n"), F.sum("match_count").cast("long").alias("matches"))


def final_status(done: DataFrame) -> DataFrame:
    """One row: the status of the whole run."""
    bad = F.bool_or(F.col("final_state") != "READY")
    return done.agg(F.when(F.coalesce(bad, F.lit(False)), "completed_with_warnings").otherwise("completed").alias("run_status"))


def breakdown(findings: DataFrame, rule: str = "rule") -> DataFrame:
    """For each document, a map from rule to number of findings; findings without a rule count as llm_dynamic."""
    counted = findings.groupBy("doc_id", F.coalesce(rule, F.lit("llm_dynamic")).alias("r")).agg(F.count("*").alias("n"))
    return counted.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("r", "n")))).alias("rule_breakdown"))
