"""Decisions on held files: actions change a warning only if it is still as the one who decided saw it.

A warning has a version.  An action names the version that it was decided on and
takes effect if that is the warning's present one, the warning is pending, and
the action suits it; then the version goes up.  All else is a conflict or a
refusal and changes nothing.  An action that would release a file does so only if
the file passed its checks again; otherwise the warning stays pending, under the
next version, and is marked as failed.

The actions of a warning are worked off by versions, not one by one: of those
that name version v the first after the last that took effect counts.  A round is
one aggregation with partial minima, so a warning with very many actions is no
group in memory, and there are as many rounds as any warning has versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.sources.shared import stored

#: What an action makes of a warning.
RESULT = {"confirm": "confirmed", "dismiss": "dismissed", "mask": "masked", "accept_syntax_error": "dismissed"}
#: Actions that release a file, if it passes its checks again.
RELEASES = ("dismiss", "mask", "accept_syntax_error")
#: Kinds of files and reasons that are not edited here.
NOT_EDITED = ("java-class", "lock")


def refusal(action: Column, failed_check: Column, audit_failed: Column, kind: Column, n_evidence: Column) -> Column:
    """Why an action does not suit a warning; null if it does."""
    broken = F.coalesce(audit_failed, F.lit(False))
    return (
        F.when(~F.coalesce(action.isin(*RESULT), F.lit(False)), "unknown_action")
        .when(action.isin("dismiss", "mask") & broken, "technical_failure")
        .when((action == "accept_syntax_error") & ~F.coalesce(failed_check == "sozdizimi", F.lit(False)), "no_syntax_error")
        .when((action == "mask") & F.coalesce(kind.isin(*NOT_EDITED), F.lit(False)), "not_edited_here")
        .when((action == "mask") & F.coalesce(failed_check == "inceleme", F.lit(False)), "review_first")
        .when((action == "mask") & (F.coalesce(n_evidence, F.lit(0)) == 0), "no_evidence")
    )


def apply_actions(warnings: DataFrame, actions: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(warnings after the actions, actions with their outcome).

    ``warnings``: warning_id (unique), status, version, failed_check, audit_failed,
    kind, n_evidence.  ``actions``: action_id (unique, in the order of arrival),
    warning_id, version, action.  ``checks``: action_id, passed; an action without
    one did not pass.  Outcomes: applied, check_failed, refused (with reason),
    conflict, unknown_warning.
    """
    state = stored(warnings.withColumn("last_action", F.lit(None).cast(actions.schema["action_id"].dataType)), "warnings")
    passed = checks.groupBy("action_id").agg(F.bool_and("passed").alias("passed"))
    asked = stored(actions.join(passed, "action_id", "left").withColumn("passed", F.coalesce("passed", F.lit(False))), "actions")
    effective: DataFrame | None = None
    while True:
        open_ = state.where("status = 'pending'").select("warning_id", F.col("version").alias("now"), "failed_check", "audit_failed", "kind", "n_evidence", "last_action")
        fit = asked.join(open_, "warning_id").where((F.col("version") == F.col("now")) & (F.col("last_action").isNull() | (F.col("action_id") > F.col("last_action"))))
        fit = fit.where(refusal(F.col("action"), F.col("failed_check"), F.col("audit_failed"), F.col("kind"), F.col("n_evidence")).isNull())
        first = stored(fit.groupBy("warning_id").agg(F.min(F.struct("action_id", "action", "passed")).alias("a")), "decisions")
        if not first.limit(1).count():
            break
        released = F.col("a.action").isin(*RELEASES)
        failed = released & ~F.col("a.passed")
        effective = (first if effective is None else effective.unionByName(first)).select("warning_id", "a")
        joined = state.join(first, "warning_id", "left")
        took = F.col("a").isNotNull()
        result = F.create_map(*(x for k, v in RESULT.items() for x in (F.lit(k), F.lit(v))))
        state = stored(
            joined.withColumns({
                "status": F.when(took & ~failed, result[F.col("a.action")]).otherwise(F.col("status")),
                "audit_failed": F.when(took & failed, True).otherwise(F.col("audit_failed")),
                "version": F.when(took, F.col("version") + 1).otherwise(F.col("version")),
                "last_action": F.coalesce("a.action_id", "last_action"),
            }).drop("a"),
            "warnings",
        )
    done = asked.select("action_id", F.lit(None).cast("string").alias("took")).limit(0) if effective is None else effective.select(F.col("a.action_id").alias("action_id"), F.when(F.col("a.action").isin(*RELEASES) & ~F.col("a.passed"), "check_failed").otherwise("applied").alias("took"))
    why = warnings.select("warning_id", "failed_check", "audit_failed", "kind", "n_evidence", F.lit(True).alias("known"))
    told = asked.join(done, "action_id", "left").join(why, "warning_id", "left")
    reason = refusal(F.col("action"), F.col("failed_check"), F.col("audit_failed"), F.col("kind"), F.col("n_evidence"))
    outcome = F.when(F.col("took").isNotNull(), F.col("took")).when(F.col("known").isNull(), "unknown_warning").when(reason.isNotNull(), "refused").otherwise("conflict")
    told = told.select("action_id", "warning_id", "version", "action", outcome.alias("outcome"), F.when((outcome == "refused"), reason).alias("reason"))
    return state.drop("last_action"), told
