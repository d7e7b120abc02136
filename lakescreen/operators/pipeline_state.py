"""Stage results rolled up: final status, review flags, confidence, dependencies, checkpoints, permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def final_status(statuses: Column, failed: Column) -> Column:
    """error, completed (all ok), completed_with_errors, completed_with_skips or completed_with_degraded_modules."""
    return (
        F.when(failed, "error")
        .when((F.size(statuses) > 0) & F.forall(statuses, lambda s: s == "ok"), "completed")
        .when(F.array_contains(statuses, "error"), "completed_with_errors")
        .when(F.array_contains(statuses, "skipped"), "completed_with_skips")
        .otherwise("completed_with_degraded_modules")
    )


def needs_review(stage_flags: Column, risk_flag: Column, failed: Column) -> Column:
    """Any flag keeps review on; a missing risk flag counts as one."""
    return F.exists(stage_flags, lambda f: F.coalesce(f, F.lit(False))) | F.coalesce(risk_flag, F.lit(True)) | F.coalesce(failed, F.lit(False))


def runnable(requires: list[str]) -> Column:
    """Whether all inputs of a stage are there."""
    out = F.lit(True)
    for name in requires:
        out = out & F.col(name).isNotNull()
    return out


#: Who may do what; everything else is denied.
PERMISSIONS = {
    "screening:run": ("ADMIN", "SECURITY_OFFICER"),
    "screening:read": ("ADMIN", "SECURITY_OFFICER", "REVIEWER"),
    "audit:read": ("ADMIN", "SECURITY_OFFICER", "REVIEWER"),
    "audit:write": ("ADMIN", "SECURITY_OFFICER"),
    "admin:manage": ("ADMIN",),
}


def permissions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, r) for p, roles in PERMISSIONS.items() for r in roles], "permission string, role string")


def allowed(requests: DataFrame) -> DataFrame:
    """requests (role, permission, ...) with allowed."""
    granted = permissions(requests.sparkSession).withColumn("allowed", F.lit(True))
    return requests.join(F.broadcast(granted), ["permission", "role"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
