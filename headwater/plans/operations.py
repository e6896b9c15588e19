"""Operations reports: release health, deployment attempts, snapshot retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.functions.numbers import age_seconds

# Attempt states.
UNFINISHED = ("pending", "running", "interrupted")
FAILED = ("failed", "rollback_failed")
LEASED = ("planning", "staging", "applying")

CHECKS = [
    "active-inventory-match", "storage-capacity", "storage-growth", "artifact-age", "backup-age",
]


def health_checks(
    observations: DataFrame, inventory: DataFrame, minimum_available: float, maximum_growth: float,
    artifact_hours: float, backup_hours: float,
) -> DataFrame:
    """OPS-01: one row per observation and check.

    ``observations``: environment, observed_at, active_release, available, capacity,
    artifact_size, previous_artifact_size, backup_at. ``inventory``: environment, release_id,
    published_at. A time in the future makes a check an error, not a pass.
    """
    joined = observations.join(
        inventory.select("environment", F.col("release_id").alias("_release"), "published_at"), "environment", "left"
    )
    growth = F.col("artifact_size") - F.col("previous_artifact_size")

    def fresh(then: str, hours: float) -> Column:
        age = age_seconds(F.col("observed_at"), F.col(then))
        return F.when(age.isNull() | (age < 0), "error").when(age <= hours * 3600, "passed").otherwise(F.lit("failed"))

    passed = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "passed").otherwise(F.lit("failed"))
    results = [
        passed(F.col("active_release").eqNullSafe(F.col("_release"))),
        F.when(F.col("available") > F.col("capacity"), "error").otherwise(passed(F.col("available") >= minimum_available)),
        passed(growth <= maximum_growth),
        fresh("published_at", artifact_hours),
        fresh("backup_at", backup_hours),
    ]
    wide = joined.select(
        "environment", "observed_at", *[r.alias(f"_{i}") for i, r in enumerate(results)]
    )
    pairs = ", ".join(f"'{name}', _{i}" for i, name in enumerate(CHECKS))
    return wide.select("environment", "observed_at", F.expr(f"stack({len(CHECKS)}, {pairs}) AS (code, status)"))


def health_status(checks: DataFrame) -> DataFrame:
    """OPS-01: an observation passes when all its checks do."""
    return checks.groupBy("environment", "observed_at").agg(
        F.when(F.bool_and(F.col("status") == "passed"), "passed").otherwise(F.lit("failed")).alias("status"),
        F.count_if(F.col("status") != "passed").alias("not_passed"),
    )


def attempt_report(attempts: DataFrame, now: Column, abandoned_hours: float, groups: list[str] = []) -> DataFrame:
    """OPS-02: failed attempts, unfinished ones gone quiet, and leases that ran out."""
    quiet = age_seconds(now, F.col("updated_at")) > abandoned_hours * 3600
    return attempts.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("status").isin(*FAILED)).alias("failed"),
        F.count_if(F.col("status").isin(*UNFINISHED) & quiet).alias("abandoned"),
        F.count_if(
            F.col("lease_active") & (F.col("lease_expires_at") <= now) & F.col("status").isin(*LEASED)
        ).alias("expired_leases"),
    )


def snapshot_retention(snapshots: DataFrame, retained: DataFrame) -> DataFrame:
    """WIN-02: which snapshots to keep: the newest of each retained release and nothing else.

    The newest is found by a combined maximum and matched back on (release, id), so one
    release with most of the snapshots needs no window of its own. A retained release
    without any snapshot comes back as ``missing``.
    """
    newest = snapshots.where(F.col("release_id").isNotNull()).groupBy("release_id").agg(
        F.max_by("snapshot_id", F.struct("time", "snapshot_id")).alias("snapshot_id")
    )
    wanted = retained.select("release_id").distinct()
    keep = newest.join(wanted, "release_id", "left_semi").withColumn("_keep", F.lit(True))
    decided = snapshots.where(F.col("release_id").isNotNull()).join(
        keep, ["release_id", "snapshot_id"], "left"
    ).select("release_id", "snapshot_id", F.when(F.col("_keep"), "keep").otherwise(F.lit("forget")).alias("decision"))
    missing = wanted.join(newest, "release_id", "left_anti").select(
        "release_id", F.lit(None).cast(snapshots.schema["snapshot_id"].dataType).alias("snapshot_id"), F.lit("missing").alias("decision")
    )
    return decided.unionByName(missing)


def newest_per_group(df: DataFrame, groups: list[str], time: str, value: str) -> DataFrame:
    """SRT-04: the newest value per group."""
    return df.groupBy(*groups).agg(F.max_by(value, time).alias(value), F.max(time).alias(time))
