"""Consecutive failures per company: counters, reset, auto-skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lookout.functions.text import truncate
from lookout.operators.joins import lookup

SKIP_THRESHOLD = 6
ERROR_LENGTH = 300


def failure_streak(run_log: DataFrame, key: str = "company",
                   order: tuple[str, ...] = ("run_ts",)) -> DataFrame:
    """Trailing failures of every company in the log.

    Columns: the key, ``count``, ``had_ok``, ``last_error`` and ``last_failed_at``
    (the first order column). Both aggregations combine on the map side; only failed
    rows are joined, and against one row per company.
    """
    # One plain column keeps the aggregate over all runs a hash aggregate.
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    last = run_log.groupBy(key).agg(F.max(F.when(F.col("ok"), at)).alias("_ok_at"))
    failed = run_log.filter(~F.col("ok")).select(
        key, at.alias("_at"), truncate("error", ERROR_LENGTH).alias("_error")
    )
    tail = (
        lookup(failed, last.filter(F.col("_ok_at").isNotNull()), [key], "left")
        .filter(F.col("_ok_at").isNull() | (F.col("_at") > F.col("_ok_at")))
        .groupBy(key)
        .agg(
            F.count("*").cast("int").alias("_count"),
            F.max(F.struct("_at", "_error")).alias("_last"),
        )
    )
    last_at = F.col("_last._at") if len(order) == 1 else F.col("_last._at")[order[0]]
    return last.join(tail, key, "left").select(
        key,
        F.coalesce("_count", F.lit(0)).alias("count"),
        F.col("_ok_at").isNotNull().alias("had_ok"),
        F.col("_last._error").alias("last_error"),
        last_at.alias("last_failed_at"),
    )


def update_failures(counters: DataFrame, run_log: DataFrame,
                    order: tuple[str, ...] = ("run_ts",)) -> DataFrame:
    """Counters after the logged runs: a success drops the row, failures add up.

    The log may hold any number of runs, so a backlog is folded in one step.
    """
    new = failure_streak(run_log, order=order).alias("n")
    old = counters.alias("o")
    kept = F.when(F.coalesce(F.col("n.had_ok"), F.lit(False)), 0).otherwise(
        F.coalesce("o.count", F.lit(0))
    )
    return (
        old.join(new, F.col("o.company") == F.col("n.company"), "full_outer")
        .select(
            F.coalesce("o.company", "n.company").alias("company"),
            (kept + F.coalesce("n.count", F.lit(0))).cast("int").alias("count"),
            F.coalesce("n.last_error", "o.last_error").alias("last_error"),
            F.coalesce("n.last_failed_at", "o.last_failed_at").alias("last_failed_at"),
        )
        .filter(F.col("count") > 0)
    )


def record_failure(counters: DataFrame, failed: DataFrame) -> DataFrame:
    """Add one failed run; ``failed`` has company, run_ts and error."""
    return update_failures(counters, failed.withColumn("ok", F.lit(False)))


def record_success(counters: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Forget the counters of companies that succeeded."""
    return counters.join(succeeded.select("company").distinct(), "company", "left_anti")


def with_skip(companies: DataFrame, counters: DataFrame, threshold: int = SKIP_THRESHOLD,
              probe_after: Column | None = None) -> DataFrame:
    """Add ``failures`` and ``skipped`` to the catalogue.

    ``probe_after`` lets a skipped company be tried again when its last failure is
    older than that instant; without it a skipped company never recovers by itself.
    """
    c = counters.select(F.col("company").alias("name"), F.col("count").alias("failures"),
                        "last_error", "last_failed_at")
    skipped = F.col("failures") >= threshold
    if probe_after is not None:
        skipped = skipped & (F.col("last_failed_at") >= probe_after)
    return (
        companies.join(c, "name", "left")
        .withColumn("failures", F.coalesce("failures", F.lit(0)))
        .withColumn("skipped", F.coalesce(skipped, F.lit(False)))
    )
