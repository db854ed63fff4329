"""Reports: run counters, health, verification, rule evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lookout.functions.text import alert_text, key_company, summary_text, truncate
from lookout.operators.failures import SKIP_THRESHOLD
from lookout.operators.topk import with_rank

SHOWN_ERRORS = 10
PREVIEW = 50


def alert_order() -> list[Column]:
    """Best score first; the id makes the order total."""
    return [F.desc("score"), F.asc("company"), F.asc("title"), F.asc("job_id")]


def ranked(passed: DataFrame) -> DataFrame:
    """All alerts with their ``rank``, the best first."""
    return with_rank(passed, alert_order())


def alert_rows(passed: DataFrame) -> DataFrame:
    return passed.select("key", "company", "title", "score", alert_text().alias("text"))


def seen_per_company(seen: DataFrame) -> DataFrame:
    """Keys per catalogue entry.

    A posting's company may differ from its entry's name, and a name may hold a colon, so
    the entry is read from ``catalog_name``. Rows without it, of an older seen table, count
    for the key's part before its first colon; a key without a colon belongs to none.
    """
    entry = F.when(F.contains("key", F.lit(":")), key_company())
    if "catalog_name" in seen.columns:
        entry = F.coalesce("catalog_name", entry)
    counted = seen.groupBy(entry.alias("company")).agg(F.count("*").alias("tracked"))
    return counted.filter(F.col("company").isNotNull())


def catalogue_totals(companies: DataFrame, seen: DataFrame) -> DataFrame:
    on = F.coalesce("enabled", F.lit(True))
    totals = companies.agg(
        F.count("*").alias("companies"),
        F.count_if(on).alias("enabled"),
        F.count_if(~on).alias("disabled"),
    )
    return totals.withColumn("seen", seen.agg(F.count("*")).scalar())


def health(companies: DataFrame, failures: DataFrame, seen: DataFrame,
           threshold: int = SKIP_THRESHOLD) -> DataFrame:
    """One row per enabled company: status, failures, tracked keys, last error."""
    f = failures.select(F.col("company").alias("name"), F.col("count").alias("failures"),
                        "last_error")
    tracked = seen_per_company(seen).withColumnRenamed("company", "name")
    n = F.col("failures")
    status = (
        F.when(n >= threshold, "auto_disabled").when(n > 0, "recently_failing")
        .otherwise("healthy")
    )
    return (
        companies.filter(F.coalesce("enabled", F.lit(True)))
        .join(f, "name", "left")
        .join(tracked, "name", "left")
        .select(
            "name",
            F.coalesce("failures", F.lit(0)).alias("failures"),
            F.coalesce("tracked", F.lit(0)).alias("tracked"),
            F.when(n >= threshold, truncate(F.coalesce("last_error", F.lit("")), 100))
            .alias("last_error"),
        )
        .withColumn("status", status)
    )


def disabled(companies: DataFrame) -> DataFrame:
    """The entries that are switched off, as rows of the report."""
    off = companies.filter(~F.coalesce("enabled", F.lit(True)))
    return off.select(
        "name", F.lit(0).alias("failures"), F.lit(0).cast("bigint").alias("tracked"),
        F.lit(None).cast("string").alias("last_error"), F.lit("disabled").alias("status"),
    )


def health_sections(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(
        F.count("*").alias("companies"), F.sum("tracked").alias("tracked")
    )


def healthy_ranked(report: DataFrame) -> DataFrame:
    """Healthy companies with their ``rank`` by tracked keys."""
    return with_rank(report.filter(F.col("status") == "healthy"), [F.desc("tracked"), F.asc("name")])


def run_counters(postings: DataFrame, known: DataFrame, passed: DataFrame) -> DataFrame:
    """One row: fetched, new and matched, from three frames with a ``key`` column."""
    return postings.agg(F.count("*").alias("fetched")).select(
        "fetched",
        (F.col("fetched") - known.agg(F.count("*")).scalar()).alias("new"),
        passed.agg(F.count("*")).scalar().alias("matched"),
    )


def first_errors(run_log: DataFrame, order: list[Column], n: int = SHOWN_ERRORS) -> DataFrame:
    """One row with the first ``n`` error texts, and the number of all errors."""
    failed = run_log.filter(~F.col("ok"))
    shown = failed.orderBy(*order).limit(n).select("error", F.struct(*order).alias("_o"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("_o", "error"))), lambda e: e["error"])
    return shown.agg(texts.alias("shown")).withColumn(
        "errors", failed.agg(F.count("*")).scalar()
    )


def run_summary(counters: DataFrame, errors: DataFrame) -> DataFrame:
    """Counters and errors of a run in one row; ``text`` is null without errors."""
    return counters.withColumns(
        {
            "errors": errors.select("errors").scalar(),
            "_shown": errors.select("shown").scalar(),
        }
    ).select(
        "*",
        summary_text(F.col("fetched"), F.col("new"), F.col("matched"), F.col("_shown"))
        .alias("text"),
    ).drop("_shown")


def select_company(companies: DataFrame, name: str) -> DataFrame:
    """First catalogue entry with the name, whatever its case."""
    same = F.lower("name") == F.lower(F.lit(name))
    return companies.filter(same).orderBy("pos").limit(1)


def verdict_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("passes").agg(F.count("*").alias("postings"))


def verification(scored: DataFrame, order: list[Column], show: int = 10,
                 passing_only: bool = False) -> DataFrame:
    """First rows of a company, passing ones before the others."""
    if passing_only:
        scored = scored.filter("passes")
    return scored.orderBy(F.desc("passes"), *order).limit(show).select(
        "passes", "score", truncate("title", 55).alias("title"),
        truncate("location", 30).alias("location"), truncate("url", 50).alias("url"),
    )


def rule_evaluation(verdicts: DataFrame) -> DataFrame:
    """Confusion counts and rates of ``predicted`` against ``expected`` (both boolean)."""
    def both(expected: bool, predicted: bool) -> Column:
        hit = (F.col("expected") == expected) & (F.col("predicted") == predicted)
        return F.count_if(hit)

    counts = verdicts.agg(
        F.count("*").alias("total"),
        both(True, True).alias("tp"),
        both(False, True).alias("fp"),
        both(True, False).alias("fn"),
        both(False, False).alias("tn"),
    )
    return counts.withColumns(
        {
            "correct": F.col("tp") + F.col("tn"),
            "accuracy": F.try_divide(F.col("tp") + F.col("tn"), "total"),
            "precision": F.try_divide("tp", F.col("tp") + F.col("fp")),
            "recall": F.try_divide("tp", F.col("tp") + F.col("fn")),
        }
    )
