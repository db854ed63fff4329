"""Plans on data in which one key holds a third of all rows."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from lookout.operators import failures, seen, topk
from lookout.sources import landing


@contextmanager
def settings(spark, **values):
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "60000",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "60000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "8",
}


def executed(df):
    """Final adaptive plan of a query that has run."""
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def hot(i):
    return F.when(i % 3 == 0, F.lit(0)).otherwise(i % 4001)


def test_failure_streak_splits_a_hot_company(spark):
    n = 60_000
    with settings(spark, **SMALL):
        i = F.col("id")
        log = spark.range(n).repartition(8).select(
            hot(i).cast("string").alias("company"), F.timestamp_seconds(i).alias("run_ts"),
            i.alias("run_id"), (i < 10).alias("ok"), F.sha2(i.cast("string"), 256).alias("error"))
        rows, plan = executed(failures.failure_streak(log, order=("run_ts", "run_id")))
    assert "skew=true" in plan
    counts = {r.company: r["count"] for r in rows}
    assert counts["0"] == sum(1 for x in range(10, n) if x % 3 == 0 or x % 4001 == 0)
    assert sum(counts.values()) == n - 10


def test_new_postings_splits_a_hot_key(spark):
    n = 60_000
    with settings(spark, **SMALL):
        i = F.col("id")
        batch = spark.range(n).repartition(8).select(
            hot(i).cast("string").alias("key"), F.sha2(i.cast("string"), 256).alias("title"))
        known = spark.range(1, 4001, 2).select(F.col("id").cast("string").alias("key"))
        rows, plan = executed(seen.new_postings(batch, known))
    assert "skew=true" in plan
    keys = [0 if x % 3 == 0 else x % 4001 for x in range(n)]
    assert len(rows) == sum(1 for k in keys if k % 2 == 0)


def test_page_prefix_of_a_hot_group(spark):
    n = 60_000
    with settings(spark, **SMALL):
        i = F.col("id")
        pages = spark.range(n).repartition(8).select(
            hot(i).alias("company"), i.alias("page_no"), F.sha2(i.cast("string"), 256).alias("body"))
        stops = landing.prefix_stops(pages, ["company"], F.col("page_no"), i_is(30_000))
        rows, plan = executed(landing.contiguous_prefix(pages, stops, ["company"], F.col("page_no")))
    assert "skew=true" in plan
    assert len(rows) == n - sum(1 for x in range(30_001, n) if x % 3 == 0 or x % 4001 == 0)


def i_is(value):
    return F.col("page_no") == value


def test_first_per_key_sends_one_row_per_task_and_key(spark):
    i = F.col("id")
    rows = spark.range(90_000).repartition(6).select(hot(i).alias("k"), "id")
    first = topk.first_per_key(rows, ["k"], [F.col("id")])
    out = {r.k: r.id for r in first.collect()}
    assert out[0] == 0 and out[1] == 1 and len(out) == 4001
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "Final" in plan


@pytest.mark.parametrize("n", [3, 100, 1500])
def test_top_n_sends_n_rows_per_task_and_group(spark, n):
    rows = spark.range(30_000).repartition(6).select((F.col("id") % 2).alias("k"), "id")
    top = topk.top_per_group(rows, ["k"], [F.desc("id")], n)
    got, plan = executed(top)
    assert sorted(r.id for r in got) == list(range(30_000 - 2 * n, 30_000))
    # Limited in the input tasks and again after each of the two exchanges.
    assert plan.split("Initial Plan")[-1].count("WindowGroupLimit") == 4 and "hashpartitioning(k" in plan and "_salt" in plan


def test_ranks_split_a_hot_key(spark, tmp_path, monkeypatch):
    """A third of the rows have one score and company; the ranges cut through them."""
    n, path = 30_000, str(tmp_path / "ranked")
    monkeypatch.setattr(topk, "scratch_dir", lambda session, label: path)
    with settings(spark, **{"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}):
        i = F.col("id")
        rows = spark.range(n).repartition(4).select(hot(i).alias("score"), F.lit("c").alias("company"), F.sha2(i.cast("string"), 256).alias("title"), i.alias("job_id"))
        order = [F.desc("score"), F.asc("company"), F.asc("title"), F.asc("job_id")]
        got = topk.with_rank(rows, order).collect()
        parts = spark.read.parquet(path).groupBy(F.shiftright("_at", 33)).count().collect()
    path = str(tmp_path / "empty")
    assert len(parts) == 8 and max(r["count"] for r in parts) < n / 4
    want = sorted(got, key=lambda r: (-r.score, r.company, r.title, r.job_id))
    assert [r["rank"] for r in want] == list(range(1, n + 1))
    assert topk.with_rank(rows.limit(0), order).count() == 0
