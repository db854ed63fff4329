"""Seen keys in buckets: what a batch reads, what stays on disk, and folders of the first layout."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lookout.operators import report, seen
from lookout.schemas import COMPANIES, FAILURES, SEEN, SEEN_V1
from lookout.sources.state import Workspace

T0 = datetime(2026, 1, 1)
POST = "company STRING, job_id STRING, title STRING, location STRING, url STRING, catalog_name STRING, pos INT"


def marks(spark, keys, entry="Team: A"):
    return spark.createDataFrame([(k, "Amazon", T0, "t", "l", "u", False, entry) for k in keys], SEEN)


def keys(df):
    return sorted(r.key for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    every = [f"a:{i}" for i in range(500)]
    ws.write_seen(marks(spark, every[:300]), 0)
    ws.compact_seen(0)
    ws.write_seen(marks(spark, every[300:]), 1)
    batch = seen.with_key(spark.createDataFrame([("a", "7", "t", "l", "u", "e", 0), ("a", "301", "t", "l", "u", "e", 1), ("a", "x", "t", "l", "u", "e", 2)], POST))
    wanted = seen.buckets_of(batch)
    known = ws.seen(2, wanted)
    assert {r.b for r in known.select(seen.bucket().alias("b")).collect()} <= set(wanted) and known.count() < 60
    text = plan(known)
    listed = ",".join(map(str, wanted))
    assert text.count("PartitionFilters") == 2 and text.count(f"bucket#") and listed in text.replace(" ", "")
    fresh = seen.new_postings(batch, known)
    assert keys(fresh) == ["a:x"] == keys(seen.new_postings(batch, known, seen_is_large=True))
    assert keys(ws.seen(2)) == sorted(every)


def test_each_table_is_scanned_once(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "ws"))
    ws.write_seen(marks(spark, ["a:1"]), 0)
    ws.compact_seen(0)
    spark.createDataFrame([("a", "1", "t", "l", "u", "e", 0)] * 3, POST).write.parquet(str(tmp_path / "b"))
    batch = seen.with_key(spark.read.parquet(str(tmp_path / "b")))
    text = plan(seen.new_postings(batch, spark.read.parquet(f"{ws.root}/seen_v2_base/batch_id=0")))
    assert text.count("FileScan parquet") == 2


def test_few_folders_after_many_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lookout.sources.state.BUCKETS", 2)
    monkeypatch.setattr("lookout.operators.seen.BUCKETS", 2)
    ws, every = Workspace(spark, str(tmp_path)), 5
    one = spark.createDataFrame([("a", 1, "e", T0)], FAILURES).coalesce(1)
    for k in range(24):
        ws.write_seen(marks(spark, [f"k:{k}"]), k)
        ws.write_rows(one, "scored", k)
        ws.write_snapshot(one, "company_failures", k)
        if (k + 1) % every == 0:
            ws.compact_seen(k)
    count = lambda t: len([n for n in os.listdir(tmp_path / t) if n.startswith("batch_id=")])
    assert all(count(t) <= 3 * every for t in ("seen_v2", "scored", "company_failures", "company_failures_ready"))
    assert count("seen_v2_base") == count("seen_v2_base_ready") == 2
    assert keys(ws.seen()) == sorted(f"k:{k}" for k in range(24))
    # The batches since the base before the newest can run again.
    for k in (15, 19, 23):
        assert keys(ws.seen(k)) == sorted(f"k:{i}" for i in range(k))
        assert ws.latest("company_failures", before=k).count() == 1


@pytest.mark.parametrize("based", [False, True])
def test_folders_of_the_first_layout_are_read_on(spark, tmp_path, based):
    ws = Workspace(spark, str(tmp_path))
    old = lambda ks: spark.createDataFrame([(k, k.split(":")[0], T0, "t", "l", "u", True) for k in ks], SEEN_V1)
    ws.write(old(["a:1", "b:2"]), "seen", 0)
    if based:
        ws.write_snapshot(old(["a:1", "b:2"]), "seen_base", 0)
    ws.write(old(["c:3"]), "seen", 1)
    ws.write_seen(marks(spark, ["Amazon:4"]), 2)
    got = {r.key: r.catalog_name for r in ws.seen().collect()}
    assert got == {"a:1": None, "b:2": None, "c:3": None, "Amazon:4": "Team: A"}
    assert {r.key for r in ws.seen(3, [r.b for r in ws.seen().select(seen.bucket().alias("b")).distinct().collect()]).collect()} == set(got)
    for k in (2, 3):
        ws.compact_seen(k)
        assert {r.key: r.catalog_name for r in ws.seen().collect()} == got
    assert not [n for n in os.listdir(tmp_path / "seen") if n.startswith("batch_id=")]


def test_health_counts_by_catalogue_entry(spark):
    fields = [f.split()[0] for f in COMPANIES.split(", ")]
    make = lambda i, n, on: tuple({"pos": i, "name": n, "enabled": on}.get(f) for f in fields)
    companies = spark.createDataFrame([make(0, "Amazon Robotics", True), make(1, "Team: A", None), make(2, "old", True), make(3, "Team: B", False)], COMPANIES)
    rows = [("Amazon:1", "Amazon Robotics"), ("Amazon:2", "Amazon Robotics"), ("Team: A:7", "Team: A"), ("old:1", None), ("Team: A:8", None), ("x", None)]
    known = spark.createDataFrame([(k, k.split(":")[0], T0, "t", "l", "u", False, e) for k, e in rows], SEEN)
    full = report.health(companies, spark.createDataFrame([], FAILURES), known).unionByName(report.disabled(companies))
    assert {r.name: (r.status, r.tracked) for r in full.collect()} == {
        "Amazon Robotics": ("healthy", 2), "Team: A": ("healthy", 1), "old": ("healthy", 1), "Team: B": ("disabled", 0)}


def test_marks_carry_the_entry_and_order_is_total(spark):
    rows = [("Amazon", "1", "b", "l", "u", "Amazon Robotics", 2), ("Amazon", "1", "a", "l", "u", "Amazon Robotics", 2)]
    batch = seen.with_key(spark.createDataFrame(rows, POST))
    for order in ([0, 1], [1, 0]):
        again = seen.with_key(spark.createDataFrame([rows[i] for i in order], POST))
        mark = seen.first_marks(again, T0 + timedelta(1), F.lit(True)).first()
        assert (mark.catalog_name, mark.title, mark.key) == ("Amazon Robotics", "a", "Amazon:1")
    assert batch.count() == 2
