"""Keyed failure counters, metrics of micro-batches, and the order of landed parts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lookout.operators import failures
from lookout.schemas import FAILURES
from lookout.sources.state import Workspace
from lookout.streaming import keyed, poll, replay

T0 = datetime(2026, 1, 1)
LOG = "company STRING, run_ts TIMESTAMP, run_id INT, ok BOOLEAN, error STRING"
OUTCOMES = {"a": "FFSFF", "b": "SSSSS", "c": "FFFFF", "d": "FFFFS", None: "SFFSF", "e": "SSSSF"}


def rows(i):
    """Each file has two runs of every company, in no order."""
    out = [(c, T0 + timedelta(minutes=i), 2 * i + k, o[i] == "S", None if o[i] == "S" else f"e{i}.{k}" + "x" * 400)
           for c, o in OUTCOMES.items() for k in (1, 0)]
    return out + [(None, T0 + timedelta(minutes=i), 90 + i, False, None)]


def land(spark, path, data):
    spark.createDataFrame(data, LOG).coalesce(1).write.mode("append").parquet(path)


def counters(df):
    return sorted(((r.company, r["count"], r.last_error, r.last_failed_at) for r in df.collect()), key=repr)


def test_keyed_counters_equal_the_batch_ones_and_survive_restarts(spark, tmp_path):
    ws, path = Workspace(spark, str(tmp_path / "ws")), str(tmp_path / "log")
    every = []
    for start, end in ((0, 2), (2, 5)):
        for i in range(start, end):
            land(spark, path, rows(i))
            every += rows(i)
        stream = poll.landed(spark, path, LOG, maxFilesPerTrigger="1")
        keyed.watch_streaks(ws, stream, str(tmp_path / "cp"), order=("run_ts", "run_id")).awaitTermination()
        log = spark.createDataFrame(every, LOG)
        want = failures.update_failures(spark.createDataFrame([], FAILURES), log, ("run_ts", "run_id"))
        assert counters(keyed.newest(ws)) == counters(want)
    assert {len(r.last_error) for r in keyed.newest(ws).collect() if r.last_error} == {300}


def test_a_timer_offers_a_skipped_company_again(spark, tmp_path):
    ws, path = Workspace(spark, str(tmp_path / "ws")), str(tmp_path / "log")
    minute = lambda m: T0 + timedelta(minutes=m)
    batches = [
        [("a", minute(i), i, False, "e") for i in range(3)] + [("b", minute(0), 0, False, "e")],
        [("b", minute(30), 1, True, None)],
        [("b", minute(90), 2, True, None)],
        [("b", minute(200), 3, True, None)],
        [("a", minute(201), 4, True, None)],
    ]
    for batch in batches:
        land(spark, path, batch)
    stream = poll.landed(spark, path, LOG, maxFilesPerTrigger="1")
    keyed.watch_streaks(ws, stream, str(tmp_path / "cp"), order=("run_ts", "run_id"), threshold=3,
                        probe_after=timedelta(hours=1), delay="1 minute").awaitTermination()
    of_a = [(r["count"], r.skipped, r.probe) for r in ws.read("streaks").where("company = 'a'").orderBy("batch_id").collect()]
    assert of_a == [(3, True, False), (3, False, True), (0, False, False)]
    assert keyed.newest(ws).count() == 0


def test_one_row_of_metrics_per_batch(spark, tmp_path):
    ws, path = Workspace(spark, str(tmp_path / "ws")), str(tmp_path / "posts")
    for i in range(3):
        spark.range(10 * i, 10 * i + 4 + i).select("id", (F.col("id") % 2 == 0).alias("passes")).coalesce(1).write.mode("append").parquet(path)

    def run(checkpoint):
        stream = poll.landed(spark, path, "id BIGINT, passes BOOLEAN", maxFilesPerTrigger="1")
        replay.listened(ws, poll.observed(stream).filter("passes"), str(tmp_path / checkpoint))
        return [tuple(r) for r in ws.read("stream_metrics").select("batch_id", "n_input", "scored", "matched").orderBy("batch_id").collect()]

    want = [(0, 4, 4, 2), (1, 5, 5, 3), (2, 6, 6, 3)]
    assert run("cp") == want
    # Nothing is left to read; and a replay of all batches replaces their rows.
    assert run("cp") == want and run("again") == want
    assert spark.read.parquet(f"{ws.root}/matched").count() == 8


@pytest.mark.parametrize("n", [0, 1, 50])
def test_parts_stream_in_order(spark, tmp_path, n):
    data = spark.range(n).select((F.col("id") * 7 % 50).alias("id"), F.lit("x").alias("v")).repartition(3)
    seen = {}
    stream = replay.landed_parts(data, F.col("id"), str(tmp_path / "landing"))
    poll.start(stream, lambda b, k: seen.update({k: sorted(r.id for r in b.collect())}), str(tmp_path / "cp")).awaitTermination()
    flat = [i for k in sorted(seen) for i in seen[k]]
    assert flat == sorted(r.id for r in data.collect()) and len(seen) == (replay.PARTS if n == 50 else n)


def test_a_large_part_is_several_files_and_one_batch(spark, tmp_path, monkeypatch):
    """No file holds much more than FILE_BYTES, whatever part the rows lie in."""
    monkeypatch.setattr(replay, "FILE_BYTES", 2000)
    # The first part holds nearly all rows, with one value; the last one a single row.
    data = spark.range(400).select(F.when(F.col("id") == 399, 1000).when(F.col("id") > 380, 500).otherwise(0).alias("id"), F.lit("x" * 92).alias("v"))
    seen, path = {}, str(tmp_path / "landing")
    stream = replay.landed_parts(data.repartition(3), F.col("id"), path)
    files = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 20 and max(r["count"] for r in files) <= 30
    poll.start(stream, lambda b, k: seen.update({k: sorted(r.id for r in b.collect())}), str(tmp_path / "cp")).awaitTermination()
    assert [seen[k] for k in sorted(seen)] == [[0] * 381, [500] * 18, [1000]]
