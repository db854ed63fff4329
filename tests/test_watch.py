import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lookout.functions.text import dedup_key
from lookout.operators import rules
from lookout.plans import watch
from lookout.plans.profiles import ROBOTICS
from lookout.schemas import COMPANIES, RAW
from lookout.sources.state import Workspace
from lookout.streaming import poll

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def companies(spark):
    fields = [f.split()[0] for f in COMPANIES.split(", ")]
    rows = [("Boards", "greenhouse", True), ("Fleet", "workday", None), ("Broken", "greenhouse", True),
            ("Off", "greenhouse", False)]
    return spark.createDataFrame(
        [tuple({"pos": i, "name": n, "fetcher": f, "enabled": e, "host": "h", "site": "s"}.get(x)
               for x in fields) for i, (n, f, e) in enumerate(rows)], COMPANIES)


def job(i, title, place="Austin, TX, USA", content=""):
    return {"id": i, "title": title, "location": {"name": place}, "absolute_url": f"u{i}", "content": content}


def run_rows(run, jobs, fleet=("R1",), broken="HTTPError: 404"):
    at = T0 + timedelta(minutes=5 * run)
    wd = {"total": 1, "jobPostings": [{"bulletFields": [i], "title": "Robotics Engineer"} for i in fleet]}
    return [
        ("greenhouse", "Boards", 0, 0, at, "ok", json.dumps({"jobs": jobs})),
        ("workday", "Fleet", 0, 0, at, "ok", json.dumps(wd)),
        ("greenhouse", "Broken", 0, 0, at, broken, json.dumps({"jobs": [job(9, "Robot")]})),
        ("greenhouse", "Off", 0, 0, at, "ok", json.dumps({"jobs": [job(1, "Robotics Engineer")]})),
    ]


RUNS = [
    run_rows(0, [job(1, "Robotics Engineer"), job(2, "Senior Robotics Engineer")]),
    run_rows(1, [job(1, "Robotics Engineer"), job(3, "Robot Chef", "Galway, Ireland"),
                 job(4, "Firmware Engineer", content="<p>robot &amp; ros</p>")]),
    run_rows(2, [job(4, "Firmware Engineer"), job(5, "Test Engineer"), job(5, "Test Engineer")],
             fleet=("R1", "R2")),
]
ALERTS = [
    [("Boards:1", 6), ("Fleet:R1", 6)],
    [("Boards:4", 5)],
    [("Boards:5", 3), ("Boards:5", 3), ("Fleet:R2", 6)],
]


def alerts(ws, batch_id):
    return sorted((r.key, r.score) for r in ws.read_batch("alerts", batch_id).collect())


def test_three_runs(spark, companies, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    for i, rows in enumerate(RUNS):
        summary = watch.run_batch(ws, spark.createDataFrame(rows, RAW), companies, ROBOTICS, i).first()
        assert alerts(ws, i) == ALERTS[i]
        assert (summary.enabled, summary.skipped, summary.errors) == (3, 0, 1)
        assert summary.matched == len(ALERTS[i])
        assert "• Broken (greenhouse): failed page: HTTPError: 404" in summary.text
    assert [r.fetched for r in ws.read("run_summary").orderBy("batch_id").collect()] == [3, 4, 5]
    assert [r.new for r in ws.read("run_summary").orderBy("batch_id").collect()] == [3, 2, 3]
    seen = {r.key: r.alerted for r in ws.seen().collect()}
    assert seen == {"Boards:1": True, "Boards:2": False, "Boards:3": False, "Boards:4": True,
                    "Boards:5": True, "Fleet:R1": True, "Fleet:R2": True}
    fails = ws.latest("company_failures").collect()
    assert [(r.company, r["count"]) for r in fails] == [("Broken", 3)]
    # Running the last batch again changes nothing.
    watch.run_batch(ws, spark.createDataFrame(RUNS[2], RAW), companies, ROBOTICS, 2)
    assert alerts(ws, 2) == ALERTS[2]
    assert {r.key: r.alerted for r in ws.seen().collect()} == seen
    assert [(r.company, r["count"]) for r in ws.latest("company_failures").collect()] == [("Broken", 3)]
    # With a threshold of three the company is skipped from now on.
    summary = watch.run_batch(ws, spark.createDataFrame(RUNS[2], RAW), companies, ROBOTICS, 3, threshold=3).first()
    assert (summary.enabled, summary.skipped, summary.errors, summary.text) == (2, 1, 0, None)
    totals, report = watch.health(ws, companies, threshold=3)
    assert tuple(totals.first()) == (4, 3, 1, 7)
    status = {r.name: (r.status, r.tracked) for r in report.collect()}
    assert status == {"Boards": ("healthy", 5), "Fleet": ("healthy", 2), "Broken": ("auto_disabled", 0), "Off": ("disabled", 0)}


def test_seed_then_watch(spark, companies, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    seeded = watch.run_batch(ws, spark.createDataFrame(RUNS[0], RAW), companies, ROBOTICS, 0, seed=True).first()
    assert (seeded.fetched, seeded.new, seeded.matched) == (3, 0, 0)
    assert ws.read("alerts").count() == 0
    assert {r.alerted for r in ws.seen().collect()} == {False}
    watch.run_batch(ws, spark.createDataFrame(RUNS[1], RAW), companies, ROBOTICS, 1, dedupe_batch=True)
    assert alerts(ws, 1) == ALERTS[1]


def test_retention_evicts_the_oldest(spark, companies, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    for i, rows in enumerate(RUNS[:2]):
        watch.run_batch(ws, spark.createDataFrame(rows, RAW), companies, ROBOTICS, i, retained=2)
    assert {r.key for r in ws.seen().collect()} == {"Boards:3", "Boards:4"}


def test_verify(spark, companies):
    raw = spark.createDataFrame(RUNS[0], RAW)
    counts, preview = watch.verify(raw, companies, "bOARDS", ROBOTICS)
    assert {r.passes: r.postings for r in counts.collect()} == {True: 1, False: 1}
    assert [(r.passes, r.title) for r in preview.collect()] == [
        (True, "Robotics Engineer"), (False, "Senior Robotics Engineer")]
    only = watch.verify(raw, companies, "Boards", ROBOTICS, passing_only=True)[1]
    assert only.count() == 1


def land(spark, path, rows):
    spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_runs_and_survives_a_restart(spark, companies, tmp_path):
    ws, path = Workspace(spark, str(tmp_path / "ws")), str(tmp_path / "landing")
    land(spark, path, RUNS[0])
    go = lambda: poll.watch(ws, path, companies, ROBOTICS, interval=None, files_per_batch=1).awaitTermination()
    go()
    land(spark, path, RUNS[1])
    go()
    land(spark, path, RUNS[2])
    go()
    go()
    got = sorted((r.key, r.score) for r in ws.read("alerts").collect())
    assert got == sorted(sum(ALERTS, []))
    assert [(r.company, r["count"]) for r in ws.latest("company_failures").collect()] == [("Broken", 3)]


def test_streamed_failures_in_pieces(spark, tmp_path):
    path, ws = str(tmp_path / "log"), Workspace(spark, str(tmp_path / "ws"))
    schema = "company STRING, run_ts TIMESTAMP, ok BOOLEAN, error STRING"
    outcomes = {"a": "FFSFF", "b": "SSSSS", "c": "FFFFF", "d": "FFFFS"}
    for i in range(5):
        rows = [(c, T0 + timedelta(minutes=i), o[i] == "S", f"e{i}") for c, o in outcomes.items()]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = poll.landed(spark, path, schema, maxFilesPerTrigger="2")
    poll.start(stream, poll.failure_batch(ws), str(tmp_path / "cp")).awaitTermination()
    got = {r.company: (r["count"], r.last_error) for r in ws.latest("company_failures").collect()}
    assert got == {"a": (2, "e4"), "c": (5, "e4")}


def test_once_per_key_stream_with_metrics(spark, tmp_path):
    path = str(tmp_path / "posts")
    schema = "company STRING, job_id STRING, title STRING, location STRING, url STRING, description STRING, at TIMESTAMP"
    for i in range(3):
        rows = [("c", str(j), "Robotics Engineer" if j % 2 else "Chef", "usa", "u", "", T0) for j in range(i, i + 4)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = poll.landed(spark, path, schema, maxFilesPerTrigger="1").withColumn("key", dedup_key())
    fresh = poll.once_per_key(stream)
    scored = poll.observed(rules.with_score(fresh, ROBOTICS)).filter("passes").select("key")
    query = (scored.writeStream.format("memory").queryName("once").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted(r.key for r in spark.table("once").collect()) == ["c:1", "c:3", "c:5"]
    seen = [p["observedMetrics"]["run"] for p in query.recentProgress if "run" in p["observedMetrics"]]
    assert sum(m["scored"] for m in seen) == 6 and sum(m["matched"] for m in seen) == 3
    bounded = poll.once_per_key(stream, within=("at", "1 hour"))
    assert bounded.isStreaming


def test_read_config(spark, tmp_path):
    from lookout.operators.failures import SKIP_THRESHOLD
    from lookout.sources.config import read_config

    path = tmp_path / "config.json"
    path.write_text(json.dumps({
        "max_workers": 12,
        "filter": {"include_keywords": ["Robot"], "locations": ["USA"], "min_score": 2},
        "companies": [{"name": "B", "fetcher": "lever", "slug": "b"},
                      {"name": "A", "fetcher": "workday", "host": "h", "tenant": "t", "site": "s",
                       "search_terms": ["x", "y"], "enabled": False}],
    }, indent=1))
    profile, companies = read_config(spark, str(path))
    assert profile.include_keywords == ("robot",) and profile.min_score == 2
    assert profile.require_location_match and profile.exclude_keywords == ()
    assert [(r.pos, r.name, r.enabled, r.search_terms) for r in companies.orderBy("pos").collect()] == [
        (0, "B", None, None), (1, "A", False, ["x", "y"])]
    assert companies.dtypes == spark.createDataFrame([], COMPANIES).dtypes
    assert SKIP_THRESHOLD == 6


def test_a_failed_run_and_an_empty_one_are_told_apart(spark, companies):
    rows = [*RUNS[0], ("workday", "Fleet", 0, 0, T0, "ok", json.dumps({"total": 0, "jobPostings": []}))][1:]
    data = spark.createDataFrame([r for r in rows if r[1] != "Boards"][1:], RAW)
    of = lambda n: tuple(watch.outcome(data, companies, n, T0).first())[2:]
    assert of("broken") == (False, "Broken (greenhouse): failed page: HTTPError: 404", 0)
    assert of("Fleet") == (True, None, 0)
    assert of("Boards") == (False, "Boards (greenhouse): nothing landed", 0)


def test_the_runs_time_is_that_of_its_payloads_or_the_callers(spark, companies, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    nothing = spark.createDataFrame([], RAW)
    with pytest.raises(ValueError):
        watch.run_batch(ws, nothing, companies, ROBOTICS, 0)
    given = T0 + timedelta(days=3)
    watch.run_batch(ws, nothing, companies, ROBOTICS, 0, run_ts=given)
    assert {r.at for r in ws.read("run_log").selectExpr("unix_seconds(run_ts) AS at").collect()} == {int(given.timestamp())}
