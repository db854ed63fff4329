import random
from datetime import datetime, timedelta, timezone
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from lookout.operators import failures, report, seen, topk
from lookout.schemas import COMPANIES, FAILURES, SEEN
from lookout.sources.state import Workspace

T0 = datetime(2026, 1, 1)
POST = "company STRING, job_id STRING, title STRING, location STRING, url STRING, pos INT"


def batch(spark, rows):
    """Rows of (company, job_id, title)."""
    full = [(c, j, t, "l", "u", i) for i, (c, j, t) in enumerate(rows)]
    return seen.with_key(spark.createDataFrame(full, POST))


def seen_table(spark, keys):
    return spark.createDataFrame(
        [(k, k.split(":")[0], T0, "old", "l", "u", False, None) for k in keys], SEEN)


def keys(df):
    return sorted(r.key for r in df.collect())


# --- seen -----------------------------------------------------------------------

def test_new_keeps_repeats_and_drops_known(spark):
    b = batch(spark, [("a", "1", "x"), ("a", "1", "y"), ("a", "2", "z"), ("b", None, "n"), ("b", "", "m")])
    s = seen_table(spark, ["a:2"])
    assert keys(seen.new_postings(b, s)) == ["a:1", "a:1", "b:", "b:"]
    once = seen.new_postings(b, s, dedupe_batch=True, order=[F.col("pos")]).collect()
    assert sorted((r.key, r.title) for r in once) == [("a:1", "x"), ("b:", "n")]
    assert keys(seen.seen_postings(b, s)) == ["a:2"]


def test_mark_seen_first_write_wins(spark):
    b = batch(spark, [("a", "1", "first"), ("a", "1", "second"), ("a", "2", "changed")])
    out = seen.mark_seen(seen_table(spark, ["a:2"]), b, T0, F.col("title") == "first", [F.col("pos")])
    rows = {r.key: (r.title, r.alerted) for r in out.collect()}
    assert out.count() == 2
    assert rows == {"a:1": ("first", True), "a:2": ("old", False)}
    again = seen.mark_seen(out, b, T0 + timedelta(1), F.lit(True), [F.col("pos")])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    assert seen.new_postings(b, out).count() == 0


def test_seed_never_alerts(spark):
    out = seen.seed(seen_table(spark, []), batch(spark, [("a", "1", "x")]), T0, [F.col("pos")])
    assert [(r.key, r.alerted) for r in out.collect()] == [("a:1", False)]


def test_known_keys_does_not_move_a_big_seen_table(spark, tmp_path):
    seen_table(spark, [f"a:{i}" for i in range(1000)]).write.parquet(str(tmp_path / "s"))
    batch(spark, [("a", "1", "x")]).write.parquet(str(tmp_path / "b"))
    s, b = (spark.read.parquet(str(tmp_path / n)) for n in "sb")
    new = seen.new_postings(b, s)
    assert new.count() == 0
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<key:string>" in plan


@pytest.mark.parametrize("n", [0, 1, 7, 50, 199, 200, 500])
def test_retain_matches_sorting(spark, n):
    rng = random.Random(n)
    # Many ties at one instant, neighbours a microsecond apart, and far ones.
    times = [T0, T0 + timedelta(microseconds=1), T0 + timedelta(milliseconds=3), T0 - timedelta(hours=5),
             T0 + timedelta(days=40), datetime(1969, 12, 31, 23, 59, 59, 999999)]
    rows = [(f"k:{i}", rng.choice(times)) for i in range(200)]
    df = spark.createDataFrame(rows, "key STRING, first_seen TIMESTAMP")
    want = sorted(rows, key=lambda r: (-r[1].replace(tzinfo=timezone.utc).timestamp(),
                                       md5(r[0].encode()).hexdigest(), r[0]))[:n]
    got = seen.retain(df, n)
    assert keys(got) == sorted(k for k, _ in want)
    assert got.columns == ["key", "first_seen"]


def test_hash_digits_split_one_instant(spark):
    rows = [(f"k:{i}", T0) for i in range(5000)]
    df = spark.createDataFrame(rows, "key STRING, first_seen TIMESTAMP")
    want = sorted(rows, key=lambda r: md5(r[0].encode()).hexdigest())[:1234]
    assert keys(seen.retain(df, 1234)) == sorted(k for k, _ in want)


@pytest.mark.parametrize("tied", [0, 3])
def test_retention_counts_digits_only_where_rows_tie(spark, monkeypatch, tied):
    """With few rows allowed to tie, all digits are counted, and the result is the same."""
    monkeypatch.setattr(topk, "TIED_ROWS", tied)
    times = [T0, T0 + timedelta(microseconds=1), T0 + timedelta(milliseconds=3), T0 + timedelta(seconds=2), None]
    rows = [(f"k:{i}", times[i % 5]) for i in range(300)]
    df = spark.createDataFrame(rows, "key STRING, first_seen TIMESTAMP")
    old = datetime(1900, 1, 1)
    want = sorted(rows, key=lambda r: ((r[1] or old) - old, [255 - b for b in md5(r[0].encode()).digest()], r[0]), reverse=True)
    for n in (1, 59, 60, 61, 130, 250, 299):
        assert keys(seen.retain(df, n)) == sorted(k for k, _ in want[:n])


# --- ranking --------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 3, 40])
def test_top_per_group_with_one_hot_group(spark, n):
    rng = random.Random(n)
    rows = [("hot" if i % 3 == 0 else f"g{i % 50}", rng.randint(0, 30), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g STRING, v INT, i INT").repartition(6)
    got = topk.top_per_group(df, ["g"], [F.desc("v"), F.asc("i")], n).collect()
    want = []
    for g in {r[0] for r in rows}:
        want += sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:n]
    assert sorted(map(tuple, got)) == sorted(want)


def test_first_per_key_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id").repartition(4)
    plan = topk.first_per_key(df, ["k"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Final") < plan.index("hashpartitioning(k") < plan.index("Partial")


def test_rank_preview_orders_and_numbers(spark):
    df = spark.createDataFrame([("b", "t", "1", 5), ("a", "t", "2", 5), ("a", "s", "3", 5), ("z", "t", "4", 9)],
                               "company STRING, title STRING, job_id STRING, score INT")
    top = topk.rank_preview(df, report.alert_order(), 3).orderBy("rank").collect()
    assert [(r["rank"], r.job_id) for r in top] == [(1, "4"), (2, "3"), (3, "2")]
    assert [r.job_id for r in df.orderBy(*report.alert_order()).collect()] == ["4", "3", "2", "1"]


# --- failures -------------------------------------------------------------------

LOG = "company STRING, run_ts TIMESTAMP, run_id INT, ok BOOLEAN, error STRING"


def log(spark, rows):
    """Rows of (company, minute, outcome)."""
    return spark.createDataFrame(
        [(c, T0 + timedelta(minutes=m), i, ok, None if ok else f"e{i}" + "x" * 400)
         for i, (c, m, ok) in enumerate(rows)], LOG)


def replay(rows, start=None):
    """One run after another, the way the counters are kept."""
    state = dict(start or {})
    for i, (c, m, ok) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        if ok:
            state.pop(c, None)
        else:
            state[c] = (state.get(c, (0,))[0] + 1, (f"e{i}" + "x" * 400)[:300])
    return state


def counters(df):
    return {r.company: (r["count"], r.last_error) for r in df.collect()}


def test_counters_match_replay(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abcdef"), rng.randint(0, 40), rng.random() < 0.3) for _ in range(120)]
    rows += [("never ok", m, False) for m in range(7)] + [("fine", 1, True)]
    none = spark.createDataFrame([], FAILURES)
    whole = failures.update_failures(none, log(spark, rows), ("run_ts", "run_id"))
    assert counters(whole) == replay(rows)
    # Folding the log in pieces gives the same counters.
    l = log(spark, rows)
    cut = F.lit(T0 + timedelta(minutes=20))
    half = failures.update_failures(none, l.filter(F.col("run_ts") < cut), ("run_ts", "run_id"))
    rest = failures.update_failures(half, l.filter(F.col("run_ts") >= cut), ("run_ts", "run_id"))
    assert counters(rest) == replay(rows)
    assert rest.schema.simpleString() == "struct<company:string,count:int,last_error:string,last_failed_at:timestamp>"


def test_record_failure_and_success(spark):
    start = spark.createDataFrame([("a", 5, "old", T0), ("b", 1, "old", T0)], FAILURES)
    new = spark.createDataFrame([("a", T0 + timedelta(1), "new")], "company STRING, run_ts TIMESTAMP, error STRING")
    more = failures.record_failure(start, new)
    assert counters(more) == {"a": (6, "new"), "b": (1, "old")}
    assert counters(failures.record_success(more, new)) == {"b": (1, "old")}


def test_skip_threshold_and_probe(spark):
    fields = [f.split()[0] for f in COMPANIES.split(", ")]
    companies = spark.createDataFrame(
        [tuple({"pos": i, "name": n}.get(f) for f in fields) for i, n in enumerate("abc")], COMPANIES)
    c = spark.createDataFrame([("a", 5, "e", T0), ("b", 6, "e", T0)], FAILURES)
    skip = lambda **kw: {r.name: r.skipped for r in failures.with_skip(companies, c, **kw).collect()}
    assert skip() == {"a": False, "b": True, "c": False}
    assert skip(probe_after=F.lit(T0 + timedelta(hours=1))) == {"a": False, "b": False, "c": False}


def test_health(spark):
    fields = [f.split()[0] for f in COMPANIES.split(", ")]
    make = lambda i, n, on: tuple({"pos": i, "name": n, "enabled": on}.get(f) for f in fields)
    companies = spark.createDataFrame(
        [make(0, "a", None), make(1, "b", True), make(2, "c", True), make(3, "d", False)], COMPANIES)
    c = spark.createDataFrame([("b", 5, "e", T0), ("c", 6, "y" * 150, T0), ("gone", 9, "e", T0)], FAILURES)
    s = seen_table(spark, ["a:1", "a:2:3", "c:1"]).unionByName(
        spark.createDataFrame([("nocolon", "x", T0, "t", "l", "u", False, None)], SEEN))
    out = {r.name: (r.status, r.failures, r.tracked, r.last_error)
           for r in report.health(companies, c, s).collect()}
    assert out == {"a": ("healthy", 0, 2, None), "b": ("recently_failing", 5, 0, None),
                   "c": ("auto_disabled", 6, 1, "y" * 100)}
    assert tuple(report.catalogue_totals(companies, s).first()) == (4, 3, 1, 4)
    picked = report.select_company(companies.withColumn("name", F.upper("name")), "a").collect()
    assert [r.name for r in picked] == ["A"]


# --- tables ---------------------------------------------------------------------

def test_missing_tables_are_empty_and_damaged_ones_fail(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    assert ws.seen().count() == 0
    assert ws.latest("company_failures").count() == 0
    folder = tmp_path / "seen" / "batch_id=0"
    folder.mkdir(parents=True)
    (folder / "part-0.parquet").write_bytes(b"not parquet at all")
    with pytest.raises(Exception):
        ws.seen().count()


def test_batches_overwrite_themselves_and_read_only_the_past(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    ws.write(seen_table(spark, ["a:1"]), "seen", 0)
    ws.write(seen_table(spark, ["a:2"]), "seen", 1)
    ws.write(seen_table(spark, ["a:3"]), "seen", 1)
    assert keys(ws.seen()) == ["a:1", "a:3"]
    assert keys(ws.seen(1)) == ["a:1"]
    one = spark.createDataFrame([("a", 1, "e", T0)], FAILURES)
    ws.write_snapshot(one, "company_failures", 0)
    ws.write_snapshot(one.limit(0), "company_failures", 1)
    assert ws.latest("company_failures").count() == 0
    assert ws.latest("company_failures", before=1).count() == 1


def test_compaction(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    for i in range(3):
        at = F.lit(T0 + timedelta(minutes=i))
        ws.write(seen_table(spark, [f"a:{i}", f"b:{i}"]).withColumn("first_seen", at), "seen", i)
    ws.compact_seen(2, 4)
    assert keys(ws.seen()) == ["a:1", "a:2", "b:1", "b:2"]
    assert keys(ws.seen(2)) == ["a:0", "a:1", "b:0", "b:1"]
    ws.write(seen_table(spark, ["c:3"]), "seen", 3)
    assert keys(ws.seen()) == ["a:1", "a:2", "b:1", "b:2", "c:3"]
