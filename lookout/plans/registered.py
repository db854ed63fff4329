"""Registered queries: every operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lookout.functions import text
from lookout.operators import failures, report, rules, seen, topk
from lookout.plans import views
from lookout.plans.payload_queries import PAYLOADS
from lookout.plans.profiles import POLITE, PROSE, ROBOTICS
from lookout.session import scratch_dir
from lookout.sources import landing
from lookout.streaming import replay

Query = Callable[[SparkSession, str], DataFrame]

TOXIC = ("idiot", "moron", "pathetic", "worthless")


def joined(values: Column) -> Column:
    return F.array_join(values, "|")


# --- rules --------------------------------------------------------------------

def keyword_hits(spark, d):
    scored = rules.with_score(views.postings(spark, d), PROSE)
    b = F.col("breakdown")
    lists = ("include_in_title", "include_in_desc", "level_pos_hits", "exclude_in_desc")
    return scored.select(
        "key", *[joined(b[c]).alias(c) for c in lists],
        F.size(b["include_in_title"]).alias("n_title"),
    )


def whole_word_excludes(spark, d):
    p = views.postings(spark, d).withColumn("_t", text.lowered("title"))
    found = rules.word_hits(F.col("_t"), PROSE.exclude_keywords)
    return p.select("key", joined(found).alias("exclude_in_title"))


def hard_exclude_location_gate(spark, d):
    b = F.col("breakdown")
    return rules.with_score(views.postings(spark, d), PROSE).select(
        "key", joined(b["hard_exclude_hits"]).alias("hard_exclude_hits"),
        b["location_ok"].alias("location_ok"), b["location_text"].alias("location_text"),
    )


def _scores(profile, engine):
    def query(spark, d):
        scored = rules.with_score(views.postings(spark, d), profile, engine)
        return scored.select("key", "score", "passes", "reject_reason")
    return query


def breakdown_record(spark, d):
    b = rules.with_score(views.postings(spark, d), ROBOTICS).select("key", "breakdown.*")
    flat = [joined(F.col(c)).alias(c) if t.startswith("array") else F.col(c) for c, t in b.dtypes]
    return b.select(*flat)


def score_multi_profile(spark, d):
    scored = rules.score_profiles(views.postings(spark, d), [PROSE, POLITE, ROBOTICS])
    return scored.select("key", "profile_id", "score", "passes", "reject_reason")


def _new_passing(spark, d):
    p = views.postings(spark, d)
    fresh = seen.new_postings(p, views.labelled(spark, d, p))
    return rules.passing(fresh, PROSE)


def ranked_new_alerts(spark, d):
    passed = _new_passing(spark, d).select("key", "company", "job_id", "title", "score")
    return report.ranked(passed)


def preview_top_alerts(spark, d):
    top = topk.rank_preview(
        _new_passing(spark, d).select("key", "company", "title", "job_id", "score"),
        report.alert_order(), report.PREVIEW,
    )
    return top.select("rank", "key", "score")


def top_alerts_per_company(spark, d):
    passed = rules.passing(views.postings(spark, d), PROSE)
    order = [F.desc("score"), F.asc("title"), F.asc("job_id")]
    short = passed.select("company", "title", "job_id", "key", "score")
    return topk.top_per_group(short, ["company"], order, 3).select("company", "key", "score")


# --- seen state -----------------------------------------------------------------

def new_postings(spark, d):
    p = views.copies(spark, d)
    return seen.new_postings(p, views.labelled(spark, d, p)).select("key", "doc_id")


def new_postings_deduped(spark, d):
    p = views.copies(spark, d)
    known = views.labelled(spark, d, p)
    fresh = seen.new_postings(p, known, dedupe_batch=True, order=[F.col("doc_id")])
    return fresh.select("key", "doc_id")


def seen_semi(spark, d):
    p = views.copies(spark, d)
    return seen.seen_postings(p, views.labelled(spark, d, p)).select("key", "doc_id")


def _seen_before(spark, d, p):
    return seen.first_marks(
        views.labelled(spark, d, p), views.instant(views.SEEN_TS), F.lit(True), [F.col("doc_id")]
    )


def seen_upsert(spark, d):
    p = views.copies(spark, d)
    return seen.mark_seen(
        _seen_before(spark, d, p), p, views.instant(views.RUN_TS),
        F.col("location") == "en", [F.col("doc_id")],
    ).drop("catalog_name")


def seed_state(spark, d):
    p = views.copies(spark, d)
    return seen.seed(_seen_before(spark, d, p), p, views.instant(views.RUN_TS), [F.col("doc_id")]).drop("catalog_name")


def retain_newest(spark, d):
    return seen.retain(views.user_keys(spark, d), 5000)


def retain_newest_ties(spark, d):
    """Whole days as first sighting, so that the cut falls within one instant."""
    keys = views.user_keys(spark, d).withColumn(
        "first_seen", F.to_date("first_seen").cast("timestamp_ntz")
    )
    return seen.retain(keys, 5000)


def first_per_source_id(spark, d):
    events = views.table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return topk.first_per_key(
        events, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]
    ).drop("ts")


def newest_n_per_company(spark, d):
    orders = views.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return topk.top_per_group(
        orders, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 5
    ).select("o_custkey", "o_orderkey")


def newest_100_per_source(spark, d):
    lines = views.table(spark, d, "lineitem").select(
        "l_returnflag", "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey"
    )
    order = [F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return topk.top_per_group(lines, ["l_returnflag"], order, 100).drop("l_shipdate")


def contiguous_page_prefix(spark, d):
    runs = views.run_log(spark, d)
    order = F.struct("run_ts", "run_id")
    stops = landing.prefix_stops(runs, ["company"], order, ~F.col("ok"))
    kept = landing.contiguous_prefix(runs, stops, ["company"], order)
    return kept.filter("ok").select("company", "run_id")


# --- failures -------------------------------------------------------------------

ORDER = ("run_ts", "run_id")


def failure_streak(spark, d):
    return failures.failure_streak(views.run_log(spark, d), order=ORDER)


def failure_upsert(spark, d):
    """Counters after the first half of the month, then updated with the rest."""
    runs = views.run_log(spark, d)
    half = views.instant("2024-01-16 00:00:00")
    none = spark.createDataFrame(
        [], "company STRING, count INT, last_error STRING, last_failed_at TIMESTAMP_NTZ"
    )
    first = failures.update_failures(none, runs.filter(F.col("run_ts") < half), ORDER)
    return failures.update_failures(first, runs.filter(F.col("run_ts") >= half), ORDER)


def _counters(spark, d):
    return failure_streak(spark, d).filter(F.col("count") > 0).drop("had_ok")


def success_reset(spark, d):
    """Counters of all failures so far, minus every company whose last run succeeded."""
    runs = views.run_log(spark, d)
    failed = runs.filter(~F.col("ok")).groupBy("company").agg(F.count("*").cast("int").alias("count"))
    last = topk.first_per_key(runs, ["company"], [F.desc("run_ts"), F.desc("run_id")])
    return failures.record_success(failed, last.filter("ok"))


def auto_skip(spark, d):
    companies = landing.active(views.catalogue(spark, d))
    skip = failures.with_skip(companies, _counters(spark, d), threshold=2)
    return skip.select("name", "failures", "skipped")


# --- reports --------------------------------------------------------------------

def health_report(spark, d):
    return report.health(
        views.catalogue(spark, d), _counters(spark, d), views.user_keys(spark, d), threshold=2
    )


def health_sections(spark, d):
    return report.health_sections(health_report(spark, d))


def healthy_ranked(spark, d):
    return report.healthy_ranked(health_report(spark, d)).select("rank", "name", "tracked")


def health_totals(spark, d):
    return report.catalogue_totals(views.catalogue(spark, d), views.user_keys(spark, d))


def seen_per_company(spark, d):
    return report.seen_per_company(views.event_keys(spark, d))


def run_summary(spark, d):
    p = views.postings(spark, d)
    known = views.labelled(spark, d, p)
    counters = report.run_counters(p, known, _new_passing(spark, d))
    log = views.run_log(spark, d).withColumn(
        "error", text.company_error(F.col("company"), F.col("fetcher"), F.col("error"))
    )
    errors = report.first_errors(log, [F.col("run_ts"), F.col("run_id")])
    return report.run_summary(counters, errors)


def run_errors(spark, d):
    log = views.run_log(spark, d).filter(~F.col("ok"))
    return log.select("run_id", text.company_error(
        F.col("company"), F.col("fetcher"), F.col("error")).alias("error"))


def _one_company(spark, d):
    p = views.postings(spark, d)
    names = p.groupBy(F.col("company").alias("name")).agg(F.min("doc_id").alias("pos"))
    chosen = report.select_company(names, "SRC3").select(F.col("name").alias("company"))
    return rules.with_score(p.join(chosen, "company", "left_semi"), PROSE)


def verify_company(spark, d):
    return report.verification(_one_company(spark, d), [F.col("doc_id")])


def verify_counts(spark, d):
    return report.verdict_counts(_one_company(spark, d))


def rule_eval(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", "text")
    labels = views.table(spark, d, "labels").select("doc_id", "toxic")
    predicted = rules.title_excluded(F.lower("text"), TOXIC)
    verdicts = docs.join(labels, "doc_id").select(
        (F.col("toxic") == 1).alias("expected"), predicted.alias("predicted")
    )
    return report.rule_evaluation(verdicts)


# --- text -----------------------------------------------------------------------

def strip_html(spark, d):
    pages = views.table(spark, d, "pages").select("page_id", "html")
    return text.with_stripped_html(pages, "html", "text").drop("html")


def strip_html_unescape_first(spark, d):
    pages = views.table(spark, d, "pages").select("page_id", "html")
    return text.with_stripped_html(pages, "html", "text", unescape_first=True).drop("html")


def html_escape(spark, d):
    return views.postings(spark, d).select("key", text.escape_html("title").alias("escaped"))


def alert_text(spark, d):
    return report.alert_rows(rules.passing(views.postings(spark, d), PROSE))


def posted_timestamps(spark, d):
    """Event times as ISO text, as epoch milliseconds, and as relative text."""
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    epoch = F.timestamp_diff("SECOND", views.instant("1970-01-01 00:00:00"), F.col("ts"))
    posted = (
        F.when(F.col("event_type") == "click", iso)
        .when(F.col("event_type") == "view", (epoch * 1000).cast("string"))
        .otherwise("Posted 3 Days Ago")
    )
    events = views.table(spark, d, "events").select("event_id", posted.alias("posted_at"))
    return events.select("event_id", F.unix_millis(text.posted_ts()).alias("posted_ms"))


# --- sources --------------------------------------------------------------------

def _normalize(name):
    def query(spark, d):
        companies = views.brands(spark, d)
        return landing.normalize(name, views.payloads(spark, d, [name]), companies)
    return query


def _written(df: DataFrame, label: str, *partitions: str) -> DataFrame:
    """The frame as a scratch table, so that several passes do not compute it again."""
    path = scratch_dir(df.sparkSession, label)
    df.write.partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dispatched(spark, d):
    """All payloads, landed by fetcher as a real feed would be, and then parsed."""
    raw = views.payloads(spark, d)
    nobody = raw.filter(F.col("fetcher") == "meta").withColumn("fetcher", F.lit("nobody"))
    landed = _written(raw.unionByName(nobody), "landing", "fetcher")
    return landing.dispatch(landed, views.brands(spark, d))


def union_sources(spark, d):
    return landing.good_postings(_dispatched(spark, d)).select(*landing.POSTING)


def dispatch_sources(spark, d):
    # The run log reads the parsed rows twice.
    log = landing.run_log(_written(_dispatched(spark, d), "parsed"))
    return log.select("company", "fetcher", "ok", "error", "n_postings")


def quarantine(spark, d):
    bad = landing.quarantine(_dispatched(spark, d))
    return bad.groupBy("fetcher", "problem").agg(F.count("*").alias("rows"))


def paged_sources(spark, d):
    """Postings and problems of many pages, after pages are cut where their source stops."""
    cap = F.when(F.col("name") == "Brand#11", 2).cast("int")
    companies = views.brands(spark, d).withColumn("max_pages", cap)
    pages = _written(landing.read_pages(views.paged_payloads(spark, d), companies), "pages")
    rows = landing.settle(pages, landing.stops(pages)).filter("is_item OR problem IS NOT NULL")
    return rows.select("fetcher", F.col("catalog_name").alias("company"), "term_idx", "page_no",
                       F.when(F.col("is_item"), F.col("job_id")).alias("job_id"),
                       F.when(F.col("is_item"), F.col("title")).alias("title"), "problem")


def missing_companies(spark, d):
    """The run log of a catalogue of which some entries landed nothing or have no fetcher."""
    log = landing.run_log(landing.dispatch(views.payloads(spark, d, ["lever"]), views.brands(spark, d)))
    some = views.table(spark, d, "supplier").select(
        F.concat(F.lit("Brand#"), F.col("s_suppkey") % 60).alias("name"),
        F.when(F.col("s_suppkey") % 3 > 0, F.lit("lever")).alias("fetcher"),
    )
    wanted = topk.first_per_key(some, ["name"], [F.asc_nulls_last("fetcher")])
    return landing.with_missing(log, wanted, views.instant(views.RUN_TS)).select("company", "fetcher", "ok", "error", "n_postings")


def health_by_catalogue(spark, d):
    """Health by catalogue entry: names with a colon, literal companies, and rows without an entry."""
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("team: "), "c_custkey")).otherwise(F.col("c_custkey").cast("string"))
    companies = views.table(spark, d, "customer").select(
        name.alias("name"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") > 0).alias("enabled"))
    user = F.col("user_id")
    entry = F.when(user % 2 == 0, F.concat(F.lit("team: "), user)).when(F.col("event_type") != "view", user.cast("string"))
    known = views.table(spark, d, "events").select(
        F.concat_ws(":", F.when(user % 2 == 0, F.lit("Team")).otherwise(user.cast("string")), "event_id").alias("key"),
        entry.alias("catalog_name"))
    counters = _counters(spark, d)
    full = report.health(companies, counters, known, threshold=2)
    return full.unionByName(report.disabled(companies))


def enabled_companies(spark, d):
    return landing.active(views.catalogue(spark, d)).select("name")


QUERIES: dict[str, Query] = {
    "ranked_new_alerts": ranked_new_alerts,
    "preview_top_alerts": preview_top_alerts,
    "top_alerts_per_company": top_alerts_per_company,
    "keyword_hits": keyword_hits,
    "whole_word_excludes": whole_word_excludes,
    "hard_exclude_location_gate": hard_exclude_location_gate,
    "score_and_pass": _scores(PROSE, "arrow"),
    "score_and_pass_native": _scores(PROSE, "native"),
    "score_robotics": _scores(ROBOTICS, "arrow"),
    "breakdown_record": breakdown_record,
    "score_multi_profile": score_multi_profile,
    "new_postings": new_postings,
    "new_postings_deduped": new_postings_deduped,
    "seen_semi": seen_semi,
    "seen_upsert": seen_upsert,
    "seed_state": seed_state,
    "retain_newest": retain_newest,
    "retain_newest_ties": retain_newest_ties,
    "first_per_source_id": first_per_source_id,
    "newest_n_per_company": newest_n_per_company,
    "newest_100_per_source": newest_100_per_source,
    "contiguous_page_prefix": contiguous_page_prefix,
    "failure_streak": failure_streak,
    "failure_upsert": failure_upsert,
    "success_reset": success_reset,
    "auto_skip": auto_skip,
    "health_report": health_report,
    "health_sections": health_sections,
    "healthy_ranked": healthy_ranked,
    "health_totals": health_totals,
    "seen_per_company": seen_per_company,
    "run_summary": run_summary,
    "run_errors": run_errors,
    "verify_company": verify_company,
    "verify_counts": verify_counts,
    "rule_eval": rule_eval,
    "strip_html": strip_html,
    "strip_html_unescape_first": strip_html_unescape_first,
    "html_escape": html_escape,
    "alert_text": alert_text,
    "posted_timestamps": posted_timestamps,
    **{f"normalize_{name}": _normalize(name) for name in PAYLOADS},
    "union_sources": union_sources,
    "dispatch_sources": dispatch_sources,
    "quarantine": quarantine,
    "enabled_companies": enabled_companies,
    "paged_sources": paged_sources,
    "missing_companies": missing_companies,
    "health_by_catalogue": health_by_catalogue,
    "stream_alerts": replay.stream_alerts,
    "stream_streak": replay.stream_streak,
    "stream_streak_keyed": replay.stream_streak_keyed,
    "stream_first_keys": replay.stream_first_keys,
    "stream_metrics": replay.stream_metrics,
}
