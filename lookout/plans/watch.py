"""The three uses of the operators: a watch run, a verification, a health report."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from lookout.operators import failures, report, rules, seen
from lookout.operators.joins import lookup
from lookout.operators.rules import Profile
from lookout.schemas import PAGES
from lookout.session import scratch_dir
from lookout.sources import landing
from lookout.sources.state import Workspace

# Batches between two snapshots of the seen table.
COMPACT_EVERY = 16
# The seen keys of a batch's buckets are first cut down to the batch's own where they are
# so many times its rows.
LARGE = 8
ARRIVAL = ("run_ts", "catalog_name", "term_idx", "page_no", "pos")


def _arrival() -> list[Column]:
    return [F.col(c) for c in ARRIVAL]


def process_postings(ws: Workspace, postings: DataFrame, profile: Profile, batch_id: int, *,
                     seed: bool = False, dedupe_batch: bool = False, engine: str = "arrow",
                     retained: int | None = None, compact_every: int | None = COMPACT_EVERY) -> None:
    """Score what is new, write alerts, mark everything new as seen.

    New postings are scored once and written; alerts and marks come from that table.
    Seeding marks without scoring. Every ``compact_every`` batches the seen table becomes
    one snapshot; only ``retained`` evicts keys, and an evicted key alerts again.
    """
    postings = seen.with_key(postings)
    known = ws.seen(batch_id, seen.buckets_of(postings))
    # Both counts read few columns; that of the seen keys reads file footers only.
    large = known.count() > LARGE * postings.count()
    fresh = seen.new_postings(postings, known, dedupe_batch, _arrival(), large)
    if seed:
        marks = seen.first_marks(fresh, F.col("run_ts"), F.lit(False), _arrival())
    else:
        scored = rules.with_score(fresh, profile, engine).drop("breakdown", "description")
        scored = ws.write(scored, "scored", batch_id)
        passed = scored.filter("passes").orderBy(*report.alert_order())
        ws.write(report.alert_rows(passed), "alerts", batch_id)
        marks = seen.first_marks(scored, F.col("run_ts"), F.col("passes"), _arrival())
    ws.write_seen(marks, batch_id)
    # The count reads file footers only.
    full = retained is not None and ws.seen(batch_id + 1).count() > retained
    if full or (compact_every and (batch_id + 1) % compact_every == 0):
        ws.compact_seen(batch_id, retained)


def run_batch(ws: Workspace, raw: DataFrame, companies: DataFrame, profile: Profile,
              batch_id: int, *, seed: bool = False, strict: bool = False,
              dedupe_batch: bool = False, threshold: int = failures.SKIP_THRESHOLD,
              engine: str = "arrow", retained: int | None = None,
              compact_every: int | None = COMPACT_EVERY,
              probe_after: datetime | None = None, run_ts: datetime | None = None) -> DataFrame:
    """One run over landed payloads; returns its summary row.

    The run's time is the newest of its payloads; ``run_ts`` is that of a run of which
    nothing landed.
    """
    counters = ws.latest("company_failures", before=batch_id)
    choice = failures.with_skip(landing.active(companies), counters, threshold, None if probe_after is None else F.lit(probe_after))
    wanted = choice.filter(~F.col("skipped")).select(F.col("name").alias("company")).distinct()
    at = raw.agg(F.max("run_ts")).first()[0] or run_ts
    if at is None:
        raise ValueError("nothing landed: the run's time has to be given")
    raw = lookup(raw, wanted, ["company"], "left_semi")

    pages = ws.write(landing.read_pages(raw, companies), "pages", batch_id)
    stops = ws.write(landing.stops(pages), "page_stops", batch_id)
    parsed = landing.settle(pages, stops)
    ws.write(landing.quarantine(parsed), "quarantine", batch_id)
    log = landing.with_missing(
        landing.run_log(parsed), choice.filter(~F.col("skipped")).select("name", "fetcher"), F.lit(at).cast("timestamp")
    )
    log = ws.write(log, "run_log", batch_id)
    postings = landing.good_postings(parsed, strict)
    process_postings(ws, postings, profile, batch_id, seed=seed, dedupe_batch=dedupe_batch,
                     engine=engine, retained=retained, compact_every=compact_every)
    ws.write_snapshot(failures.update_failures(counters, log), "company_failures", batch_id)

    picked = choice.agg(
        F.count_if(~F.col("skipped")).alias("enabled"), F.count_if("skipped").alias("skipped")
    )
    if seed:
        new = matched = F.lit(0).cast("bigint")
    else:
        scored = ws.read_batch("scored", batch_id)
        new = scored.agg(F.count("*")).scalar()
        matched = scored.agg(F.count_if("passes")).scalar()
    counted = picked.withColumns({
        "run_ts": log.agg(F.max("run_ts")).scalar(),
        "fetched": postings.agg(F.count("*")).scalar(),
        "new": new,
        "matched": matched,
    })
    errors = report.first_errors(log, [F.col("run_ts"), F.col("company"), F.col("fetcher")])
    summary = report.run_summary(counted, errors).select(
        "run_ts", "enabled", "skipped", "fetched", "new", "matched", "errors", "text"
    )
    return ws.write(summary, "run_summary", batch_id)


def _settled(raw: DataFrame, companies: DataFrame) -> DataFrame:
    """Parsed and settled pages outside a run: written once, so that each body is parsed once."""
    spark, path = raw.sparkSession, scratch_dir(raw.sparkSession, "pages")
    landing.read_pages(raw, companies).write.parquet(path)
    pages = spark.read.schema(PAGES).parquet(path)
    return landing.settle(pages, landing.stops(pages))


def verify(raw: DataFrame, companies: DataFrame, name: str, profile: Profile, show: int = 10,
           passing_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Counts and first postings of one company, whatever was seen before."""
    chosen = report.select_company(companies, name)
    raw = raw.join(chosen.select(F.col("name").alias("company")), "company", "left_semi")
    parsed = _settled(raw, chosen)
    scored = rules.with_score(landing.good_postings(parsed), profile)
    preview = report.verification(scored, _arrival(), show, passing_only)
    return report.verdict_counts(scored), preview


def outcome(raw: DataFrame, companies: DataFrame, name: str, run_ts: datetime) -> DataFrame:
    """One row for a company: whether its pages could be read, the first error, the postings.

    So a failed run and one that found nothing are told apart.
    """
    chosen = report.select_company(companies, name)
    raw = raw.join(chosen.select(F.col("name").alias("company")), "company", "left_semi")
    log = landing.run_log(_settled(raw, chosen))
    log = landing.with_missing(log, chosen.select("name", "fetcher"), F.lit(run_ts).cast("timestamp"))
    return log.select("company", "fetcher", "ok", "error", "n_postings")


def health(ws: Workspace, companies: DataFrame,
           threshold: int = failures.SKIP_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Catalogue totals and the health of every company; ``disabled`` ones by name only."""
    known = ws.seen()
    enabled = report.health(companies, ws.latest("company_failures"), known, threshold)
    return report.catalogue_totals(companies, known), enabled.unionByName(report.disabled(companies))


Batch = Callable[[DataFrame, int], None]


def payload_batch(ws: Workspace, companies: DataFrame, profile: Profile, **options) -> Batch:
    """A streaming batch function over landed payloads."""
    def run(raw: DataFrame, batch_id: int) -> None:
        run_batch(ws, raw, companies, profile, batch_id, **options)
    return run
