"""Declared schemas of every table; nothing is inferred from data."""

from __future__ import annotations

POSTINGS = (
    "company STRING, job_id STRING, title STRING, location STRING, url STRING, "
    "description STRING, posted_at STRING"
)

RAW = (
    "fetcher STRING, company STRING, term_idx INT, page_no INT, run_ts TIMESTAMP, "
    "status STRING, body STRING"
)

COMPANIES = (
    "pos INT, name STRING, fetcher STRING, enabled BOOLEAN, slug STRING, host STRING, "
    "tenant STRING, site STRING, site_number STRING, public_url_base STRING, "
    "search_query STRING, search_terms ARRAY<STRING>, max_pages INT"
)

PROFILES = (
    "profile_id STRING, include_keywords ARRAY<STRING>, exclude_keywords ARRAY<STRING>, "
    "hard_exclude_anywhere ARRAY<STRING>, level_signals_positive ARRAY<STRING>, "
    "locations ARRAY<STRING>, min_score INT, require_location_match BOOLEAN"
)

# The first layout of the seen table; its folders are read on, without the later columns.
SEEN_V1 = (
    "key STRING, company STRING, first_seen TIMESTAMP, title STRING, location STRING, "
    "url STRING, alerted BOOLEAN"
)

# ``company`` is the posting's, ``catalog_name`` that of the catalogue entry it came from.
SEEN = SEEN_V1 + ", catalog_name STRING"

FAILURES = "company STRING, count INT, last_error STRING, last_failed_at TIMESTAMP"

# A counter as streaming state reports it.
STREAKS = FAILURES + ", skipped BOOLEAN, probe BOOLEAN"

METRICS = "query STRING, at STRING, n_input BIGINT, scored BIGINT, matched BIGINT"

RUN_LOG = (
    "run_ts TIMESTAMP, company STRING, fetcher STRING, ok BOOLEAN, error STRING, "
    "n_postings BIGINT"
)

# One row per landed item, or per page without items, before it is split into
# postings, quarantine and run log.
PARSED = (
    "fetcher STRING, catalog_name STRING, run_ts TIMESTAMP, term_idx INT, page_no INT, "
    "pos BIGINT, problem STRING, fatal BOOLEAN, is_item BOOLEAN, " + POSTINGS
)

# The same before the pages are cut; ``stop`` says that paging ends with this row's page.
PAGES = PARSED + ", stop BOOLEAN"

SCORED = (
    POSTINGS + ", catalog_name STRING, key STRING, run_ts TIMESTAMP, term_idx INT, page_no INT, pos BIGINT, "
    "score INT, passes BOOLEAN, reject_reason STRING"
)

ALERTS = "key STRING, company STRING, title STRING, score INT, text STRING"

SUMMARY = (
    "run_ts TIMESTAMP, enabled BIGINT, skipped BIGINT, fetched BIGINT, new BIGINT, "
    "matched BIGINT, errors BIGINT, text STRING"
)

QUARANTINE = (
    "fetcher STRING, catalog_name STRING, run_ts TIMESTAMP, term_idx INT, page_no INT, "
    "pos BIGINT, problem STRING, title STRING, url STRING"
)
