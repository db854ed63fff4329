"""The registered queries as DuckDB SQL, for the side-by-side check."""

from __future__ import annotations

import re

from lookout.operators.rules import Profile
from lookout.plans.payload_queries import PAGED_SQL, PAYLOADS, expected_sql
from lookout.plans.profiles import POLITE, PROSE, ROBOTICS
from lookout.plans.registered import TOXIC
from lookout.plans.views import RUN_TS, SEEN_TS


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::VARCHAR[]"


POSTINGS = """postings AS (
  SELECT source AS company, CAST(doc_id AS VARCHAR) AS job_id,
         split_part(text, chr(10), 1) AS title, lang AS location,
         'doc/' || doc_id AS url, text AS description, doc_id,
         source || ':' || doc_id AS key
  FROM documents)"""

COPIES = """copies AS (
  SELECT lang AS company, split_part(text, chr(10), 1) AS title, lang AS location,
         'doc/' || doc_id AS url, doc_id, lang || ':' || md5(text) AS key
  FROM documents)"""

KNOWN = "known AS (SELECT DISTINCT key FROM copies WHERE doc_id IN (SELECT doc_id FROM labels))"


def whole_words(text: str, values: tuple[str, ...]) -> str:
    r"""Phrases found as whole words; \b is ASCII in DuckDB, so the boundary is spelled out."""
    edge = r"[^\p{L}\p{N}_]"
    found = ", ".join(
        f"CASE WHEN regexp_matches({text}, {q(f'(^|{edge}){re.escape(v)}($|{edge})')}) THEN {q(v)} END"
        for v in values)
    return f"list_filter([{found}]::VARCHAR[], lambda k: k IS NOT NULL)"


def scored_ctes(p: Profile, name: str = "scored") -> str:
    """Common table expressions from ``postings`` to verdicts of one profile."""
    place = "l = '' OR len(list_filter({}, lambda k: contains(l, k))) > 0".format(words(p.locations))
    wrong = f"NOT location_ok AND {str(p.require_location_match).lower()}"
    return f"""{name}_t AS (
  SELECT *, lower(title) AS t, lower(description) AS d, lower(location) AS l,
         lower(title) || ' ' || lower(description) || ' ' || lower(location) AS c
  FROM postings),
{name}_h AS (
  SELECT *, list_filter({words(p.include_keywords)}, lambda k: contains(t, k)) AS it,
         list_filter({words(p.include_keywords)}, lambda k: contains(d, k) AND NOT contains(t, k)) AS idd,
         list_filter({words(p.level_signals_positive)}, lambda k: contains(c, k)) AS lv,
         {whole_words('t', p.exclude_keywords)} AS xt,
         list_filter({words(p.exclude_keywords)}, lambda k: contains(d, k)) AS xa,
         list_filter({words(p.hard_exclude_anywhere)}, lambda k: contains(c, k)) AS hx,
         ({place}) AS location_ok
  FROM {name}_t),
{name}_x AS (
  SELECT *, list_filter(xa, lambda k: NOT list_contains(xt, k)) AS xd FROM {name}_h),
{name}_s AS (
  SELECT *, CAST(3 * len(it) + len(idd) + 2 * len(lv) - 5 * len(xt) - len(xd) AS INTEGER) AS score
  FROM {name}_x),
{name} AS (
  SELECT *, CASE WHEN len(hx) > 0 THEN 'hard_exclude' WHEN {wrong} THEN 'location'
                 WHEN len(xt) > 0 THEN 'title_exclude' WHEN score < {p.min_score} THEN 'low_score'
            END AS reject_reason
  FROM {name}_s)"""


def bar(column: str) -> str:
    return f"array_to_string({column}, '|')"


def scores(p: Profile) -> str:
    return (f"WITH {POSTINGS}, {scored_ctes(p)} SELECT key, score, reject_reason IS NULL AS passes, "
            "reject_reason FROM scored")


def flat(text: str) -> str:
    """Tags already handled: entities, then white space."""
    for name, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "),
                        ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = f"replace({text}, {q(name)}, {q(plain)})"
    # A cut-off entity at the very end of the page.
    text = f"regexp_replace({text}, '&amp$', '&')"
    return text


def squeezed(text: str) -> str:
    return rf"trim(regexp_replace({text}, '[\s\x0b\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g'))"


def escaped(text: str) -> str:
    return (f"replace(replace(replace(coalesce({text}, ''), '&', '&amp;'), '<', '&lt;'), "
            "'>', '&gt;')")


STREAK = """runs AS (
  SELECT CAST(user_id AS VARCHAR) AS company, ts AS run_ts, event_id AS run_id,
         event_type AS fetcher, event_type <> 'error' AS ok, props AS error
  FROM events),
tails AS (
  SELECT *, NOT EXISTS (SELECT 1 FROM runs AS later WHERE later.company = r.company
                        AND later.ok AND later.run_ts >= r.run_ts
                        AND (later.run_ts, later.run_id) >= (r.run_ts, r.run_id)) AS open
  FROM runs AS r),
streak AS (
  SELECT company, CAST(count(*) FILTER (WHERE open) AS INTEGER) AS count, bool_or(ok) AS had_ok,
         arg_max(substr(error, 1, 300), run_id) FILTER (WHERE open) AS last_error,
         max(run_ts) FILTER (WHERE open) AS last_failed_at
  FROM tails GROUP BY company)"""

CATALOGUE = """catalogue AS (
  SELECT CAST(c_custkey AS VARCHAR) AS name,
         coalesce(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal > 0 END, true) AS enabled
  FROM customer)"""

HEALTH = f"""{STREAK}, {CATALOGUE},
tracked AS (SELECT CAST(user_id AS VARCHAR) AS name, count(*) AS n FROM events GROUP BY user_id),
health AS (
  SELECT c.name, coalesce(s.count, 0) AS failures, coalesce(t.n, 0) AS tracked,
         CASE WHEN s.count >= 2 THEN substr(coalesce(s.last_error, ''), 1, 100) END AS last_error,
         CASE WHEN coalesce(s.count, 0) >= 2 THEN 'auto_disabled'
              WHEN coalesce(s.count, 0) > 0 THEN 'recently_failing' ELSE 'healthy' END AS status
  FROM catalogue AS c LEFT JOIN streak AS s ON s.company = c.name
  LEFT JOIN tracked AS t USING (name) WHERE c.enabled)"""

PASSED = f"{POSTINGS}, {scored_ctes(PROSE)}, passed AS (SELECT * FROM scored WHERE reject_reason IS NULL)"
NEW_PASSED = f"{PASSED}, fresh AS (SELECT * FROM passed WHERE doc_id NOT IN (SELECT doc_id FROM labels))"


def marked(alerted: str) -> str:
    return f"""WITH {COPIES}, {KNOWN},
  firsts AS (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS rn FROM copies
    WHERE key NOT IN (SELECT key FROM known)),
  olds AS (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS rn FROM copies
    WHERE doc_id IN (SELECT doc_id FROM labels))
  SELECT key, company, TIMESTAMP '{SEEN_TS}' AS first_seen, title, location, url, true AS alerted
  FROM olds WHERE rn = 1
  UNION ALL
  SELECT key, company, TIMESTAMP '{RUN_TS}', title, location, url, {alerted} FROM firsts WHERE rn = 1"""


def retained(first_seen: str) -> str:
    return (f"SELECT CAST(user_id AS VARCHAR) || ':' || event_id AS key, {first_seen} AS first_seen "
            "FROM events ORDER BY 2 DESC, md5(CAST(user_id AS VARCHAR) || ':' || event_id) LIMIT 5000")


def summary() -> str:
    line = escaped("company || ' (error): ' || error")
    return f"""WITH {NEW_PASSED}, {STREAK.split('tails AS')[0].rstrip().rstrip(',')},
  failed AS (SELECT *, row_number() OVER (ORDER BY run_ts, run_id) AS rn FROM runs WHERE NOT ok),
  counted AS (
    SELECT (SELECT count(*) FROM documents) AS fetched,
           (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS new,
           (SELECT count(*) FROM fresh) AS matched, (SELECT count(*) FROM failed) AS errors,
           (SELECT string_agg('• ' || {line}, chr(10) ORDER BY rn) FROM failed WHERE rn <= 10) AS lines)
  SELECT fetched, new, matched, errors,
         '📊 Run summary' || chr(10) || 'Fetched: ' || fetched || chr(10) || 'New: ' || new || chr(10)
         || 'Alerted: ' || matched || chr(10) || chr(10) || '⚠️ Errors:' || chr(10) || lines AS text
  FROM counted"""


def alert() -> str:
    place = f"coalesce(nullif({escaped('location')}, ''), '—')"
    return f"""WITH {PASSED} SELECT key, company, title, score,
      '🚨 <b>' || {escaped('title')} || '</b>' || chr(10) || '🏢 ' || {escaped('company')} || chr(10)
      || '📍 ' || {place} || chr(10) || '⭐ score: ' || score || chr(10)
      || '🔗 <a href="' || {escaped('url')} || '">Apply</a>' AS text
      FROM passed"""


VERIFY = (f"{POSTINGS}, {scored_ctes(PROSE)}, "
          "mine AS (SELECT *, reject_reason IS NULL AS passes FROM scored WHERE lower(company) = 'src3')")

SQL: dict[str, str] = {
    "ranked_new_alerts": f"""WITH {NEW_PASSED} SELECT key, company, job_id, title, score,
        row_number() OVER (ORDER BY score DESC, company, title, job_id) AS rank FROM fresh""",
    "preview_top_alerts": f"""WITH {NEW_PASSED}
        SELECT CAST(row_number() OVER (ORDER BY score DESC, company, title, job_id) AS INTEGER) AS rank, key, score
        FROM fresh QUALIFY rank <= 50""",
    "top_alerts_per_company": f"""WITH {PASSED} SELECT company, key, score FROM passed
        QUALIFY row_number() OVER (PARTITION BY company ORDER BY score DESC, title, job_id) <= 3""",
    "keyword_hits": f"""WITH {POSTINGS}, {scored_ctes(PROSE)}
        SELECT key, {bar('it')} AS include_in_title, {bar('idd')} AS include_in_desc,
               {bar('lv')} AS level_pos_hits, {bar('xd')} AS exclude_in_desc,
               CAST(len(it) AS INTEGER) AS n_title FROM scored""",
    "whole_word_excludes": f"""WITH {POSTINGS}
        SELECT key, {bar(whole_words('lower(title)', PROSE.exclude_keywords))} AS exclude_in_title
        FROM postings""",
    "hard_exclude_location_gate": f"""WITH {POSTINGS}, {scored_ctes(PROSE)}
        SELECT key, {bar('hx')} AS hard_exclude_hits, location_ok, l AS location_text FROM scored""",
    "score_and_pass": scores(PROSE),
    "score_and_pass_native": scores(PROSE),
    "score_robotics": scores(ROBOTICS),
    "breakdown_record": f"""WITH {POSTINGS}, {scored_ctes(ROBOTICS)}
        SELECT key, {bar('it')} AS include_in_title, {bar('idd')} AS include_in_desc,
               {bar('lv')} AS level_pos_hits, {bar('xt')} AS exclude_in_title,
               {bar('xd')} AS exclude_in_desc, {bar('hx')} AS hard_exclude_hits,
               location_ok, l AS location_text FROM scored""",
    "score_multi_profile": f"WITH {POSTINGS}, " + ", ".join(
        scored_ctes(p, p.profile_id) for p in (PROSE, POLITE, ROBOTICS)) + " UNION ALL ".join(
        f" SELECT key, '{p.profile_id}' AS profile_id, score, reject_reason IS NULL AS passes, "
        f"reject_reason FROM {p.profile_id}" for p in (PROSE, POLITE, ROBOTICS)),
    "new_postings": f"WITH {COPIES}, {KNOWN} SELECT key, doc_id FROM copies WHERE key NOT IN (SELECT key FROM known)",
    "new_postings_deduped": f"""WITH {COPIES}, {KNOWN} SELECT key, min(doc_id) AS doc_id FROM copies
        WHERE key NOT IN (SELECT key FROM known) GROUP BY key""",
    "seen_semi": f"WITH {COPIES}, {KNOWN} SELECT key, doc_id FROM copies WHERE key IN (SELECT key FROM known)",
    "seen_upsert": marked("location = 'en'"),
    "seed_state": marked("false"),
    "retain_newest": retained("ts"),
    "retain_newest_ties": retained("date_trunc('day', ts)::TIMESTAMP"),
    "first_per_source_id": """SELECT user_id, event_type, event_id FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
    "newest_n_per_company": """SELECT o_custkey, o_orderkey FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 5""",
    "newest_100_per_source": """SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_returnflag
          ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey) <= 100""",
    "contiguous_page_prefix": """SELECT company, run_id FROM (
          SELECT CAST(user_id AS VARCHAR) AS company, event_id AS run_id,
                 sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)
                   OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bad FROM events) WHERE bad = 0""",
    "failure_streak": f"WITH {STREAK} SELECT * FROM streak",
    "failure_upsert": f"WITH {STREAK} SELECT company, count, last_error, last_failed_at FROM streak WHERE count > 0",
    "success_reset": f"""WITH {STREAK} SELECT r.company, CAST(count(*) AS INTEGER) AS count
        FROM runs AS r JOIN streak AS s USING (company) WHERE NOT r.ok AND s.count > 0 GROUP BY r.company""",
    "auto_skip": f"""WITH {STREAK}, {CATALOGUE} SELECT name, coalesce(count, 0) AS failures,
        coalesce(count, 0) >= 2 AS skipped FROM catalogue LEFT JOIN streak ON company = name WHERE enabled""",
    "health_report": f"WITH {HEALTH} SELECT * FROM health",
    "health_sections": f"""WITH {HEALTH} SELECT status, count(*) AS companies,
        CAST(sum(tracked) AS BIGINT) AS tracked FROM health GROUP BY status""",
    "healthy_ranked": f"""WITH {HEALTH} SELECT row_number() OVER (ORDER BY tracked DESC, name) AS rank, name, tracked
        FROM health WHERE status = 'healthy'""",
    "health_totals": f"""WITH {CATALOGUE} SELECT count(*) AS companies, count(*) FILTER (WHERE enabled) AS enabled,
        count(*) FILTER (WHERE NOT enabled) AS disabled, (SELECT count(*) FROM events) AS seen FROM catalogue""",
    "seen_per_company": """SELECT event_type AS company, count(*) AS tracked FROM events
        WHERE value >= 10 OR value IS NULL GROUP BY event_type""",
    "run_summary": summary(),
    "run_errors": """SELECT event_id AS run_id, user_id || ' (error): ' || props AS error
        FROM events WHERE event_type = 'error'""",
    "verify_company": f"""WITH {VERIFY} SELECT passes, score, substr(title, 1, 55) AS title,
        substr(location, 1, 30) AS location, substr(url, 1, 50) AS url
        FROM mine ORDER BY passes DESC, doc_id LIMIT 10""",
    "verify_counts": f"WITH {VERIFY} SELECT passes, count(*) AS postings FROM mine GROUP BY passes",
    "rule_eval": f"""WITH v AS (
          SELECT toxic = 1 AS e, len({whole_words('lower(text)', TOXIC)}) > 0 AS p
          FROM documents JOIN labels USING (doc_id)),
        c AS (SELECT count(*) AS total, count(*) FILTER (WHERE e AND p) AS tp, count(*) FILTER (WHERE NOT e AND p) AS fp,
               count(*) FILTER (WHERE e AND NOT p) AS fn, count(*) FILTER (WHERE NOT e AND NOT p) AS tn FROM v)
        SELECT *, tp + tn AS correct, (tp + tn) / total AS accuracy, tp / nullif(tp + fp, 0) AS precision,
               tp / nullif(tp + fn, 0) AS recall FROM c""",
    "strip_html": f"""SELECT page_id, {squeezed(flat("regexp_replace(html, '<[^>]+>', ' ', 'g')"))} AS text FROM pages""",
    "strip_html_unescape_first": f"""SELECT page_id,
        {squeezed("regexp_replace(" + flat('html') + ", '<[^>]+>', ' ', 'g')")} AS text FROM pages""",
    "html_escape": f"WITH {POSTINGS} SELECT key, {escaped('title')} AS escaped FROM postings",
    "alert_text": alert(),
    "posted_timestamps": """SELECT event_id, CASE WHEN event_type IN ('click', 'view')
        THEN epoch_ms(date_trunc('second', ts)) END AS posted_ms FROM events""",
    **{f"normalize_{name}": expected_sql(name) for name in PAYLOADS},
    "union_sources": " UNION ALL ".join(expected_sql(name) for name in PAYLOADS),
    "dispatch_sources": " UNION ALL ".join(
        [f"""SELECT p_brand AS company, '{name}' AS fetcher, {ok} AS ok, {error} AS error,
             count(*) FILTER (WHERE p_size <= 48) AS n_postings FROM part GROUP BY p_brand"""
         for name in PAYLOADS
         for ok, error in [
             ("count(*) FILTER (WHERE p_size > 48) = 0",
              f"CASE WHEN count(*) FILTER (WHERE p_size > 48) > 0 THEN p_brand || ' ({name}): missing id' END")
             if name in ("greenhouse", "lever") else ("true", "NULL")]]
        + ["""SELECT DISTINCT p_brand, 'nobody', false,
              p_brand || ' (nobody): KeyError: No fetcher named ''nobody''', 0 FROM part"""]),
    "quarantine": " UNION ALL ".join(
        [f"SELECT '{name}' AS fetcher, 'missing id' AS problem, count(*) AS rows FROM part WHERE p_size > 48"
         for name in PAYLOADS]
        + ["SELECT 'nobody', 'KeyError: No fetcher named ''nobody''', count(*) FROM part"]),
    "enabled_companies": f"WITH {CATALOGUE} SELECT name FROM catalogue WHERE enabled",
    "paged_sources": PAGED_SQL,
    "missing_companies": f"""
        WITH landed AS (
          SELECT p_brand AS company, count(*) FILTER (WHERE p_size <= 48) AS n, count(*) FILTER (WHERE p_size > 48) AS bad
          FROM part GROUP BY p_brand),
        wanted AS (
          SELECT 'Brand#' || s_suppkey % 60 AS name, max(CASE WHEN s_suppkey % 3 > 0 THEN 'lever' END) AS fetcher
          FROM supplier GROUP BY 1)
        SELECT company, 'lever' AS fetcher, bad = 0 AS ok,
               CASE WHEN bad > 0 THEN company || ' (lever): missing id' END AS error, n AS n_postings FROM landed
        UNION ALL
        SELECT name, fetcher, false,
               CASE WHEN fetcher IS NULL THEN name || ': no fetcher specified'
                    ELSE name || ' (lever): nothing landed' END, 0
        FROM wanted WHERE name NOT IN (SELECT company FROM landed)""",
    "health_by_catalogue": f"""
        WITH {STREAK},
        entries AS (
          SELECT CASE WHEN c_custkey % 2 = 0 THEN 'team: ' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS name,
                 coalesce(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal > 0 END, true) AS enabled
          FROM customer),
        tracked AS (
          SELECT CASE WHEN user_id % 2 = 0 THEN 'team: ' || user_id ELSE CAST(user_id AS VARCHAR) END AS name,
                 count(*) AS n FROM events GROUP BY 1)
        SELECT c.name, coalesce(s.count, 0) AS failures, coalesce(t.n, 0) AS tracked,
               CASE WHEN s.count >= 2 THEN substr(coalesce(s.last_error, ''), 1, 100) END AS last_error,
               CASE WHEN coalesce(s.count, 0) >= 2 THEN 'auto_disabled'
                    WHEN coalesce(s.count, 0) > 0 THEN 'recently_failing' ELSE 'healthy' END AS status
        FROM entries AS c LEFT JOIN streak AS s ON s.company = c.name LEFT JOIN tracked AS t USING (name) WHERE c.enabled
        UNION ALL SELECT name, 0, 0, NULL, 'disabled' FROM entries WHERE NOT enabled""",
    "stream_alerts": f"""WITH {PASSED} SELECT DISTINCT location || ':' || md5(description) AS key,
        location AS company, score FROM passed""",
    "stream_streak": f"WITH {STREAK} SELECT company, count, last_error FROM streak WHERE count > 0",
    "stream_streak_keyed": f"WITH {STREAK} SELECT company, count, last_error FROM streak WHERE count > 0",
    "stream_first_keys": f"WITH {COPIES} SELECT DISTINCT key, company FROM copies",
    # Documents land in four equal ranges of their ids, each one batch.
    "stream_metrics": f"""WITH {POSTINGS}, {scored_ctes(PROSE)},
      ends AS (SELECT min(doc_id) AS lo, -(-(max(doc_id) - min(doc_id) + 1) // 4) AS w FROM documents),
      parts AS (SELECT (doc_id - lo) // greatest(w, 1) AS part, reject_reason IS NULL AS passes FROM scored, ends)
      SELECT row_number() OVER (ORDER BY part) - 1 AS batch_id, count(*) AS n_input, count(*) AS scored,
             count(*) FILTER (WHERE passes) AS matched FROM parts GROUP BY part""",
}
