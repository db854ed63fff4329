import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lookout.schemas import COMPANIES, PAGES, RAW
from lookout.sources import landing
from lookout.sources.payloads import SOURCES, Source, available, register

TS = datetime(2026, 1, 1, tzinfo=timezone.utc)
HTML = "<p>Build &amp; test&nbsp;<b>arms</b> &eacute;t&eacute</p>"

# Source name -> (payload, expected postings without the company).
CASES = {
    "greenhouse": (
        {"jobs": [
            {"id": 7, "title": "A", "location": {"name": "Austin, TX"}, "absolute_url": "u",
             "content": HTML, "updated_at": "2026-01-01"},
            {"id": "x", "title": None, "location": None},
        ]},
        [("7", "A", "Austin, TX", "u", "Build & test arms été", "2026-01-01"),
         ("x", "", "", "", "", None)],
    ),
    "lever": (
        [{"id": "a", "text": "T", "categories": {"location": "", "allLocations": ["P", "Q", "R", "S"]},
          "hostedUrl": "u", "descriptionPlain": "", "description": "<i>d</i>", "createdAt": 1700000000000},
         {"id": "b", "text": "T", "categories": {"location": "L", "allLocations": ["P"]},
          "descriptionPlain": "plain", "description": "<i>d</i>"}],
        [("a", "T", "P, Q, R", "u", "d", "1700000000000"), ("b", "T", "L", "", "plain", "")],
    ),
    "ashby": (
        {"jobs": [{"id": "a", "title": "T", "locationName": "", "location": "L", "applyUrl": "v",
                   "descriptionHtml": "<p>x</p>", "publishedAt": "p"},
                  {"id": "b", "title": "T", "locationName": "M", "location": "L", "jobUrl": "j",
                   "applyUrl": "v", "descriptionPlain": "d"}]},
        [("a", "T", "L", "v", "x", "p"), ("b", "T", "M", "j", "d", "")],
    ),
    "workday": (
        {"total": 3, "jobPostings": [
            {"bulletFields": ["R1", "z"], "externalPath": "/job/1", "title": "T",
             "locationsText": "L", "postedOn": "Posted Today"},
            {"bulletFields": [], "externalPath": "/job/2", "title": "T"},
            {"title": "Only"},
            {"bulletFields": ["R1"], "externalPath": "/job/9", "title": "Again"}]},
        [("R1", "T", "L", "https://h.example/en-US/Site/job/1", "", "Posted Today"),
         ("/job/2", "T", "", "https://h.example/en-US/Site/job/2", "", ""),
         ("Only", "Only", "", "https://h.example/en-US/Site", "", "")],
    ),
    "smartrecruiters": (
        {"totalFound": 2, "content": [
            {"id": 5, "name": "N", "location": {"city": "C", "region": "", "country": "us"}, "ref": "r"},
            {"id": "6", "name": "N", "location": None, "postingUrl": "p", "releasedDate": "d"}]},
        [("5", "N", "C, us", "r", "", ""), ("6", "N", "", "p", "", "d")],
    ),
    "oracle_cloud": (
        {"items": [{"TotalJobsCount": 2, "requisitionList": [
            {"Id": 11, "Title": "T", "PrimaryLocation": "L", "PostedDate": "d"},
            {"RequisitionId": "12", "Title": "T"}]}]},
        [("11", "T", "L", "https://h.example/?lang=en&job=11", "", "d"),
         ("12", "T", "", "https://h.example/?lang=en&job=12", "", "")],
    ),
    "amazon": (
        {"jobs": [{"id_icims": 1, "id": "z", "title": "T", "normalized_location": "N", "location": "L",
                   "job_path": "/p", "description_short": "s", "description": "d", "posted_date": "x"},
                  {"id": "2", "title": "T", "location": "L", "description": "d"}]},
        [("1", "T", "N", "https://www.amazon.jobs/p", "s", "x"),
         ("2", "T", "L", "https://www.amazon.jobs", "d", "")],
    ),
    "google": (
        {"jobs": [], "results": [
            {"job_id": "1", "title": "T", "locations": [{"display": "L"}, {"display": "M"}],
             "summary": "s", "created": "c"},
            {"id": "2", "title": "T", "locations": [], "description": "d", "publish_date": "p"}]},
        [("1", "T", "L", "https://careers.google.com/jobs/results/1/", "s", "c"),
         ("2", "T", "", "https://careers.google.com/jobs/results/2/", "d", "p")],
    ),
    "microsoft": (
        {"operationResult": {"result": {"jobs": [
            {"jobId": 1, "title": "T", "primaryLocation": "P", "postingDate": "d",
             "properties": {"locations": ["A", "B"], "description": "x"}},
            {"jobId": 2, "title": "T", "primaryLocation": "P"}]}}},
        [("1", "T", "A, B", "https://jobs.careers.microsoft.com/global/en/job/1", "x", "d"),
         ("2", "T", "P", "https://jobs.careers.microsoft.com/global/en/job/2", "", "")],
    ),
    "apple": (
        {"res": {"searchResults": [
            {"positionId": "1", "postingTitle": "T", "locations": [{"name": "A"}, {}, {"name": "B"}],
             "jobSummary": "s", "postingDate": "d"},
            {"id": "2", "title": "T", "locations": "somewhere", "postDateInGMT": "g"}]}},
        [("1", "T", "A, , B", "https://jobs.apple.com/en-us/details/1", "s", "d"),
         ("2", "T", "", "https://jobs.apple.com/en-us/details/2", "", "g")],
    ),
    "meta": (
        {"data": {"job_search": [{"id": "1", "title": "T", "locations": ["A", "B"]}]}},
        [("1", "T", "A, B", "https://www.metacareers.com/jobs/1/", "", "")],
    ),
    "ibm": (
        {"hits": {"hits": [
            {"_id": "z", "_source": {"id": 1, "title": "T", "location": "L", "city": "C",
                                     "apply_url": "u", "description": "d", "open_date": "o"}},
            {"_id": "2", "_source": {"title": "T", "city": "C"}}]}},
        [("1", "T", "L", "u", "d", "o"), ("2", "T", "C", "https://www.ibm.com/careers/job/2", "", "")],
    ),
    "bloomberg": (
        {"jobs": [{"id": "1", "title": "T", "location": "L", "url": "u", "description": "d",
                   "postedDate": "p"},
                  {"requisitionId": "2", "title": "T", "locations": ["A", "B"]}]},
        [("1", "T", "L", "u", "d", "p"),
         ("2", "T", "A, B", "https://careers.bloomberg.com/job/detail/2", "", "")],
    ),
    "deloitte": (
        {"jobs": [{"jobId": "1", "title": "T", "location": "L", "description": "d", "postedDate": "p"},
                  {"id": "2", "title": "T", "city": "C"}]},
        [("1", "T", "L", "https://apply.deloitte.com/en_US/careers/JobDetail/1", "d", "p"),
         ("2", "T", "C", "https://apply.deloitte.com/en_US/careers/JobDetail/2", "", "")],
    ),
    "accenture": (
        {"data": [], "jobs": [
            {"jobId": "1", "title": "T", "jobLocation": "L", "jobDetailUrl": "u", "description": "d",
             "postedDate": "p"},
            {"id": "2", "jobTitle": "J", "city": "C"}]},
        [("1", "T", "L", "u", "d", "p"),
         ("2", "J", "C", "https://www.accenture.com/us-en/careers/jobdetails?id=2", "", "")],
    ),
}
EMPTY = {"lever": [], "oracle_cloud": {"items": []}}


def raw(spark, rows):
    """Rows of (fetcher, company, term, page, status, body)."""
    full = [(f, c, t, p, TS, s, b if b is None or isinstance(b, str) else json.dumps(b))
            for f, c, t, p, s, b in rows]
    return spark.createDataFrame(full, RAW)


@pytest.fixture(scope="module")
def companies(spark):
    row = lambda pos, name, **kw: tuple(
        {"pos": pos, "name": name, **kw}.get(f.split()[0]) for f in COMPANIES.split(", "))
    return spark.createDataFrame([
        row(0, "workday", host="h.example", site="Site"),
        row(1, "oracle_cloud", host="h.example"),
        row(2, "based", host="h", public_url_base="https://b.example/x"),
        row(3, "two pages", host="h", site="S", max_pages=2),
        row(4, "two pages", host="other", site="S", max_pages=9),
        row(5, "off", enabled=False), row(6, "on", enabled=True),
    ], COMPANIES)


def test_every_source_has_a_case():
    assert sorted(CASES) == available()


def test_all_sources_map_to_postings(spark, companies):
    rows = [(n, n, 0, 0, "ok", body) for n, (body, _) in CASES.items()]
    parsed = landing.dispatch(raw(spark, rows), companies)
    assert parsed.filter("problem IS NOT NULL").count() == 0
    out = {}
    for r in landing.good_postings(parsed).collect():
        assert r.company == (SOURCES[r.catalog_name].company or r.catalog_name)
        out.setdefault(r.catalog_name, []).append(
            (r.job_id, r.title, r.location, r.url, r.description, r.posted_at))
    assert {n: sorted(v) for n, v in out.items()} == {
        n: sorted(want) for n, (_, want) in CASES.items()}
    log = {r.company: r for r in landing.run_log(parsed).collect()}
    assert all(log[n].ok and log[n].n_postings == len(want) for n, (_, want) in CASES.items())


def test_bad_pages_are_quarantined_per_source(spark, companies):
    rows = []
    for n, (body, _) in CASES.items():
        rows += [(n, "cut", 0, 0, "ok", json.dumps(body)[:-9]), (n, "down", 0, 0, "HTTPError: 500", None),
                 (n, "none", 0, 0, "ok", None), (n, "empty", 0, 0, "ok", EMPTY.get(n, {}))]
    parsed = landing.dispatch(raw(spark, rows), companies)
    assert landing.good_postings(parsed).count() == 0
    log = {(r.fetcher, r.company): (r.ok, r.error) for r in landing.run_log(parsed).collect()}
    for n in CASES:
        assert log[n, "cut"] == (False, f"cut ({n}): malformed body")
        assert log[n, "down"] == (False, f"down ({n}): failed page: HTTPError: 500")
        assert log[n, "none"][0] is False
        assert log[n, "empty"] == (True, None)
    assert landing.quarantine(parsed).count() == 3 * len(CASES)


def test_missing_ids(spark):
    gh = {"jobs": [{"id": 1, "title": "A"}, {"title": "B"}, {"id": None, "title": "C"}]}
    ash = {"jobs": [{"id": "1"}, {"title": "B"}]}
    parsed = landing.dispatch(
        raw(spark, [("greenhouse", "g", 0, 0, "ok", gh), ("ashby", "a", 0, 0, "ok", ash)]),
        spark.createDataFrame([], COMPANIES))
    log = {r.company: (r.ok, r.n_postings) for r in landing.run_log(parsed).collect()}
    assert log == {"g": (False, 1), "a": (True, 1)}
    assert sorted(r.title for r in landing.quarantine(parsed).collect()) == ["B", "B", "C"]
    strict = landing.good_postings(parsed, strict=True).collect()
    assert [r.company for r in strict] == ["a"]


def test_unknown_fetcher_is_an_error_row(spark, companies):
    parsed = landing.dispatch(
        raw(spark, [("nope", "x", 0, 0, "ok", "{}"), (None, "y", 0, 0, "ok", "{}")]), companies)
    log = {r.company: r.error for r in landing.run_log(parsed).collect()}
    assert log == {"x": "x (nope): KeyError: No fetcher named 'nope'", "y": "y: no fetcher specified"}


def wd(total, *ids):
    return {"total": total, "jobPostings": [{"bulletFields": [i], "title": i} for i in ids]}


def test_page_prefix_cap_and_term_dedup(spark, companies):
    rows = [
        ("workday", "total", 0, 0, "ok", wd(40, "a")), ("workday", "total", 0, 1, "ok", wd(40, "b")),
        ("workday", "total", 0, 2, "ok", wd(40, "past the total")),
        ("workday", "fail", 0, 0, "ok", wd(99, "a")), ("workday", "fail", 0, 1, "timeout", None),
        ("workday", "fail", 0, 2, "ok", wd(99, "after the failure")),
        ("workday", "hole", 0, 0, "ok", wd(99, "a")), ("workday", "hole", 0, 1, "ok", wd(99)),
        ("workday", "hole", 0, 2, "ok", wd(99, "after the empty page")),
        ("workday", "no total", 0, 0, "ok", {"jobPostings": [{"title": "a"}]}),
        ("workday", "no total", 0, 1, "ok", wd(99, "after no total")),
        ("workday", "terms", 0, 0, "ok", wd(40, "a", "b", "a")), ("workday", "terms", 1, 0, "ok", wd(40, "b", "c")),
        ("workday", "terms", 0, 1, "ok", wd(40, "d", "b")),
    ] + [("workday", "capped", 0, p, "ok", wd(999, f"p{p}")) for p in range(7)]
    rows += [("workday", "two pages", 0, p, "ok", wd(999, f"p{p}")) for p in range(4)]
    rows += [("google", "G", 0, p, "ok", {"jobs": [{"id": p}]}) for p in range(6)]
    rows += [("amazon", "A", 0, p, "ok", {"jobs": [{"id": p}]}) for p in range(3)]
    data = raw(spark, rows)
    stops = landing.page_stops(data, companies)
    parsed = landing.dispatch(data, companies, stops)
    out = {}
    for r in landing.good_postings(parsed).collect():
        out.setdefault(r.catalog_name, []).append((r.term_idx, r.page_no, r.pos, r.job_id))
    ids = {n: [x[-1] for x in sorted(v)] for n, v in out.items()}
    assert ids == {
        "total": ["a", "b"], "fail": ["a"], "hole": ["a"], "no total": ["a"],
        "terms": ["a", "b", "d", "c"], "capped": [f"p{p}" for p in range(7)],
        "two pages": ["p0", "p1"], "G": ["0", "1", "2", "3", "4", "5"], "A": ["0", "1", "2"],
    }
    # A cap is the catalogue's, and what lies beyond it is reported.
    beyond = [(r.catalog_name, r.page_no) for r in landing.quarantine(parsed).collect() if r.problem == landing.BEYOND_CAP]
    assert sorted(beyond) == [("two pages", 2), ("two pages", 3)]
    assert {r.company for r in landing.run_log(parsed).collect() if not r.ok} == {"fail"}
    log = {r.company: r.ok for r in landing.run_log(parsed).collect()}
    assert [n for n, ok in log.items() if not ok] == ["fail"]


def test_public_url_base(spark, companies):
    body = CASES["oracle_cloud"][0]
    out = landing.normalize("oracle_cloud", raw(spark, [("oracle_cloud", "based", 0, 0, "ok", body)]), companies)
    assert {r.url for r in out.collect()} == {"https://b.example/x?job=11", "https://b.example/x?job=12"}


def test_active_defaults_to_on(spark, companies):
    names = {r.name for r in landing.active(companies).collect()}
    assert "off" not in names and {"on", "workday"} <= names


def test_registry(spark, companies):
    with pytest.raises(ValueError):
        Source(name="", schema="a STRING", items=None, fields=None)
    try:
        mine = register(Source(
            name="mine", schema="rows ARRAY<STRUCT<k: STRING>>", items=lambda p: p["rows"],
            fields=lambda j, c: {"job_id": j["k"], "title": j["k"], "location": F.lit(None),
                                 "url": F.lit(None), "posted_at": F.lit(None)}))
        assert "mine" in available() and SOURCES["mine"] is mine
        out = landing.normalize("mine", raw(spark, [("mine", "m", 0, 0, "ok", {"rows": [{"k": 3}]})]))
        assert [tuple(r) for r in out.collect()] == [("m", "3", "3", "", "", "", None)]
    finally:
        del SOURCES["mine"]


def test_body_is_parsed_once(spark, companies):
    df = landing.dispatch(raw(spark, [("greenhouse", "g", 0, 0, "ok", CASES["greenhouse"][0])]), companies)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # One per source, and one for the text field that holds an array.
    assert plan.count("from_json(StructField") + plan.count("from_json(ArrayType") == len(CASES) + 1, plan


def test_a_run_parses_each_body_once(spark, companies, tmp_path):
    """The stops and the settled pages come from the written pages, without a further parse."""
    rows = [("workday", "w", 0, p, "ok", wd(999, f"p{p}")) for p in range(3)] + [("google", "G", 0, 0, "timeout", None)]
    pages = landing.read_pages(raw(spark, rows), companies)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(pages).count("from_json(StructField") + plan(pages).count("from_json(ArrayType") == len(CASES) + 1
    pages.write.parquet(str(tmp_path / "pages"))
    written = spark.read.schema(PAGES).parquet(str(tmp_path / "pages"))
    stops = landing.stops(written)
    parsed = landing.settle(written, stops)
    for df in (stops, landing.quarantine(parsed), landing.run_log(parsed), landing.good_postings(parsed)):
        assert "from_json" not in plan(df)
    assert "description" not in plan(stops).split("Relation")[0]
    assert landing.good_postings(parsed).count() == 3


def test_literal_companies_stop_by_their_entry(spark, companies):
    """Two entries of a source with a literal company name have pages of their own."""
    rows = [("google", "one", 0, 0, "timeout", None), ("google", "one", 0, 1, "ok", {"jobs": [{"id": 1}]}),
            ("google", "two", 0, 0, "ok", {"jobs": [{"id": 2}]}), ("google", "two", 0, 1, "ok", {"jobs": [{"id": 3}]})]
    data = raw(spark, rows)
    parsed = landing.dispatch(data, companies, landing.page_stops(data, companies))
    assert sorted(r.job_id for r in landing.good_postings(parsed).collect()) == ["2", "3"]


def test_entries_of_which_nothing_landed(spark, companies):
    log = landing.run_log(landing.dispatch(raw(spark, [("greenhouse", "g", 0, 0, "ok", {"jobs": []})]), companies))
    wanted = spark.createDataFrame([("g", "greenhouse"), ("a", "lever"), ("b", None), ("c", "")], "name STRING, fetcher STRING")
    got = {r.company: (r.ok, r.error) for r in landing.with_missing(log, wanted, F.lit(TS)).collect()}
    assert got == {"g": (True, None), "a": (False, "a (lever): nothing landed"),
                   "b": (False, "b: no fetcher specified"), "c": (False, "c: no fetcher specified")}
