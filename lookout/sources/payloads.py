"""The fifteen payload shapes: schema, item array and field mapping of each source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from lookout.functions.text import first_non_empty, join_array, join_non_empty

Fields = dict[str, Column]


@dataclass(frozen=True)
class Source:
    """How one kind of landed payload becomes postings.

    ``fields`` gets the item and a catalogue accessor and names job_id, title,
    location, url, description, html and posted_at; what it leaves out is empty.
    """

    name: str
    schema: str
    items: Callable[[Column], Column]
    fields: Callable[[Column, Callable[[str], Column]], Fields]
    company: str | None = None          # literal company name, else the catalogue's
    id_required: bool = False
    max_pages: int | None = None        # cap on pages read; what lies beyond is reported
    paged: bool = False                 # a failed, empty or last page ends the pages
    has_markup: bool = True
    page_size: int | None = None
    total: Callable[[Column], Column] | None = None
    dedupe: bool = False
    uses_catalogue: bool = False
    catalogue_cap: bool = False         # the catalogue's max_pages replaces ours

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a source needs a name")

    @property
    def is_array(self) -> bool:
        return self.schema.startswith("ARRAY")


SOURCES: dict[str, Source] = {}


def register(source: Source) -> Source:
    """Add a source; a later one of the same name replaces the earlier."""
    SOURCES[source.name] = source
    return source


def available() -> list[str]:
    return sorted(SOURCES)


def _either(first: Column, second: Column) -> Column:
    return F.when(F.size(first) > 0, first).otherwise(second)


def _prefixed(prefix: str, value: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.coalesce(value, F.lit("")), F.lit(suffix))


# --- hosted boards ----------------------------------------------------------

register(Source(
    name="greenhouse",
    schema="jobs ARRAY<STRUCT<id: STRING, title: STRING, location: STRUCT<name: STRING>, "
           "absolute_url: STRING, content: STRING, updated_at: STRING>>",
    items=lambda p: p["jobs"],
    id_required=True,
    fields=lambda j, c: {
        "job_id": j["id"],
        "title": j["title"],
        "location": j["location"]["name"],
        "url": j["absolute_url"],
        "html": j["content"],
        "posted_at": j["updated_at"],
    },
))

register(Source(
    name="lever",
    schema="ARRAY<STRUCT<id: STRING, text: STRING, categories: STRUCT<location: STRING, "
           "allLocations: ARRAY<STRING>>, hostedUrl: STRING, descriptionPlain: STRING, "
           "description: STRING, createdAt: STRING>>",
    items=lambda p: p,
    id_required=True,
    fields=lambda j, c: {
        "job_id": j["id"],
        "title": j["text"],
        "location": first_non_empty(
            j["categories"]["location"], join_array(j["categories"]["allLocations"], 3)
        ),
        "url": j["hostedUrl"],
        "description": j["descriptionPlain"],
        "html": j["description"],
        "posted_at": first_non_empty(j["createdAt"]),
    },
))

register(Source(
    name="ashby",
    schema="jobs ARRAY<STRUCT<id: STRING, title: STRING, locationName: STRING, "
           "location: STRING, jobUrl: STRING, applyUrl: STRING, descriptionPlain: STRING, "
           "descriptionHtml: STRING, publishedAt: STRING>>",
    items=lambda p: p["jobs"],
    fields=lambda j, c: {
        "job_id": j["id"],
        "title": j["title"],
        "location": first_non_empty(j["locationName"], j["location"]),
        "url": first_non_empty(j["jobUrl"], j["applyUrl"]),
        "description": j["descriptionPlain"],
        "html": j["descriptionHtml"],
        "posted_at": first_non_empty(j["publishedAt"]),
    },
))

register(Source(
    name="workday",
    schema="total BIGINT, jobPostings ARRAY<STRUCT<bulletFields: ARRAY<STRING>, "
           "externalPath: STRING, title: STRING, locationsText: STRING, postedOn: STRING>>",
    items=lambda p: p["jobPostings"],
    paged=True,
    page_size=20,
    total=lambda p: p["total"],
    dedupe=True,
    uses_catalogue=True,
    catalogue_cap=True,
    fields=lambda j, c: {
        "job_id": first_non_empty(F.get(j["bulletFields"], F.lit(0)), j["externalPath"], j["title"]),
        "title": j["title"],
        "location": j["locationsText"],
        "url": F.concat(
            F.lit("https://"), c("host"), F.lit("/en-US/"), c("site"),
            first_non_empty(j["externalPath"]),
        ),
        "posted_at": first_non_empty(j["postedOn"]),
    },
))

register(Source(
    name="smartrecruiters",
    schema="totalFound BIGINT, content ARRAY<STRUCT<id: STRING, name: STRING, "
           "location: STRUCT<city: STRING, region: STRING, country: STRING>, ref: STRING, "
           "postingUrl: STRING, releasedDate: STRING>>",
    items=lambda p: p["content"],
    paged=True,
    page_size=100,
    total=lambda p: p["totalFound"],
    fields=lambda j, c: {
        "job_id": j["id"],
        "title": j["name"],
        "location": join_non_empty(
            j["location"]["city"], j["location"]["region"], j["location"]["country"]
        ),
        "url": first_non_empty(j["ref"], j["postingUrl"]),
        "posted_at": first_non_empty(j["releasedDate"]),
    },
))


def _oracle_url(job_id: Column, c: Callable[[str], Column]) -> Column:
    base = F.coalesce(c("public_url_base"), F.concat(F.lit("https://"), c("host"), F.lit("/?lang=en")))
    mark = F.when(F.contains(base, F.lit("?")), "&job=").otherwise("?job=")
    return F.concat(base, mark, job_id)


register(Source(
    name="oracle_cloud",
    schema="items ARRAY<STRUCT<TotalJobsCount: BIGINT, requisitionList: ARRAY<STRUCT<"
           "Id: STRING, RequisitionId: STRING, Title: STRING, PrimaryLocation: STRING, "
           "PostedDate: STRING>>>>",
    items=lambda p: F.get(p["items"], F.lit(0))["requisitionList"],
    paged=True,
    page_size=25,
    total=lambda p: F.get(p["items"], F.lit(0))["TotalJobsCount"],
    uses_catalogue=True,
    fields=lambda j, c: {
        "job_id": first_non_empty(j["Id"], j["RequisitionId"]),
        "title": j["Title"],
        "location": j["PrimaryLocation"],
        "url": _oracle_url(first_non_empty(j["Id"], j["RequisitionId"]), c),
        "posted_at": first_non_empty(j["PostedDate"]),
    },
))

# --- single companies ---------------------------------------------------------

register(Source(
    name="amazon",
    company="Amazon",
    schema="jobs ARRAY<STRUCT<id_icims: STRING, id: STRING, title: STRING, "
           "normalized_location: STRING, location: STRING, job_path: STRING, "
           "description_short: STRING, description: STRING, posted_date: STRING>>",
    items=lambda p: p["jobs"],
    fields=lambda j, c: {
        "job_id": first_non_empty(j["id_icims"], j["id"]),
        "title": j["title"],
        "location": first_non_empty(j["normalized_location"], j["location"]),
        "url": _prefixed("https://www.amazon.jobs", j["job_path"]),
        "description": first_non_empty(j["description_short"], j["description"]),
        "posted_at": first_non_empty(j["posted_date"]),
    },
))

_GOOGLE = ("ARRAY<STRUCT<id: STRING, job_id: STRING, title: STRING, "
           "locations: ARRAY<STRUCT<display: STRING>>, description: STRING, "
           "summary: STRING, publish_date: STRING, created: STRING>>")
register(Source(
    name="google",
    company="Google",
    schema=f"jobs {_GOOGLE}, results {_GOOGLE}",
    items=lambda p: _either(p["jobs"], p["results"]),
    paged=True,
    fields=lambda j, c: {
        "job_id": first_non_empty(j["id"], j["job_id"]),
        "title": j["title"],
        "location": F.get(j["locations"], F.lit(0))["display"],
        "url": _prefixed("https://careers.google.com/jobs/results/",
                         first_non_empty(j["id"], j["job_id"]), "/"),
        "description": first_non_empty(j["description"], j["summary"]),
        "posted_at": first_non_empty(j["publish_date"], j["created"]),
    },
))

register(Source(
    name="microsoft",
    company="Microsoft",
    schema="operationResult STRUCT<result: STRUCT<jobs: ARRAY<STRUCT<jobId: STRING, "
           "title: STRING, primaryLocation: STRING, postingDate: STRING, "
           "properties: STRUCT<locations: ARRAY<STRING>, description: STRING>>>>>",
    items=lambda p: p["operationResult"]["result"]["jobs"],
    paged=True,
    fields=lambda j, c: {
        "job_id": j["jobId"],
        "title": j["title"],
        "location": F.when(
            F.size(j["properties"]["locations"]) > 0, join_array(j["properties"]["locations"])
        ).otherwise(j["primaryLocation"]),
        "url": _prefixed("https://jobs.careers.microsoft.com/global/en/job/", j["jobId"]),
        "description": j["properties"]["description"],
        "posted_at": first_non_empty(j["postingDate"]),
    },
))

# Locations stay text at first: anything but an array of objects counts as none.
_APPLE = ("ARRAY<STRUCT<positionId: STRING, id: STRING, postingTitle: STRING, "
          "title: STRING, locations: STRING, jobSummary: STRING, postingDate: STRING, "
          "postDateInGMT: STRING>>")
register(Source(
    name="apple",
    company="Apple",
    schema=f"searchResults {_APPLE}, res STRUCT<searchResults: {_APPLE}>",
    items=lambda p: _either(p["searchResults"], p["res"]["searchResults"]),
    paged=True,
    fields=lambda j, c: {
        "job_id": first_non_empty(j["positionId"], j["id"]),
        "title": first_non_empty(j["postingTitle"], j["title"]),
        "location": join_array(F.transform(
            F.from_json(j["locations"], "ARRAY<STRUCT<name: STRING>>"),
            lambda l: F.coalesce(l["name"], F.lit("")),
        )),
        "url": _prefixed("https://jobs.apple.com/en-us/details/",
                         first_non_empty(j["positionId"], j["id"])),
        "description": j["jobSummary"],
        "posted_at": first_non_empty(j["postingDate"], j["postDateInGMT"]),
    },
))

register(Source(
    name="meta",
    company="Meta",
    schema="data STRUCT<job_search: ARRAY<STRUCT<id: STRING, title: STRING, "
           "locations: ARRAY<STRING>>>>",
    items=lambda p: p["data"]["job_search"],
    fields=lambda j, c: {
        "job_id": j["id"],
        "title": j["title"],
        "location": join_array(j["locations"]),
        "url": _prefixed("https://www.metacareers.com/jobs/", j["id"], "/"),
        "posted_at": F.lit(""),
    },
))

register(Source(
    name="ibm",
    company="IBM",
    schema="hits STRUCT<hits: ARRAY<STRUCT<_id: STRING, _source: STRUCT<id: STRING, "
           "title: STRING, location: STRING, city: STRING, apply_url: STRING, "
           "description: STRING, open_date: STRING>>>>",
    items=lambda p: p["hits"]["hits"],
    paged=True,
    fields=lambda j, c: {
        "job_id": first_non_empty(j["_source"]["id"], j["_id"]),
        "title": j["_source"]["title"],
        "location": first_non_empty(j["_source"]["location"], j["_source"]["city"]),
        "url": first_non_empty(
            j["_source"]["apply_url"],
            _prefixed("https://www.ibm.com/careers/job/",
                      first_non_empty(j["_source"]["id"], j["_id"])),
        ),
        "description": j["_source"]["description"],
        "posted_at": first_non_empty(j["_source"]["open_date"]),
    },
))

_BLOOMBERG = ("ARRAY<STRUCT<id: STRING, requisitionId: STRING, title: STRING, "
              "location: STRING, locations: ARRAY<STRING>, url: STRING, "
              "description: STRING, postedDate: STRING>>")
register(Source(
    name="bloomberg",
    company="Bloomberg",
    schema=f"jobs {_BLOOMBERG}, results {_BLOOMBERG}",
    items=lambda p: _either(p["jobs"], p["results"]),
    fields=lambda j, c: {
        "job_id": first_non_empty(j["id"], j["requisitionId"]),
        "title": j["title"],
        "location": first_non_empty(j["location"], join_array(j["locations"])),
        "url": first_non_empty(
            j["url"],
            _prefixed("https://careers.bloomberg.com/job/detail/",
                      first_non_empty(j["id"], j["requisitionId"])),
        ),
        "description": j["description"],
        "posted_at": first_non_empty(j["postedDate"]),
    },
))

register(Source(
    name="deloitte",
    company="Deloitte",
    schema="jobs ARRAY<STRUCT<jobId: STRING, id: STRING, title: STRING, location: STRING, "
           "city: STRING, description: STRING, postedDate: STRING>>",
    items=lambda p: p["jobs"],
    fields=lambda j, c: {
        "job_id": first_non_empty(j["jobId"], j["id"]),
        "title": j["title"],
        "location": first_non_empty(j["location"], j["city"]),
        "url": _prefixed("https://apply.deloitte.com/en_US/careers/JobDetail/",
                         first_non_empty(j["jobId"], j["id"])),
        "description": j["description"],
        "posted_at": first_non_empty(j["postedDate"]),
    },
))

_ACCENTURE = ("ARRAY<STRUCT<jobId: STRING, id: STRING, title: STRING, jobTitle: STRING, "
              "jobLocation: STRING, city: STRING, jobDetailUrl: STRING, "
              "description: STRING, postedDate: STRING>>")
register(Source(
    name="accenture",
    company="Accenture",
    schema=f"data {_ACCENTURE}, jobs {_ACCENTURE}",
    items=lambda p: _either(p["data"], p["jobs"]),
    fields=lambda j, c: {
        "job_id": first_non_empty(j["jobId"], j["id"]),
        "title": first_non_empty(j["title"], j["jobTitle"]),
        "location": first_non_empty(j["jobLocation"], j["city"]),
        "url": first_non_empty(
            j["jobDetailUrl"],
            _prefixed("https://www.accenture.com/us-en/careers/jobdetails?id=",
                      first_non_empty(j["jobId"], j["id"])),
        ),
        "description": j["description"],
        "posted_at": first_non_empty(j["postedDate"]),
    },
))
