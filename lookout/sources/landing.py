"""Landed payloads to postings, quarantine and run log.

Landed as ``fetcher=<name>/`` partitions, every payload is read once: the passes over
the sources prune to partitions that do not overlap.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, functions as F

from lookout.functions.text import bound, company_error, first_non_empty, with_stripped_html
from lookout.operators.joins import lookup
from lookout.operators.topk import first_per_key
from lookout.sources.payloads import SOURCES, Source, available

OK = "ok"
GROUP = ["fetcher", "run_ts", "catalog_name", "term_idx"]
# Problems of pages that are not read; a page beyond an agreed cap fails no run.
NO_NUMBER, BEYOND_CAP = "missing page number", "beyond the page cap"
CATALOGUE = ["host", "site", "public_url_base", "max_pages"]
POSTING = ["company", "job_id", "title", "location", "url", "description", "posted_at"]
PLACE = ["fetcher", "catalog_name", "run_ts", "term_idx", "page_no", "pos"]


def active(companies: DataFrame) -> DataFrame:
    """Catalogue entries that are not switched off; no flag means on."""
    return companies.filter(F.coalesce("enabled", F.lit(True)))


def _payload(source: Source) -> Column:
    schema = source.schema if source.is_array else source.schema + ", _corrupt_record STRING"
    return F.from_json("body", schema)


def _page_problem(source: Source, payload: Column) -> Column:
    bad = payload.isNull()
    if not source.is_array:
        bad = bad | payload["_corrupt_record"].isNotNull()
    return F.when(
        F.coalesce("status", F.lit("")) != OK,
        F.concat(F.lit("failed page: "), F.coalesce("status", F.lit("unknown"))),
    ).when(bad, "malformed body")


def _by_fetcher(sources: list[Source], value: Callable[[Source], Column]) -> Column:
    """One value per row, picked by the row's fetcher; the other branches do not run."""
    result = F.when(F.col("fetcher") == sources[0].name, value(sources[0]))
    for source in sources[1:]:
        result = result.when(F.col("fetcher") == source.name, value(source))
    return result


def _item(source: Source, j: Column) -> Column:
    values = source.fields(j, F.col)
    plain = F.coalesce(values.get("description"), F.lit("")) if "description" in values else F.lit("")
    # Markup is only read where there is no plain text.
    markup = F.when(plain == "", values.get("html", F.lit(None)).cast("string"))
    return F.struct(
        *[F.coalesce(values[f], F.lit("")).alias(f) for f in ("job_id", "title", "location", "url")],
        plain.alias("description"),
        markup.alias("_html"),
        values["posted_at"].alias("posted_at"),
    )


@cache
def _page(source: Source) -> Column:
    """The page's problem, or its items in canonical form, and whether paging stops here.

    All three come from one parse of the body.
    """
    def read(p: Column) -> Column:
        problem = _page_problem(source, p)
        items = F.transform(source.items(p), lambda j: _item(source, j))
        return F.struct(
            problem.alias("problem"), F.when(problem.isNull(), items).alias("items"),
            _is_stop(source, p).alias("stop"),
        )

    return bound(_payload(source), read)


def _is_stop(source: Source, p: Column) -> Column:
    """A failed, malformed, empty or last page of a paged source."""
    if not (source.paged or source.catalogue_cap):
        return F.lit(False)
    stop = _page_problem(source, p).isNotNull() | (F.coalesce(F.size(source.items(p)), F.lit(0)) <= 0)
    if source.total is not None:
        reached = (F.col("page_no") + 1) * source.page_size
        stop = stop | (reached >= F.coalesce(source.total(p), F.lit(0)))
    return stop


def _groups(settled: bool = False) -> list[list[Source]]:
    """Sources that can share one pass: those that use the catalogue, and the others.

    Where ids are settled in the same pass, those that need it go apart.
    """
    groups: dict[tuple[bool, bool], list[Source]] = {}
    for source in SOURCES.values():
        groups.setdefault((source.uses_catalogue, settled and source.dedupe), []).append(source)
    return list(groups.values())


def _pages(sources: list[Source], raw: DataFrame, companies: DataFrame | None) -> DataFrame:
    """Pages of the sources, with catalogue values where needed.

    ``_unread`` says why a page isn't read: it has no number, or lies beyond a cap that
    the source or the catalogue sets. Such pages stay, as problem rows.
    """
    pages = raw.filter(F.col("fetcher").isin([s.name for s in sources]))
    cap = _by_fetcher(sources, lambda s: F.lit(s.max_pages).cast("int"))
    if sources[0].uses_catalogue:
        if companies is None:
            raise ValueError(f"{sources[0].name} needs the company catalogue")
        # Drop any later entry of a name, which would repeat its pages.
        entries = first_per_key(companies, ["name"], [F.col("pos")])
        dim = entries.select(F.col("name").alias("company"), *CATALOGUE)
        capped = [s.name for s in sources if s.catalogue_cap]
        cap = F.coalesce(F.when(F.col("fetcher").isin(capped), F.col("max_pages")), cap)
        pages = lookup(pages, dim, ["company"], "left")
    return pages.withColumn(
        "_unread",
        F.when(F.col("page_no").isNull(), NO_NUMBER).when(F.col("page_no") >= cap, BEYOND_CAP),
    )


def prefix_stops(pages: DataFrame, group: list[str], order: Column, stop: Column) -> DataFrame:
    """Where the contiguous prefix of each group ends, for groups that go on after it.

    One small row per group, combined on the map side. A source that stops paging when
    it should leaves nothing here, so the join that follows has next to nothing to do.
    """
    return (
        pages.groupBy(*group)
        .agg(F.min(F.when(stop, order)).alias("_stop"), F.max(order).alias("_last"))
        .filter(F.col("_last") > F.col("_stop"))
        .drop("_last")
    )


def contiguous_prefix(pages: DataFrame, stops: DataFrame, group: list[str], order: Column) -> DataFrame:
    """Rows up to and including the stop of their group."""
    return (
        lookup(pages, stops, group, "left")
        .filter(F.col("_stop").isNull() | order.isNull() | (order <= F.col("_stop")))
        .drop("_stop")
    )


def stops(pages: DataFrame) -> DataFrame:
    """Where the pages of a group stop, from ``read_pages`` as written: its bodies are parsed.

    Only the columns of the place are read. A run writes this small table; read back, its
    size is known to the planner, which then broadcasts it when it is small.
    """
    paged = [s.name for s in SOURCES.values() if s.paged or s.catalogue_cap]
    read = F.col("problem").isNull() | ~F.col("problem").isin(NO_NUMBER, BEYOND_CAP)
    return prefix_stops(pages.filter(F.col("fetcher").isin(paged) & read), GROUP, F.col("page_no"), F.col("stop"))


def page_stops(raw: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """The same straight from payloads, for one more parse of the bodies."""
    return stops(read_pages(raw, companies))


def _parse(sources: list[Source], raw: DataFrame, companies: DataFrame | None) -> DataFrame:
    pages = _pages(sources, raw, companies)
    required = [s.name for s in sources if s.id_required]
    literal = _by_fetcher(sources, lambda s: F.lit(s.company).cast("string"))
    rows = (
        pages.withColumn("_page", F.when(F.col("_unread").isNull(), _by_fetcher(sources, _page)))
        .select(
            "fetcher", F.col("company").alias("catalog_name"), "run_ts", "term_idx", "page_no",
            F.coalesce(literal, "company").alias("company"),
            F.coalesce("_unread", "_page.problem").alias("_page_problem"),
            F.coalesce("_page.stop", F.lit(False)).alias("stop"),
            F.posexplode_outer("_page.items").alias("pos", "_item"),
        )
        .select("*", F.col("pos").isNotNull().alias("is_item"), "_item.*")
    )
    no_id = F.col("is_item") & (F.col("job_id") == "")
    rows = rows.withColumns({
        "pos": F.col("pos").cast("bigint"),
        "problem": F.coalesce("_page_problem", F.when(no_id, "missing id")),
        "fatal": (F.col("_page_problem").isNotNull() & (F.col("_page_problem") != BEYOND_CAP))
        | (no_id & F.col("fetcher").isin(required)),
    })
    if any(s.has_markup for s in sources):
        rows = with_stripped_html(rows, "_html", "_text").withColumn(
            "description", first_non_empty(F.col("description"), F.col("_text"))
        )
    return rows.select(*PLACE, "problem", "fatal", "is_item", *POSTING, "stop")


def parse_source(source: Source | str, raw: DataFrame, companies: DataFrame | None = None,
                 stops: DataFrame | None = None) -> DataFrame:
    """One row per landed item, and one per page that has none.

    ``problem`` is null for a good posting. ``fatal`` problems fail the company's run.
    """
    source = SOURCES[source] if isinstance(source, str) else source
    return settle(_parse([source], raw, companies), stops, [source])


def _first_of_each_id(rows: DataFrame) -> DataFrame:
    """Search terms overlap: keep the first posting of an id, and every problem row."""
    apart = F.when(F.col("problem").isNotNull() | ~F.col("is_item"),
                   F.concat_ws("/", "term_idx", "page_no", "pos"))
    return first_per_key(
        rows.withColumn("_apart", apart),
        ["run_ts", "catalog_name", "job_id", "_apart"],
        [F.col("term_idx"), F.col("page_no"), F.col("pos")],
    ).drop("_apart")


def _unknown(raw: DataFrame) -> DataFrame:
    """Error rows of payloads whose fetcher is missing or has no normaliser."""
    name = F.coalesce("fetcher", F.lit(""))
    problem = F.concat(F.lit("KeyError: No fetcher named '"), name, F.lit("'"))
    empty = F.lit(None).cast("string")
    return raw.filter(~name.isin(available())).select(
        "fetcher", F.col("company").alias("catalog_name"), "run_ts", "term_idx", "page_no",
        F.lit(None).cast("bigint").alias("pos"), problem.alias("problem"),
        F.lit(True).alias("fatal"), F.lit(False).alias("is_item"), "company",
        *[empty.alias(c) for c in POSTING[1:]], F.lit(False).alias("stop"),
    )


def read_pages(raw: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """Every payload row through the normaliser of its fetcher, before pages are cut.

    Sources that need no catalogue values share one pass, in which each row runs the
    branch of its own fetcher only; each body is parsed once.
    """
    parts = [_parse(sources, raw, companies) for sources in _groups()]
    return reduce(DataFrame.unionByName, parts, _unknown(raw))


def settle(pages: DataFrame, stops: DataFrame | None = None, sources: list[Source] | None = None) -> DataFrame:
    """Pages cut where their group stops, and each id once where search terms overlap."""
    if stops is not None:
        pages = contiguous_prefix(pages, stops, GROUP, F.col("page_no"))
    pages = pages.drop("stop")
    sources = list(SOURCES.values()) if sources is None else sources
    once = [s.name for s in sources if s.dedupe]
    if not once:
        return pages
    if len(once) == len(sources):
        return _first_of_each_id(pages).select(*pages.columns)
    mine = F.coalesce(F.col("fetcher").isin(once), F.lit(False))
    return pages.filter(~mine).unionByName(_first_of_each_id(pages.filter(mine)).select(*pages.columns))


def dispatch(raw: DataFrame, companies: DataFrame | None = None,
             stops: DataFrame | None = None) -> DataFrame:
    """``read_pages``, settled: one row per landed item, and one per page that has none."""
    parts = [settle(_parse(g, raw, companies), stops, g) for g in _groups(settled=True)]
    return reduce(DataFrame.unionByName, parts, _unknown(raw).drop("stop"))


def good_postings(parsed: DataFrame, strict: bool = False) -> DataFrame:
    """Postings without problems.

    With ``strict``, a company with a fatal problem contributes nothing in that run.
    """
    good = parsed.filter("is_item AND problem IS NULL")
    if strict:
        failed = parsed.filter("fatal").select("run_ts", "catalog_name").distinct()
        good = lookup(good, failed, ["run_ts", "catalog_name"], "left_anti")
    return good.select(*POSTING, "catalog_name", "run_ts", "term_idx", "page_no", "pos")


def normalize(source: Source | str, raw: DataFrame, companies: DataFrame | None = None,
              stops: DataFrame | None = None) -> DataFrame:
    """Canonical postings of one source."""
    return good_postings(parse_source(source, raw, companies, stops)).select(*POSTING)


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.filter("problem IS NOT NULL").select(*PLACE, "problem", "title", "url")


def run_log(parsed: DataFrame) -> DataFrame:
    """One row per company and run: outcome, first fatal error, number of postings.

    Only the counts run over all rows, as a hash aggregate; the first error, which needs
    sorted rows, is taken from the fatal ones alone.
    """
    group = ["run_ts", "catalog_name", "fetcher"]
    counts = parsed.groupBy(*group).agg(
        F.count_if(F.col("is_item") & F.col("problem").isNull()).alias("n_postings"),
        F.count_if("fatal").alias("_fatal"),
    )
    first = (
        parsed.filter("fatal").groupBy(*group)
        .agg(F.min(F.struct("term_idx", "page_no", "pos", "problem")).alias("_first"))
    )
    same = [counts[c].eqNullSafe(first[c]) for c in group]
    error = company_error(counts["catalog_name"], counts["fetcher"], first["_first.problem"])
    return counts.join(first, same, "left").select(
        counts["run_ts"], counts["catalog_name"].alias("company"), counts["fetcher"],
        (F.col("_fatal") == 0).alias("ok"),
        F.when(F.col("_fatal") > 0, error).alias("error"),
        "n_postings",
    )


def with_missing(log: DataFrame, wanted: DataFrame, run_ts: Column) -> DataFrame:
    """The run log with an error row for each wanted company of which nothing landed.

    ``wanted(name, fetcher)``: catalogue entries that the run should have read. An entry
    without a fetcher can't land anything and says so.
    """
    landed = log.select(F.col("company").alias("name")).distinct()
    silent = wanted.join(landed, "name", "left_anti")
    rows = silent.select(
        run_ts.alias("run_ts"), F.col("name").alias("company"), "fetcher", F.lit(False).alias("ok"),
        company_error(F.col("name"), F.col("fetcher"), F.lit("nothing landed")).alias("error"),
        F.lit(0).cast("bigint").alias("n_postings"),
    )
    return log.unionByName(rows)
