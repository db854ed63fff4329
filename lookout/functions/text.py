"""Text functions as Column expressions."""

from __future__ import annotations

import html
from collections.abc import Callable
from string import Formatter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

TAG = r"<[^>]+>"
# Unicode white space plus the four ASCII separator controls.
SPACES = r"(?U)[\s\x1c-\x1f]+"

# Entities resolved without leaving the JVM. The ampersand comes
# last, so that text it uncovers is not resolved a second time.
COMMON_ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
)
# An ampersand that starts anything other than a common entity or plain text.
OTHER_ENTITY = (
    "&(?!"
    + "|".join(name[1:] for name, _ in COMMON_ENTITIES)
    + r"|[\t\n\f <&;]|$)"
)

# Layout of one alert and of the run summary.
ALERT = """🚨 <b>{title}</b>
🏢 {company}
📍 {location}
⭐ score: {score}
🔗 <a href="{url}">Apply</a>"""
NO_LOCATION = "—"
SUMMARY = """📊 Run summary
Fetched: {fetched}
New: {new}
Alerted: {alerted}

⚠️ Errors:
{errors}"""
ERROR_BULLET = "• "


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """Compute a costly value once and use it several times in one expression.

    The optimizer copies a projected column into every use of it when it moves a
    filter; it does not copy into or out of the function of a one-element array.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lowered(value: Column | str) -> Column:
    """Null-safe lower case."""
    return F.lower(F.coalesce(as_column(value), F.lit("")))


def first_non_empty(*values: Column) -> Column:
    """First value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def join_non_empty(*values: Column) -> Column:
    """Join the non-empty values with a comma and a space."""
    return F.concat_ws(", ", *[F.nullif(v, F.lit("")) for v in values])


def join_array(values: Column, first: int | None = None) -> Column:
    """Join an array of strings; a null array gives the empty string."""
    kept = F.slice(values, 1, first) if first else values
    return F.coalesce(F.array_join(kept, ", "), F.lit(""))


def dedup_key(company: Column | str = "company", job_id: Column | str = "job_id") -> Column:
    return F.concat(
        F.coalesce(as_column(company), F.lit("")),
        F.lit(":"),
        F.coalesce(as_column(job_id), F.lit("")),
    )


def key_company(key: Column | str = "key") -> Column:
    """The part of a key before its first colon."""
    return F.substring_index(as_column(key), ":", 1)


def truncate(value: Column | str, length: int) -> Column:
    return F.substring(as_column(value), 1, length)


def escape_html(value: Column | str) -> Column:
    text = F.coalesce(as_column(value), F.lit(""))
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def filled(template: str, **values: Column) -> Column:
    """The template with a column in each of its named places."""
    pieces = []
    for plain, name, _, _ in Formatter().parse(template):
        pieces += [F.lit(plain)] + ([values[name]] if name else [])
    return F.concat(*pieces)


def alert_text(
    title: Column | str = "title",
    company: Column | str = "company",
    location: Column | str = "location",
    score: Column | str = "score",
    url: Column | str = "url",
) -> Column:
    return filled(
        ALERT,
        title=escape_html(title),
        company=escape_html(company),
        location=F.coalesce(F.nullif(escape_html(location), F.lit("")), F.lit(NO_LOCATION)),
        score=as_column(score).cast("string"),
        url=escape_html(url),
    )


def summary_text(fetched: Column, new: Column, alerted: Column, errors: Column) -> Column:
    """Run summary with the given error texts; null when there is no error."""
    bullets = F.transform(errors, lambda e: F.concat(F.lit(ERROR_BULLET), escape_html(e)))
    counts = {"fetched": fetched, "new": new, "alerted": alerted}
    text = filled(
        SUMMARY, errors=F.array_join(bullets, "\n"), **{k: v.cast("string") for k, v in counts.items()}
    )
    return F.when(F.size(errors) > 0, text)


def company_error(name: Column, fetcher: Column, problem: Column) -> Column:
    missing = F.concat(name, F.lit(": no fetcher specified"))
    full = F.concat(name, F.lit(" ("), fetcher, F.lit("): "), problem)
    return F.when(F.coalesce(fetcher, F.lit("")) == "", missing).otherwise(full)


def posted_ts(posted_at: Column | str = "posted_at") -> Column:
    """Timestamp of an ISO text or of epoch milliseconds; null for any other text."""
    text = as_column(posted_at)
    return F.coalesce(
        F.timestamp_millis(text.try_cast("bigint")),
        F.try_to_timestamp(text),
    )


@F.arrow_udf(StringType())
def _resolve_entities(text: pa.Array) -> pa.Array:
    plain = [None if t is None else html.unescape(t) for t in text.to_pylist()]
    return pa.array(plain, pa.string())


def _resolve_common(text: Column) -> Column:
    for name, plain in COMMON_ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(plain))
    return text


def with_stripped_html(
    df: DataFrame, source: str, target: str, unescape_first: bool = False
) -> DataFrame:
    """Add ``target``: ``source`` without tags, entities resolved, white space collapsed.

    Rows whose entities are all common stay in the JVM; only the others are sent
    through the Arrow function, which gets null for every row it need not see.
    ``unescape_first`` also drops markup that arrives entity-encoded.
    """
    body = F.coalesce(F.col(source), F.lit(""))
    if not unescape_first:
        body = F.regexp_replace(body, TAG, " ")
    df = df.withColumn("_body", body)
    rare = F.col("_body").rlike(OTHER_ENTITY)
    df = df.withColumn("_rare", _resolve_entities(F.when(rare, F.col("_body"))))
    plain = F.coalesce(F.col("_rare"), _resolve_common(F.col("_body")))
    if unescape_first:
        plain = F.regexp_replace(plain, TAG, " ")
    return df.withColumn(
        target, F.trim(F.regexp_replace(plain, SPACES, " "))
    ).drop("_body", "_rare")
