"""The driver's tables seen as postings, run log, catalogue and payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lookout.functions.text import dedup_key
from lookout.plans.payload_queries import PAGED, PAYLOADS
from lookout.session import configure

RUN_TS = "2026-01-01 00:00:00"
SEEN_TS = "2025-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings: the title is the first line, the body the whole text."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("company"),
        F.col("doc_id").cast("string").alias("job_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("lang").alias("location"),
        F.concat(F.lit("doc/"), "doc_id").alias("url"),
        F.col("text").alias("description"),
        "doc_id",
    ).withColumn("key", dedup_key())


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings whose id is the hash of the text, so that exact copies share a key."""
    return (
        postings(spark, sf_dir)
        .withColumns({"company": F.col("location"), "job_id": F.md5("description")})
        .withColumn("key", dedup_key())
    )


def labelled(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """The postings that the labels table knows; they stand for those seen before."""
    return rows.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the outcomes of runs, one company per user."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("company"),
        F.col("ts").alias("run_ts"),
        F.col("event_id").alias("run_id"),
        F.col("event_type").alias("fetcher"),
        (F.col("event_type") != "error").alias("ok"),
        F.col("props").alias("error"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as catalogue; one market segment carries no enabled flag."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("name"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") > 0).alias("enabled"),
        F.col("c_custkey").alias("pos"),
    )


def event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as seen keys; cheap events get a key without a colon."""
    return table(spark, sf_dir, "events").select(
        F.when(F.col("value") < 10, F.col("event_type"))
        .otherwise(F.concat_ws(":", "event_type", "event_id")).alias("key")
    )


def user_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat_ws(":", "user_id", "event_id").alias("key"), F.col("ts").alias("first_seen")
    )


def payloads(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    """Parts as landed pages of the named sources, one search term and page per part."""
    parts = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS k", "p_name AS n", "p_brand AS b", "p_type AS t", "p_size AS z"
    )
    frames = [
        parts.select(
            F.lit(name).alias("fetcher"), F.col("b").alias("company"),
            F.col("k").alias("term_idx"), F.lit(0).alias("page_no"),
            instant(RUN_TS).alias("run_ts"), F.lit("ok").alias("status"),
            F.expr(f"to_json({PAYLOADS[name][0]})").alias("body"),
        )
        for name in names or PAYLOADS
    ]
    return reduce(DataFrame.union, frames)


def paged_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the pages of four search terms per brand, some of them odd; see ``PAGED_SQL``."""
    term, page = F.col("term_idx"), F.col("page_no")
    parts = table(spark, sf_dir, "part").selectExpr(
        "p_brand AS company", "CAST(p_partkey % 4 AS INT) AS term_idx", "CAST(p_partkey div 4 % 6 AS INT) AS page_no",
        "struct(p_partkey AS k, p_name AS n, IF(p_size <= 48, p_partkey % 50, NULL) AS id) AS x",
    )
    pages = parts.groupBy("company", "term_idx", "page_no").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    empty = F.filter("xs", lambda x: F.lit(False))
    pages = pages.withColumns({
        "xs": F.when((term == 3) & (page == 1), empty).otherwise(F.col("xs")),
        "pages": F.when(term == 0, 4).otherwise(10**6),
        "status": F.when((term == 1) & (page == 3), "timeout").otherwise("ok"),
    })
    body = F.col("body")
    frames = [
        pages.select(
            F.lit(name).alias("fetcher"), "company", "term_idx", "page_no", instant(RUN_TS).alias("run_ts"), "status",
            F.expr(f"to_json({PAGED[name]})").alias("body"),
        ).withColumn("body", F.when((term == 2) & (page == 2), F.substring(body, F.lit(1), F.length(body) - 3)).otherwise(body))
        for name in PAGED
    ]
    return reduce(DataFrame.union, frames)


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalogue entry per brand, with the values the paged sources need."""
    return (
        table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name"))
        .agg(F.min("p_partkey").alias("pos"))
        .select(
            "name", "pos", F.concat(F.lower("name"), F.lit(".example")).alias("host"),
            F.concat(F.lit("S-"), "name").alias("site"),
            F.lit(None).cast("string").alias("public_url_base"),
            F.lit(None).cast("int").alias("max_pages"),
        )
    )
