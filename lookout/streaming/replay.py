"""Streaming replays of the driver's tables, read back as batch frames."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lookout.functions.text import dedup_key
from lookout.operators import rules
from lookout.plans.profiles import PROSE
from lookout.plans.views import table
from lookout.plans.watch import process_postings
from lookout.session import scratch_dir
from lookout.sources.state import Workspace
from lookout.streaming import keyed, poll
from lookout.streaming.metrics import MetricsTable

# Parts that a table is landed in, at least, and the rows of a part, about.
PARTS = 4
PART_ROWS = 5_000_000
# Bytes of values in a file of a part, about: no task writes or reads much more.
FILE_BYTES = 256 << 20


def landed_parts(rows: DataFrame, at: Column, path: str) -> DataFrame:
    """Land ``rows`` as files of equal ranges of ``at``, and stream these parts in that order.

    All files are written at once, by as many tasks. A file source reads files by their
    time of change, so their times are set in the order of the parts. Every part has as many
    files as the largest needs, small ones some without rows; so many files are read at a
    time, and every part is one micro-batch, and state goes from batch to batch.
    """
    spark = rows.sparkSession
    size = rows.agg(F.count("*").alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    n = max(PARTS, -(-size.n // PART_ROWS))
    width = max(1, -(-((size.hi or 0) - (size.lo or 0) + 1) // n))
    part = F.floor((at - F.lit(size.lo or 0)) / F.lit(width)).cast("int")
    placed = rows.withColumn("_part", part)
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.lit(8) for c, t in rows.dtypes]
    held = placed.groupBy("_part").agg(F.sum(sum(wide, F.lit(0).cast("long"))).alias("bytes"))
    each = max(1, -(-(held.agg(F.max("bytes")).first()[0] or 0) // FILE_BYTES))
    # Rows are dealt to the files of their part in turn, whatever values they have.
    file = F.pmod(F.monotonically_increasing_id(), F.lit(each)).cast("int")
    placed.repartitionById(n * each, F.coalesce("_part", F.lit(0)) * each + file).write.partitionBy("_part").parquet(path)
    files = spark.read.parquet(path).select("_part", F.input_file_name().alias("file")).distinct().collect() if size.n else []
    if each > 1:
        files = files + _filled(rows.limit(0), path, [r._part for r in files], each)
    _date(spark, [r.file for r in sorted(files, key=lambda r: r._part)])
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(path)


def _filled(none: DataFrame, path: str, parts: list[int], each: int) -> list[Row]:
    """Files without rows, copied to every part until it has ``each``."""
    spark = none.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    none.coalesce(1).write.parquet(f"{path}-empty")
    hadoop = jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{path}-empty")
    fs = folder.getFileSystem(conf)
    empty = next(f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().endswith(".parquet"))
    made = []
    for part, n in Counter(parts).items():
        for k in range(n, each):
            to = hadoop.Path(f"{path}/_part={part}/empty-{k}.parquet")
            hadoop.FileUtil.copy(fs, empty, fs, to, False, conf)
            made.append(Row(_part=part, file=fs.makeQualified(to).toUri().toString()))
    return made


def _date(spark: SparkSession, files: list[str]) -> None:
    """Times of change a second apart; a store that keeps its own ends the replay."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    for k, name in enumerate(files):
        file = path(jvm.java.net.URI(name))
        fs, at = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), 1_600_000_000_000 + 1000 * k
        fs.setTimes(file, at, -1)
        if fs.getFileStatus(file).getModificationTime() != at:
            raise RuntimeError(f"the store of {name} doesn't keep the order of the parts")


def _documents(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    docs = landed_parts(table(spark, sf_dir, "documents"), F.col("doc_id"), f"{root}/landing")
    return docs.select(
        F.col("lang").alias("company"),
        F.md5("text").alias("job_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("lang").alias("location"),
        F.concat(F.lit("doc/"), "doc_id").alias("url"),
        F.col("text").alias("description"),
        F.lit(None).cast("string").alias("posted_at"),
        F.col("source").alias("catalog_name"),
        F.lit("2026-01-01 00:00:00").cast("timestamp").alias("run_ts"),
        F.lit(0).alias("term_idx"),
        F.lit(0).alias("page_no"),
        F.col("doc_id").alias("pos"),
    ).withColumn("key", dedup_key())


def _events(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    return landed_parts(events, at, f"{root}/landing").select(
        F.col("user_id").cast("string").alias("company"),
        F.col("ts").cast("timestamp").alias("run_ts"),
        F.col("event_id").alias("run_id"),
        (F.col("event_type") != "error").alias("ok"),
        F.col("props").alias("error"),
    )


ORDER = ("run_ts", "run_id")


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of postings; exact copies of one language alert once."""
    ws = Workspace(spark, scratch_dir(spark, "stream-alerts"))

    def run(batch: DataFrame, batch_id: int) -> None:
        process_postings(ws, batch, PROSE, batch_id, dedupe_batch=True, retained=None)

    poll.start(_documents(spark, sf_dir, ws.root), run, f"{ws.root}/checkpoint").awaitTermination()
    return ws.read("alerts").select("key", "company", "score")


def stream_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of run outcomes; the failure counters after the last batch."""
    ws = Workspace(spark, scratch_dir(spark, "stream-streak"))
    run = poll.failure_batch(ws, ORDER)
    poll.start(_events(spark, sf_dir, ws.root), run, f"{ws.root}/checkpoint").awaitTermination()
    return ws.latest("company_failures").select("company", "count", "last_error")


def stream_streak_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counters, kept as keyed state in the stream itself."""
    ws = Workspace(spark, scratch_dir(spark, "stream-keyed"))
    log = _events(spark, sf_dir, ws.root)
    keyed.watch_streaks(ws, log, f"{ws.root}/checkpoint", order=ORDER).awaitTermination()
    return keyed.newest(ws).select("company", "count", "last_error")


def stream_first_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first posting of every key, told by streaming state instead of a seen table."""
    ws = Workspace(spark, scratch_dir(spark, "stream-first"))
    keyed.use_rocksdb(spark)
    first = poll.once_per_key(_documents(spark, sf_dir, ws.root).select("key", "company", "run_ts"))

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{ws.root}/first/batch_id={batch_id}")

    poll.start(first, run, f"{ws.root}/checkpoint").awaitTermination()
    return spark.read.schema("key STRING, company STRING").parquet(f"{ws.root}/first").select("key", "company")


def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each micro-batch scored and passed, as its listener wrote them."""
    ws = Workspace(spark, scratch_dir(spark, "stream-metrics"))
    scored = poll.observed(rules.with_score(_documents(spark, sf_dir, ws.root), PROSE))
    listened(ws, scored.filter("passes").select("key", "company", "score"), f"{ws.root}/checkpoint")
    return ws.read("stream_metrics").select("batch_id", "n_input", "scored", "matched")


def listened(ws: Workspace, stream: DataFrame, checkpoint: str) -> StreamingQuery:
    """Run a stream to its end, its observed metrics to ``stream_metrics``."""
    listener = MetricsTable(ws, f"metrics-{uuid.uuid4().hex}")
    ws.spark.streams.addListener(listener)
    try:
        query = poll.start(stream, lambda batch, batch_id: ws.write_rows(batch, "matched", batch_id), checkpoint, name=listener.name)
        query.awaitTermination()
        listener.wait()
    finally:
        ws.spark.streams.removeListener(listener)
    return query
