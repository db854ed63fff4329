"""The watch as a stream: every poll is a micro-batch over the landing folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lookout.operators import failures
from lookout.operators.rules import Profile
from lookout.plans.watch import payload_batch
from lookout.schemas import RAW
from lookout.sources.state import Workspace

INTERVAL = "5 minutes"


def landed(spark: SparkSession, path: str, schema: str = RAW, fmt: str = "parquet",
           **options: str) -> DataFrame:
    """New files of a folder as a stream, with a declared schema."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def start(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str,
          interval: str | None = None, mode: str = "append", name: str | None = None) -> StreamingQuery:
    """Run a function on every micro-batch; without an interval, until all is read."""
    writer = stream.writeStream.foreachBatch(run).outputMode(mode).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if interval:
        return writer.trigger(processingTime=interval).start()
    return writer.trigger(availableNow=True).start()


def watch(ws: Workspace, landing_path: str, companies: DataFrame, profile: Profile,
          interval: str | None = INTERVAL, fmt: str = "parquet", files_per_batch: int | None = None,
          **options) -> StreamingQuery:
    """Poll the landing folder: parse, score, alert once per key, keep all state."""
    limits = {"maxFilesPerTrigger": str(files_per_batch)} if files_per_batch else {}
    stream = landed(ws.spark, landing_path, fmt=fmt, **limits)
    run = payload_batch(ws, companies, profile, **options)
    return start(stream, run, f"{ws.root}/checkpoint", interval)


def failure_batch(ws: Workspace, order: tuple[str, ...] = ("run_ts",)) -> Callable[[DataFrame, int], None]:
    """A batch function that folds run outcomes into the failure counters."""
    def run(log: DataFrame, batch_id: int) -> None:
        counters = ws.latest("company_failures", before=batch_id)
        ws.write_snapshot(failures.update_failures(counters, log, order), "company_failures", batch_id)
    return run


def once_per_key(stream: DataFrame, within: tuple[str, str] | None = None) -> DataFrame:
    """First posting of every key, kept in streaming state instead of a seen table.

    ``within`` is a time column and a delay; it bounds the state and lets a key that
    stays away longer count as new again. Use the RocksDB state store for many keys.
    """
    if within is None:
        return stream.dropDuplicates(["key"])
    column, delay = within
    return stream.withWatermark(column, delay).dropDuplicatesWithinWatermark(["key"])


def observed(scored: DataFrame, name: str = "run") -> DataFrame:
    """Count scored and passing rows as they stream by; read from the query progress."""
    return scored.observe(
        name, F.count(F.lit(1)).alias("scored"), F.count_if("passes").alias("matched")
    )
