"""State and output tables as Parquet folders, one per batch.

Every batch owns its folder of every table and overwrites it when it is run again, so
a replay after a lost executor or driver leaves the same tables. A batch reads only
what earlier batches wrote. Nothing that is being read is overwritten.

Seen keys lie in buckets by hash of the key: a batch reads the buckets of its own keys.
Every few batches all buckets become one base. What the base before the newest already
holds is removed, so any batch after that one can be run again, and the folders stay few.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lookout import schemas
from lookout.operators.seen import BUCKETS, SEEN_COLUMNS, bucket, retain
from lookout.sources import files

TABLES = {
    "page_stops": "fetcher STRING, run_ts TIMESTAMP, catalog_name STRING, term_idx INT, _stop INT",
    "pages": schemas.PAGES,
    "quarantine": schemas.QUARANTINE,
    "run_log": schemas.RUN_LOG,
    "scored": schemas.SCORED,
    "alerts": schemas.ALERTS,
    "seen": schemas.SEEN_V1,
    "seen_base": schemas.SEEN_V1,
    "seen_v2": schemas.SEEN + ", bucket INT",
    "seen_v2_base": schemas.SEEN + ", bucket INT",
    "company_failures": schemas.FAILURES,
    "run_summary": schemas.SUMMARY,
    "streaks": schemas.STREAKS,
    "stream_metrics": schemas.METRICS,
}


# Tables that only the run of their batch reads.
PASSING = ("pages", "page_stops", "scored")


class Workspace:
    """The folder that holds all tables of one watch."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def write(self, df: DataFrame, table: str, batch_id: int) -> DataFrame:
        """Write a batch's part of a table and return it as read back."""
        self.write_rows(df, table, batch_id)
        return self.read_batch(table, batch_id)

    def write_rows(self, df: DataFrame, table: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/batch_id={batch_id}")

    def read_batch(self, table: str, batch_id: int) -> DataFrame:
        path = f"{self.root}/{table}/batch_id={batch_id}"
        return self.spark.read.schema(TABLES[table]).parquet(path)

    def read(self, table: str, before: int | None = None) -> DataFrame:
        """All batches of a table, or those before one; empty if there is none yet.

        Only a missing table is empty. Damaged files fail the query that reads them.
        """
        schema = TABLES[table] + ", batch_id BIGINT"
        df = self._read(f"{self.root}/{table}", schema)
        return df if before is None else df.filter(F.col("batch_id") < before)

    def write_snapshot(self, df: DataFrame, table: str, batch_id: int) -> None:
        """Write a table as a whole, then the marker that makes readers use it."""
        self.write_rows(df, table, batch_id)
        self._mark(table, batch_id)

    def _mark(self, table: str, batch_id: int) -> None:
        marker = self.spark.range(1).select(F.lit(batch_id).cast("bigint").alias("snapshot"))
        marker.coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/{table}_ready/batch_id={batch_id}"
        )

    def _newest(self, table: str, before: int | None) -> int | None:
        ready = self._read(f"{self.root}/{table}_ready", "snapshot BIGINT, batch_id BIGINT")
        if before is not None:
            ready = ready.filter(F.col("batch_id") < before)
        return ready.agg(F.max("snapshot")).first()[0]

    def latest(self, table: str, before: int | None = None) -> DataFrame:
        """The newest snapshot of a table; it may well be an empty one."""
        newest = self._newest(table, before)
        if newest is None:
            return self.spark.createDataFrame([], TABLES[table])
        return self.read_batch(table, newest)

    def write_seen(self, marks: DataFrame, batch_id: int) -> None:
        self._write_buckets(marks, "seen_v2", batch_id)

    def _write_buckets(self, rows: DataFrame, table: str, batch_id: int) -> None:
        dealt = rows.select(*SEEN_COLUMNS, bucket().alias("bucket")).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{table}/batch_id={batch_id}")

    def seen(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Seen keys, of some buckets or of all: the newest base and the batches after it.

        Folders of the first layout have no buckets and no catalogue names; they are read
        until a base holds their rows.
        """
        base_at, parts = self._newest("seen_v2_base", before), []
        if base_at is not None:
            parts.append(self.read_batch("seen_v2_base", base_at))
        marks = [self.read("seen_v2", before)]
        if self._has("seen") or self._has("seen_base"):
            marks.append(self.read("seen", before).withColumns({"catalog_name": F.lit(None).cast("string"), "bucket": bucket()}))
            old = self._newest("seen_base", before) if base_at is None else None
            if old is not None:
                parts.append(self.read_batch("seen_base", old).withColumns({"catalog_name": F.lit(None).cast("string"), "bucket": bucket()}))
                base_at = old
        parts += marks if base_at is None else [m.filter(F.col("batch_id") > base_at) for m in marks]
        some = buckets is not None and len(buckets) < BUCKETS
        parts = [(p.filter(F.col("bucket").isin(buckets)) if some else p).select(*SEEN_COLUMNS) for p in parts]
        return reduce(DataFrame.unionByName, parts)

    def compact_seen(self, batch_id: int, n: int | None = None) -> None:
        """Rewrite the seen keys up to a batch as one base: all, or the newest ``n``."""
        before = self._newest("seen_v2_base", batch_id)
        self._write_buckets(retain(self.seen(batch_id + 1), n), "seen_v2_base", batch_id)
        self._mark("seen_v2_base", batch_id)
        if before is not None:
            self.clean(before)

    def clean(self, upto: int) -> None:
        """Remove what no run of a batch after ``upto``, a base's batch, reads."""
        for table in ("seen", "seen_v2", *PASSING):
            self._remove(table, lambda k: k <= upto)
        for table in ("seen_base", "seen_v2_base", "company_failures"):
            kept = upto if table != "company_failures" else self._newest(table, upto + 1)
            # The marker goes first, so that no reader takes a table that is half gone.
            for part in (f"{table}_ready", table):
                self._remove(part, lambda k: kept is not None and k < kept)

    def _remove(self, table: str, old: Callable[[int], bool]) -> None:
        for name in files.names(self.spark, f"{self.root}/{table}"):
            if name.startswith("batch_id=") and old(int(name.split("=")[1])):
                files.remove(self.spark, f"{self.root}/{table}/{name}")

    def _has(self, table: str) -> bool:
        return any(n.startswith("batch_id=") for n in files.names(self.spark, f"{self.root}/{table}"))

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
