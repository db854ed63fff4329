"""Failure counters as keyed streaming state, with a timer that lets a company be tried again."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from lookout.operators.failures import ERROR_LENGTH, SKIP_THRESHOLD
from lookout.schemas import STREAKS
from lookout.sources.state import Workspace
from lookout.streaming import poll

# Arbitrary state needs this store; it also keeps large state out of the executors' heap.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "count INT, last_error STRING, last_failed_at TIMESTAMP"
# How far outcomes may come out of order.
DELAY = "1 hour"


def _later(a: tuple, b: tuple) -> bool:
    """Whether ``a`` comes after ``b`` in the order; unknown places come first, as in Spark's."""
    return [(x is not None, x) for x in a] > [(x is not None, x) for x in b]


class Streak(StatefulProcessor):
    """Consecutive failures of one company.

    A success deletes the counter and its timer. At the threshold a timer is set for the
    last failure plus ``probe_after``; when event time passes it, the company is reported
    once with ``probe``, and keeps its counter until it succeeds.
    """

    def __init__(self, order: tuple[str, ...], threshold: int, probe_after: timedelta | None) -> None:
        self.order, self.threshold, self.probe_after = list(order), threshold, probe_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("streak", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Few companies have many rows in a batch, so plain values beat a frame for each.
        failed, ok_at, last, error = [], None, None, None
        for row in rows:
            at = tuple(row[c] for c in self.order)
            if row["ok"]:
                if ok_at is None or _later(at, ok_at):
                    ok_at = at
            elif row["ok"] is not None and (ok_at is None or _later(at, ok_at)):
                failed.append(at)
                if last is None or _later(at, last) or at == last:
                    last, error = at, row["error"]
        if ok_at is not None:
            failed = [at for at in failed if _later(at, ok_at)]
        yield self._result(key, *self._fold(len(failed), last, error, ok_at is not None))

    def _fold(self, failed: int, last: tuple | None, error: str | None, had_ok: bool) -> tuple:
        old = None if had_ok else self.state.get()
        if not failed and old is None:
            if had_ok:
                self.state.clear()
                self._reset_timer(None)
            return 0, None, None, False
        if not failed:
            return (*old, False)
        now = ((old[0] if old else 0) + failed, None if error is None else error[:ERROR_LENGTH], last[0])
        self.state.update(now)
        self._reset_timer(now if now[0] >= self.threshold else None)
        return (*now, False)

    def _reset_timer(self, now: tuple | None) -> None:
        if self.probe_after is None:
            return
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if now is not None:
            due = now[2] + self.probe_after
            self.handle.registerTimer(int(due.timestamp() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        old = self.state.get()
        if old is not None:
            yield self._result(key, *old, True)

    def _result(self, key, count, error, at, probe) -> Row:
        return Row(
            company=key[0], count=count, last_error=error, last_failed_at=at,
            skipped=count >= self.threshold and not probe, probe=probe,
        )

    def close(self) -> None:
        pass


def streaks(log: DataFrame, order: tuple[str, ...] = ("run_ts",), threshold: int = SKIP_THRESHOLD,
            probe_after: timedelta | None = None, delay: str = DELAY) -> DataFrame:
    """A stream of run outcomes to a stream of counters, one row per company and batch.

    Event time is the first order column. A company whose last run succeeded is reported
    with a count of zero, so that a reader of the newest row forgets it. Outcomes without a
    company count for none.
    """
    rows = log.where("company IS NOT NULL").select("company", "ok", F.substring("error", 1, ERROR_LENGTH).alias("error"), *order)
    return rows.withWatermark(order[0], delay).groupBy("company").transformWithState(
        Streak(order, threshold, probe_after), STREAKS, "Update", "EventTime"
    )


def watch_streaks(ws: Workspace, log: DataFrame, checkpoint: str, interval: str | None = None, **options) -> StreamingQuery:
    """Run ``streaks`` on a stream; every batch's rows go to its folder of ``streaks``."""
    use_rocksdb(ws.spark)

    def run(batch: DataFrame, batch_id: int) -> None:
        ws.write(batch, "streaks", batch_id)

    return poll.start(streaks(log, **options), run, checkpoint, interval, mode="update")


def newest(ws: Workspace) -> DataFrame:
    """The newest counter of every company that fails, from all batches."""
    columns = ["count", "last_error", "last_failed_at", "skipped", "probe"]
    last = ws.read("streaks").groupBy("company").agg(F.max_by(F.struct(*columns), F.struct("batch_id", "probe")).alias("_last"))
    return last.select("company", "_last.*").where("count > 0")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
