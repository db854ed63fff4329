"""Metrics of a streaming query as a table: one row per micro-batch."""

from __future__ import annotations

import threading

from pyspark.sql import Row
from pyspark.sql.streaming import StreamingQueryListener

from lookout.schemas import METRICS
from lookout.sources.state import Workspace


class MetricsTable(StreamingQueryListener):
    """Writes what a query observes, batch by batch, to ``stream_metrics``.

    ``name`` is the query's, ``observed`` that of its observed columns. A batch owns its
    folder, so one that runs again after a restart replaces its row. Progress without
    the observed columns, of a batch that had no rows to run, is left out.
    """

    def __init__(self, ws: Workspace, name: str, observed: str = "run") -> None:
        self.ws, self.name, self.observed = ws, name, observed
        self.mine: set = set()
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.mine.add(event.runId)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = progress.observedMetrics.get(self.observed) if progress.name == self.name else None
        if row is None or not progress.numInputRows:
            return
        values = row.asDict() if isinstance(row, Row) else dict(row)
        self.ws.write(
            self.ws.spark.createDataFrame(
                [(self.name, progress.timestamp, progress.numInputRows, values["scored"], values["matched"])], METRICS
            ).coalesce(1),
            "stream_metrics", progress.batchId,
        )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId in self.mine:
            self.ended.set()

    def wait(self, seconds: float = 60) -> None:
        """Until the query's last event is here: its end comes after all its progress."""
        if not self.ended.wait(seconds):
            raise TimeoutError(f"no end of the query {self.name} within {seconds} s")
