"""Progress of streaming queries as counters."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQueryListener


class RuntimeStats(StreamingQueryListener):
    """Counts batches, rows and failures of the queries of a session."""

    def __init__(self) -> None:
        self.batches = self.rows = self.failed = 0
        self.seconds = 0.0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches += 1
        self.rows += p.numInputRows
        self.seconds += p.durationMs.get("triggerExecution", 0) / 1000

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.failed += event.exception is not None

    @property
    def average_seconds(self) -> float:
        return self.seconds / self.batches if self.batches else 0.0
