"""Structured logs, and counters of stages that are taken in the pass that writes them."""

from __future__ import annotations

import json
import logging
import logging.handlers
import os
import time
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from docloom.runtime import stage

log = logging.getLogger("docloom.stages")
STAGES = "run string, stage string, rows_in long, rows_out long, rejected long, seconds double"
_PLAIN = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


class JsonLines(logging.Formatter):
    """One JSON object a record: time, level, logger, message, place, all extra fields, exception."""

    def format(self, record: logging.LogRecord) -> str:
        fields = {
            "timestamp": self.formatTime(record, "%Y-%m-%dT%H:%M:%S%z"), "level": record.levelname, "logger": record.name, "message": record.getMessage(),
            "module": record.module, "function": record.funcName, "line": record.lineno,
        }
        fields |= {k: v for k, v in vars(record).items() if k not in _PLAIN}
        if record.exc_info:
            fields["exception"] = self.formatException(record.exc_info)
        return json.dumps(fields, default=str)


class OfLoggers(logging.Filter):
    """Passes the records of these loggers and of those below them."""

    def __init__(self, *names: str):
        super().__init__()
        self.names = names

    def filter(self, record: logging.LogRecord) -> bool:
        return any(record.name == n or record.name.startswith(f"{n}.") for n in self.names)


#: Files beside the main one: the loggers they hold, and the lowest level.
FILES = {"watcher.log": (("docloom.streaming",), logging.DEBUG), "processing.log": (("docloom.operators", "docloom.sources", "docloom.stages"), logging.DEBUG), "errors.log": (("docloom",), logging.ERROR)}


def configure(folder: str | None = None, level: str = "INFO", lines: str = "json", max_bytes: int = 10 << 20, backups: int = 5, console: bool = True) -> logging.Logger:
    """Send the driver's records of this package to the console and to rotating files of a folder; a second call replaces the first.

    ``lines``: "json" or "text".
    """
    top = logging.getLogger("docloom")
    for old in top.handlers[:]:
        top.removeHandler(old)
        old.close()
    top.setLevel(level.upper())
    top.propagate = False
    text = logging.Formatter("%(asctime)s | %(levelname)s | %(name)s | %(module)s:%(lineno)d | %(message)s")
    if console:
        shown = logging.StreamHandler()
        shown.setFormatter(text)
        top.addHandler(shown)
    for name, (loggers, lowest) in ({"docloom.log": (("docloom",), logging.DEBUG), **FILES} if folder else {}).items():
        os.makedirs(folder, exist_ok=True)
        file = logging.handlers.RotatingFileHandler(os.path.join(folder, name), maxBytes=max_bytes, backupCount=backups, encoding="utf-8", delay=True)
        file.setFormatter(JsonLines() if lines == "json" else text)
        file.setLevel(lowest)
        file.addFilter(OfLoggers(*loggers))
        top.addHandler(file)
    return top


class Counters:
    """Rows in, out and rejected, and seconds, of the stages of a run: one log record and one table row each.

    The counts are taken by ``DataFrame.observe`` while a stage is written: nothing is read twice.
    """

    def __init__(self, spark: SparkSession, run: str = ""):
        self.spark, self.run, self.rows = spark, run, []

    def staged(self, df: DataFrame, name: str, keep: Column | None = None) -> DataFrame:
        """Write the rows of a stage to the shared folder and read them again; rows for which ``keep`` isn't true are counted as rejected but stay."""
        seen, begin = Observation(), time.monotonic()
        kept = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
        out = stage(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(kept).alias("kept")), name)
        found = seen.get
        self.add(name, found["rows"], found["kept"], found["rows"] - found["kept"], time.monotonic() - begin)
        return out

    def add(self, name: str, rows_in: int, rows_out: int, rejected: int, seconds: float) -> None:
        row = (self.run, name, rows_in, rows_out, rejected, round(seconds, 3))
        self.rows.append(row)
        log.info("stage %s", name, extra=dict(zip(("run", "stage", "rows_in", "rows_out", "rejected", "seconds"), row, strict=True)))

    def table(self) -> DataFrame:
        """The stages so far (``STAGES``), in order."""
        return self.spark.createDataFrame(self.rows, STAGES).coalesce(1)


class BatchCounters(StreamingQueryListener):
    """Logs each batch of the session's streams: rows, seconds and what its plan observes (``DataFrame.observe(name, …)``)."""

    def __init__(self, only: Iterable[str] = ()):
        self.only, self.batches = set(only), []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.only and p.name not in self.only:
            return
        observed = {k: v.asDict() if hasattr(v, "asDict") else v for k, v in (p.observedMetrics or {}).items()}
        row = {"query": p.name, "batch": p.batchId, "rows_in": p.numInputRows, "seconds": p.durationMs.get("triggerExecution", 0) / 1000, "observed": observed}
        self.batches.append(row)
        log.info("batch %s", p.batchId, extra=row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            log.error("stream ended: %s", event.exception.splitlines()[0], extra={"query": str(event.id)})
