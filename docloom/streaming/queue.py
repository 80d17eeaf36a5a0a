"""The work queue as a stateful stream: a state for each path, timers for lost claims and for files that still grow.

Events are rows (path, kind, at): `arrive`, `grow` (the file was written to), `claim`,
`done`, `fail`. A path that is queued or in work rejects another arrival. A claim that
is neither done nor failed within its lease is lost: the path is queued again, at most
``tries`` times in all, then it has failed. A path is ready once nothing wrote to it for
``still`` seconds; a claim before that is ignored.

Leases and stillness are judged by event time, at each event and, for paths without
further events, by timers. So a replay gives the same states however its rows fall into
batches and wherever it was stopped and begun again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LEASE, STILL, TRIES = 3600.0, 0.0, 3
STATE = "status string, attempts long, accepted long, rejected long, recovered long, until double, ready double, events long"
OUT = "path string, status string, attempts long, accepted long, rejected long, recovered long, events long"


@dataclass
class Item:
    """What is known of a path; times are seconds."""

    status: str = "NEW"
    attempts: int = 0
    accepted: int = 0
    rejected: int = 0
    recovered: int = 0
    until: float = 0.0
    ready: float = 0.0
    events: int = 0

    def give_back(self, tries: int) -> None:
        self.status = "PENDING" if self.attempts < tries else "FAILED"

    def pass_time(self, now: float, tries: int) -> bool:
        """Whether a lease had run out by now; the path is then queued again or has failed."""
        if self.status != "PROCESSING" or now <= self.until:
            return False
        self.recovered += 1
        self.give_back(tries)
        return True

    def take(self, kind: str, at: float, lease: float, still: float, tries: int) -> None:
        """One event, in the order of time."""
        self.pass_time(at, tries)
        self.events += 1
        if kind == "arrive":
            if self.status in ("PENDING", "PROCESSING"):
                self.rejected += 1
            else:
                self.status, self.attempts, self.accepted, self.ready = "PENDING", 0, self.accepted + 1, at + still
        elif kind == "grow" and self.status == "PENDING":
            self.ready = at + still
        elif kind == "claim" and self.status == "PENDING" and at >= self.ready:
            self.status, self.attempts, self.until = "PROCESSING", self.attempts + 1, at + lease
        elif kind == "done" and self.status == "PROCESSING":
            self.status = "DONE"
        elif kind == "fail" and self.status == "PROCESSING":
            self.give_back(tries)


class PathQueue(StatefulProcessor):
    """The state of each path, kept by the state store."""

    def __init__(self, lease: float = LEASE, still: float = STILL, tries: int = TRIES):
        self.lease, self.still, self.tries = lease, still, tries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", STATE)

    def _item(self) -> Item:
        held = self.item.get() if self.item.exists() else None
        return Item(*held) if held is not None else Item()

    def _put(self, key: tuple, item: Item) -> pd.DataFrame:
        self.item.update(tuple(asdict(item).values()))
        shown = {k: [v] for k, v in asdict(item).items() if k not in ("until", "ready")}
        return pd.DataFrame({"path": [key[0]], **shown})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        item = self._item()
        events = pd.concat(list(rows)).sort_values(["at", "kind"], kind="stable")  # one path's events of one batch
        for kind, at in zip(events["kind"], events["at"], strict=True):
            item.take(kind, at.timestamp(), self.lease, self.still, self.tries)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if item.status == "PROCESSING":
            self.handle.registerTimer(int(item.until * 1000) + 1)
        yield self._put(key, item)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        item = self._item()
        if item.pass_time(expiredTimerInfo.getExpiryTimeInMs() / 1000, self.tries):
            yield self._put(key, item)

    def close(self) -> None:
        pass


def queue_states(events: DataFrame, lease: float = LEASE, still: float = STILL, tries: int = TRIES, late: str = "0 seconds") -> DataFrame:
    """Stream of (path, status, attempts, accepted, rejected, recovered, events), the newest state of each path that changed; events: (path, kind, at)."""
    rows = events.select("path", "kind", "at").withWatermark("at", late)
    return rows.groupBy("path").transformWithStateInPandas(PathQueue(lease, still, tries), OUT, "Update", "EventTime")


def replay(spark: SparkSession, folder: str, name: str, checkpoint: str, per_batch: int = 1000, **options) -> DataFrame:
    """The last state of each path after a stream over Parquet files of events; run again on the same checkpoint it goes on where it stopped."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = spark.readStream.schema("path string, kind string, at timestamp").option("maxFilesPerTrigger", per_batch).parquet(folder)
        writer = queue_states(stream, **options).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        out = f"{checkpoint}-{name}"
        writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n:010d}")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return latest(spark.read.option("basePath", out).parquet(f"{out}/batch=*"))


def latest(states: DataFrame) -> DataFrame:
    """The newest row of each path."""
    from pyspark.sql import functions as F

    rest = [c for c in states.columns if c not in ("path", "batch")]
    return states.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct("batch", "events", "recovered")).alias("s")).select("path", "s.*")
