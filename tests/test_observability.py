"""Structured logs and counters that are taken on the way."""

from __future__ import annotations

import json
import logging

import pytest
from pyspark.sql import functions as F

from docloom import observability as O
from docloom.sources import files


@pytest.fixture
def logs(tmp_path):
    O.configure(str(tmp_path / "logs"), "DEBUG", console=False)
    yield lambda name: [json.loads(x) for x in (tmp_path / "logs" / name).read_text().splitlines()] if (tmp_path / "logs" / name).exists() else []
    top = logging.getLogger("docloom")
    for h in top.handlers[:]:
        top.removeHandler(h)
        h.close()
    top.propagate = True
    top.setLevel(logging.NOTSET)


def test_records_are_json_and_sorted_into_files(logs):
    logging.getLogger("docloom.streaming.watch").info("seen %d", 3, extra={"folder": "in", "odd": object()})
    logging.getLogger("docloomer").error("of another package")
    try:
        raise ValueError("no")
    except ValueError:
        logging.getLogger("docloom.sources.files").exception("broken")
    main = logs("docloom.log")
    assert [r["message"] for r in main] == ["seen 3", "broken"] and main[0]["folder"] == "in" and "ValueError: no" in main[1]["exception"]
    assert [r["message"] for r in logs("watcher.log")] == ["seen 3"]
    assert [r["message"] for r in logs("processing.log")] == [r["message"] for r in logs("errors.log")] == ["broken"]


def test_counters_of_stages(spark, logs):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "a")], "id long, x string").repartition(3)
    counters = O.Counters(spark, "r")
    out = counters.staged(rows, "first", F.col("x") == "a")
    counters.staged(out.where("x = 'c'"), "none")
    assert out.count() == 4
    assert [tuple(r)[:5] for r in counters.table().collect()] == [("r", "first", 4, 2, 2), ("r", "none", 0, 0, 0)]
    assert [(r["stage"], r["rejected"]) for r in logs("processing.log")] == [("first", 2), ("none", 0)]


def test_ingest_counts_in_its_pass(spark, tmp_path, logs):
    for name, data in (("a.md", b"# A"), ("b.txt", b"b"), ("c.ipynb", b"{broken")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    counters = O.Counters(spark, "ingest")
    good, bad = files.ingest(spark, f"file://{tmp_path}/in", counters=counters)
    assert (good.count(), bad.count()) == (2, 1) and counters.rows[0][2:5] == (3, 2, 1)


def test_batches_of_streams(spark, tmp_path, logs):
    spark.range(10).write.parquet(str(tmp_path / "n"))
    listener = O.BatchCounters(["counted"])
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "n")).observe("even", F.count_if(F.col("id") % 2 == 0).alias("n"))
        q = stream.writeStream.format("noop").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        for _ in range(50):
            if listener.batches:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.batches[0]["rows_in"] == 10 and listener.batches[0]["observed"] == {"even": {"n": 5}}
