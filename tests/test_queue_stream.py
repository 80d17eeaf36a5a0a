"""The stateful queue against a plain replay; stopped and begun again; files in several batches."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from docloom.streaming import queue as Q

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def _events(n, paths, seed):
    rng = random.Random(seed)
    at, rows = 0.0, []
    for _ in range(n):
        at += rng.choice([1, 5, 40, 400])
        rows.append((f"p{rng.randint(0, paths - 1)}", rng.choices(["arrive", "grow", "claim", "done", "fail"], [4, 1, 4, 2, 2])[0], START + timedelta(seconds=at)))
    return rows


def _plain(rows, lease, still, tries):
    items = {}
    for path, kind, at in sorted(rows, key=lambda r: r[2]):
        items.setdefault(path, Q.Item()).take(kind, at.timestamp(), lease, still, tries)
    end = max(at for _, _, at in rows).timestamp()
    for item in items.values():
        item.pass_time(end, tries)
    return {p: (i.status, i.attempts, i.accepted, i.rejected, i.recovered, i.events) for p, i in items.items()}


def test_replays_in_batches_and_after_stops_equal_a_plain_one(spark, tmp_path):
    rows = _events(400, 12, 1)
    options = {"lease": 900.0, "still": 30.0, "tries": 2}
    expected = _plain(rows, **options)
    assert {s[0] for s in expected.values()} >= {"FAILED", "PENDING"} and sum(s[4] for s in expected.values()) > 3
    # Four files, the later two written after the stream was stopped.
    for part in range(4):
        some = spark.createDataFrame(rows[part * 100 : part * 100 + 100], "path string, kind string, at timestamp")
        some.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        time.sleep(0.05)
        if part in (1, 3):
            found = Q.replay(spark, f"{tmp_path}/events", "states", f"{tmp_path}/checkpoint", per_batch=1, **options)
    assert {r["path"]: (r["status"], r["attempts"], r["accepted"], r["rejected"], r["recovered"], r["events"]) for r in found.collect()} == expected
    assert found.where(F.col("status") == "NEW").count() == sum(s[0] == "NEW" for s in expected.values())


def test_the_rules_of_one_path():
    take = lambda item, *events: [item.take(k, a, 10, 5, 2) for k, a in events] and item
    one = take(Q.Item(), ("arrive", 0), ("claim", 2), ("arrive", 3), ("claim", 6))
    assert (one.status, one.attempts, one.rejected) == ("PROCESSING", 1, 1)  # too early at 2: the file may still grow
    assert take(one, ("done", 15)).status == "DONE"
    two = take(Q.Item(), ("arrive", 0), ("grow", 4), ("claim", 6), ("claim", 9), ("claim", 30), ("claim", 50))
    assert (two.status, two.attempts, two.recovered) == ("FAILED", 2, 2)
    assert take(two, ("arrive", 60)).status == "PENDING" and two.accepted == 2
