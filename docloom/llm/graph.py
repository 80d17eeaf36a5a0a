"""Connected components of an edge table, as alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.plumbing import discard, stage


def local_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            break
        u, v = u[open_], v[open_]
        np.minimum.at(label, high[open_], low[open_])
        while (label != (up := label[label])).any():
            label = up
    return label


#: Keys with more rows than this share of the table are joined by broadcast: there are at most HOT_KEYS of them.
HOT_KEYS = 50_000
COLD_ROWS = 64


def join_low(rows: DataFrame, low: DataFrame, key: str, total: int) -> DataFrame:
    """Join rows with ``low`` (one row a key, with ``n``, the key's number of rows) so that no key loads one task.

    ``total`` is the number of rows. Keys with more than COLD_ROWS rows and more than total / HOT_KEYS can be HOT_KEYS at
    most: they are sent to all tasks. The other keys are shuffled.
    """
    edge = max(COLD_ROWS, total // HOT_KEYS)
    hot = low.where(F.col("n") > edge)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(low.where(F.col("n") <= edge), key)).drop("n")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return join_low(both.where("v > u"), low, "u", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_low(down, low, "u", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each node with an edge (u, v); root is the component's smallest node.

    Rounds write their edges to the shared folder and delete those of the round before. They end when a round
    changes nothing: all edges then point from a node to its root.
    """
    now = stage(edges.where("u <> v").select("u", "v").distinct(), name)
    seen = _signature(now)
    while seen[0]:
        large = stage(_large_star(now, seen[0]), name)
        after = stage(_small_star(large, seen[0]), name)
        discard(large)
        discard(now)
        now = after
        if (new := _signature(now)) == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
