"""Exact cosine join above a threshold, pruned by pivots.

Angles between vectors are a metric. A few vectors of the store, chosen by a hash of
their ids, are pivots; each stored vector lies in the cell of its nearest pivot, at an
angle to it. A query can only reach angles of at most acos(threshold), so by the
triangle inequality whole runs of a cell are out of its reach: those whose angles to
the pivot are too far from the query's own, and cells whose pivot is farther from the
query than its nearest pivot by more than twice that reach. What is left is compared in
matrix products. Pruning never loses a pair; how much it saves depends on how clustered
the vectors are, and the pairs that were compared are reported.

The store is shuffled once, in ranges of (cell, angle), whatever the number of queries.
Queries come in blocks of at most ``QUERY_VALUES`` values (their angles to the pivots
count), each sent to all tasks, which return their best few for each query. No side is
copied. A task holds a block, its best few and one product of PRODUCT queries and RUN rows.

Odd input: null vectors match nothing. Zero vectors and vectors of another dimension
have cosine 0. Where the threshold is 0 or less nothing is pruned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.runtime import importable, stage

#: Most values of a block of queries, most pivots, and queries and rows of one matrix product.
QUERY_VALUES, PIVOTS, PRODUCT, RUN = 8_000_000, 128, 4096, 512
#: Products have multiples of so many rows and columns.
EDGE = 16
#: Hits that wait until they are merged into a task's best ones.
WAITING = 500_000
#: Angles are compared with so much to spare.
SLACK = 1e-6


@dataclass
class Work:
    """Pairs that a join compared, of those that there are."""

    compared: int = 0
    possible: int = 0
    blocks: list[int] = field(default_factory=list)

    @property
    def share(self) -> float:
        return self.compared / self.possible if self.possible else 0.0


def by_size(rows: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each dimension; null vectors are left out."""
    size = np.asarray(rows.value_lengths().fill_null(-1))
    flat = np.asarray(rows.flatten().cast(pa.float64()))
    at = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    for d in np.unique(size[size > 0]):
        mine = np.flatnonzero(size == d)
        yield mine, flat[at[mine, None] + np.arange(d)]


def unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(1))[:, None]
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def dots(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """q · mᵀ with the same last bits wherever two vectors stand, so that equal ones tie: at the edges of a product BLAS adds up in another order.

    This holds for one BLAS thread, which is what Spark gives a worker.
    """
    pad = lambda x: np.pad(x, ((0, -len(x) % EDGE), (0, 0)))
    return (pad(q) @ pad(m).T)[: len(q), : len(m)]


def angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angle of each vector to each pivot."""
    return np.arccos(np.clip(unit(m) @ pivots.T, -1, 1))


def pivots_of(store: DataFrame, most: int = PIVOTS) -> dict[int, np.ndarray]:
    """Unit pivots by dimension: the stored vectors of the smallest hashes, at most ``most`` in all."""
    some = store.orderBy(F.xxhash64("id", F.lit("pivot"))).limit(most).select("embedding").toArrow()["embedding"].combine_chunks()
    return {m.shape[1]: (u := unit(m))[(u != 0).any(axis=1)] for _, m in by_size(some)}


def _placed(store: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """The store (id, seq, embedding) with cell and angle, staged in ranges of both."""
    shared = store.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for mine, m in by_size(batch.column(2)):
                known = shared.value.get(m.shape[1])
                if known is None or not len(known):
                    continue
                far = angles(m, known)
                alive = (m != 0).any(axis=1)
                cell[mine] = np.where(alive, far.argmin(1), -1)
                angle[mine] = np.where(alive, far.min(1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=["id", "seq", "embedding", "cell", "angle"])

    kinds = ", ".join(f"{c} {store.schema[c].dataType.simpleString()}" for c in ("id", "seq", "embedding"))
    made = store.select("id", "seq", "embedding").mapInArrow(run, f"{kinds}, cell long, angle double")
    # Dimensions keep apart: a batch holds few of them.
    return stage(made.repartitionByRange(F.size("embedding"), "cell", "angle").sortWithinPartitions(F.size("embedding"), "cell", "angle"), "pivot-store")


def first_hits(score: np.ndarray, good: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of each query's k best good rows, of equal scores the first ones; what is cut is taken out of ``good``."""
    if k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    many = np.flatnonzero(good.sum(1) > k)
    if len(many):
        s = np.where(good[many], score[many], -np.inf)
        last = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
        above, equal = s > last, s == last
        good[many] = above | (equal & (equal.cumsum(1) <= k - above.sum(1)[:, None]))
    return np.nonzero(good)


class Best:
    """The k best hits of each of n queries, ties by id; ``bound`` is the k-th score, or what a hit has to reach at all."""

    def __init__(self, n: int, k: int, least: float, id_type: pa.DataType):
        self.k, self.bound, self.waiting, self.count = k, np.full(n, least, float), [], 0
        self.q, self.s, self.ids = np.zeros(0, np.int64), np.zeros(0), pa.array([], id_type)

    def add(self, q: np.ndarray, ids: pa.Array, s: np.ndarray) -> None:
        if len(q):
            self.waiting.append((q, ids, s))
            self.count += len(q)
            if self.count > WAITING:
                self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        q, s = (np.concatenate([own, *(w[i] for w in self.waiting)]) for own, i in ((self.q, 0), (self.s, 2)))
        ids = pa.concat_arrays([self.ids, *(w[1] for w in self.waiting)])
        order = np.lexsort((np.asarray(pc.rank(ids, tiebreaker="dense")), -s, q))
        q = q[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q)))
        kept = place < self.k
        self.q, self.s, self.ids, self.waiting = q[kept], s[order[kept]], ids.take(pa.array(order[kept])), []
        self.count = 0
        full = kept & (place == self.k - 1)
        self.bound[q[full]] = s[order[full]]


class Queries:
    """A block of queries of one dimension, with their angles to the pivots."""

    def __init__(self, place: np.ndarray, m: np.ndarray, last: np.ndarray, pivots: np.ndarray | None, reach: float):
        self.place, self.m, self.last, self.reach = place, m, last, reach
        self.scale = np.sqrt((m * m).sum(1))
        # Cosines with all pivots are the largest thing that a task holds; angles are made for the cells that it meets.
        self.to_pivots = pivots @ unit(m).T if pivots is not None and len(pivots) else None
        self.least = np.arccos(np.clip(self.to_pivots.max(0), -1, 1)) if self.to_pivots is not None else None
        self.cell, self.near, self.angle = None, np.zeros(0, np.int64), np.zeros(0)

    def reaching(self, cell: int, low: float, high: float) -> np.ndarray:
        """Queries that may have a partner at angles from low to high of a cell."""
        if self.to_pivots is None or cell < 0:
            return np.arange(len(self.place))
        if cell != self.cell:
            own = np.arccos(np.clip(self.to_pivots[cell], -1, 1))
            near = np.flatnonzero((own <= self.least + 2 * self.reach + SLACK) & (self.scale > 0))
            order = np.argsort(own[near])
            self.cell, self.near, self.angle = cell, near[order], own[near[order]]
        return self.near[np.searchsorted(self.angle, low - self.reach - SLACK) : np.searchsorted(self.angle, high + self.reach + SLACK, "right")]


def _hits(some: Queries, pick: np.ndarray, m: np.ndarray, seq: np.ndarray, best: Best) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, score) of each picked query's best k rows that can be among its best so far."""
    size = np.sqrt((m * m).sum(1))
    for low in range(0, len(pick), PRODUCT):
        own = pick[low : low + PRODUCT]
        scale = some.scale[own][:, None] * size[None]
        score = np.divide(dots(some.m[own], m), scale, out=np.zeros_like(scale), where=scale > 0)
        good = (score >= best.bound[some.place[own]][:, None]) & (seq[None] <= some.last[own][:, None])
        q, r = first_hits(score, good, best.k)
        yield some.place[own[q]], r, score[q, r]


def threshold_join(store: DataFrame, asks: DataFrame, threshold: float, k: int, work: Work | None = None, query_values: int = QUERY_VALUES, pivots: int = PIVOTS) -> DataFrame:
    """(query, id, score, rank): of each query (query, embedding, last) the k best rows of the store (id, seq, embedding) with cosine ≥ threshold and seq ≤ last.

    Ties by id; a null ``last`` is no bound. The join runs, in parts, while its plan is made: its result is staged and
    ``work`` is filled.
    """
    spark = store.sparkSession
    importable(spark)
    held = store.where(F.col("embedding").isNotNull())
    asked = asks.where(F.col("embedding").isNotNull()).select("query", "embedding", F.coalesce(F.col("last").cast("long"), F.lit(2**63 - 1)).alias("last"))
    known = pivots_of(held, pivots) if threshold > 0 else {}
    placed = _placed(held, known)
    size = asked.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0)).alias("values"), F.count("*").alias("n")).first()
    blocks = max(1, -(-(size["values"] + size["n"] * sum(map(len, known.values()))) // query_values))
    if blocks > 1:  # in ranges of blocks: a block reads its own row groups
        asked = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
        asked = stage(asked.repartitionByRange("block").sortWithinPartitions("block"), "pivot-queries")
    reach = float(np.arccos(min(1.0, threshold))) if threshold > 0 else np.pi
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((asked, "query"), (held, "id"))]
    found = []
    for number in range(blocks if size["n"] else 0):
        own = (asked if blocks == 1 else asked.where(F.col("block") == number)).toArrow()
        shared = spark.sparkContext.broadcast((own["query"].combine_chunks(), own["embedding"].combine_chunks(), own["last"].to_numpy(), known))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, vectors, last, known = shared.value
            some = {m.shape[1]: Queries(place, m, last[place], known.get(m.shape[1]), reach) for place, m in by_size(vectors)}
            best, compared = None, 0
            for batch in batches:
                ids = batch.column(0)
                best = best or Best(len(names), k, threshold, ids.type)
                turn = np.asarray(pc.rank(ids, tiebreaker="first"))
                cells, angle, seq = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(1).cast(pa.int64()).to_numpy(zero_copy_only=False)
                for mine, m in by_size(batch.column(2)):
                    if m.shape[1] not in some:
                        continue
                    asked = some[m.shape[1]]
                    for run_ in _runs(cells[mine]):
                        at = angle[mine[run_]]
                        pick = asked.reaching(int(cells[mine[run_[0]]]), at.min(), at.max())
                        compared += len(pick) * len(run_)
                        run_ = run_[np.argsort(turn[mine[run_]])]
                        for q, r, s in _hits(asked, pick, m[run_], seq[mine[run_]], best):
                            best.add(q, ids.take(pa.array(mine[run_[r]])), s)
                if threshold <= 0:  # vectors of other dimensions have cosine 0
                    for q, r in _others(vectors, batch.column(2), seq, last, np.argsort(turn), k):
                        best.add(q, ids.take(pa.array(r)), np.zeros(len(q)))
                best.merge()
            if best is not None:
                out = [names.take(pa.array(best.q)), best.ids, pa.array(best.s), pa.nulls(len(best.q), pa.int64())]
                count = [pa.nulls(1, out[0].type), pa.nulls(1, out[1].type), pa.nulls(1, pa.float64()), pa.array([compared])]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(out, count, strict=True)], names=["query", "id", "score", "compared"])

        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id")))
        met = stage(placed.mapInArrow(run, f"query {kinds[0]}, id {kinds[1]}, score double, compared long"), "pivot-hits")
        shared.destroy()
        if work is not None:
            work.blocks.append(met.agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("n")).first()["n"])
            work.compared += work.blocks[-1]
        hits = met.where("compared is null").withColumn("rank", rank).where(F.col("rank") <= k).drop("compared")
        found.append(hits)
    if work is not None:
        work.possible += placed.count() * size["n"]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], f"query {kinds[0]}, id {kinds[1]}, score double, rank int")


def _runs(cells: np.ndarray) -> Iterator[np.ndarray]:
    """Places of at most RUN rows of one cell; angles of a run are close, as rows come sorted by them."""
    for one in np.split(np.arange(len(cells)), np.flatnonzero(np.diff(cells)) + 1):
        for low in range(0, len(one), RUN):
            yield one[low : low + RUN]


def _others(vectors: pa.Array, rows: pa.Array, seq: np.ndarray, last: np.ndarray, order: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) of different dimensions, which have score 0: the first k of each query in the order of ids."""
    size, own = np.asarray(rows.value_lengths().fill_null(-1))[order], np.asarray(vectors.value_lengths())
    for i in range(len(own)):
        at = order[(size >= 0) & ((size != own[i]) | (size == 0)) & (seq[order] <= last[i])][:k]
        yield np.full(len(at), i), at
