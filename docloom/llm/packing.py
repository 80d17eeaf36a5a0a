"""Best-fit sequence packing after Martello-Toth dominance reduction.

Documents longer than a sequence are cut into full sequences; only the first piece
may be shorter. What is left to pack are pieces shorter than a sequence, and only
their lengths matter. So the plan is made on the histogram of lengths, which has at
most ``capacity`` entries whatever the number of documents, and whole runs of equal
sequences are placed at once.

Dominance (Martello and Toth): a feasible set of pieces that contains the longest
open piece is fixed in a sequence for good when every other feasible set around that
piece could be exchanged for it without needing more sequences. The sets tried are
the piece alone, with one and with two others. Lengths for which no set dominates
are packed best-fit decreasing with everything that remains.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import bpe
from docloom.llm.plumbing import lean, prepare, record, stage
from docloom.llm.textcore import buffers

CAPACITY = 2048
END_ID = 0


@dataclass
class Plan:
    """Rows (length, first rank, pieces, first sequence, offset): ranks first…first+pieces-1 of a length go to as many sequences in a row."""

    capacity: int
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    fixed: int = 0
    taken: dict[int, int] = field(default_factory=dict)

    def place(self, length: int, pieces: int, sequence: int, offset: int) -> None:
        rank = self.taken.get(length, 0)
        self.rows.append((length, rank, pieces, sequence, offset))
        self.taken[length] = rank + pieces

    def open(self, sequences: int) -> int:
        self.sequences += sequences
        return self.sequences - sequences


class _Lengths:
    """The open pieces: counts by length, with the lengths in order."""

    def __init__(self, histogram: dict[int, int]):
        self.count = {k: v for k, v in histogram.items() if v > 0}
        self.order = sorted(self.count)

    def take(self, length: int, pieces: int) -> None:
        self.count[length] -= pieces
        if not self.count[length]:
            del self.count[length]
            self.order.pop(bisect.bisect_left(self.order, length))

    def largest(self, most: int, spare: dict[int, int]) -> int | None:
        """The longest length ≤ most with a piece besides those in ``spare``."""
        i = bisect.bisect_right(self.order, most) - 1
        while i >= 0 and self.count[self.order[i]] <= spare.get(self.order[i], 0):
            i -= 1
        return self.order[i] if i >= 0 else None

    def smallest(self, n: int, spare: dict[int, int]) -> list[int]:
        out: list[int] = []
        for x in self.order:
            out += [x] * min(n - len(out), self.count[x] - spare.get(x, 0))
            if len(out) == n:
                break
        return out


def dominating_set(open_: _Lengths, length: int, capacity: int) -> list[int] | None:
    """The others of a set that dominates all feasible sets around ``length``; None: no set tried does.

    A set dominates another if the other's pieces can be dealt to distinct pieces of
    the set, each holding those dealt to it.
    """
    room, own = capacity - length, {length: 1}
    one = open_.largest(room, own)
    if one is None:
        return []  # nothing fits beside it
    if one == room:
        return [one]  # a full sequence
    few = open_.smallest(3, own)
    if len(few) < 2 or few[0] + few[1] > room:
        return [one]  # at most one other fits: the longest stands for any
    pair_room = room - one
    two = open_.largest(pair_room, {**own, one: own.get(one, 0) + 1})
    if two is None:
        return None
    if len(few) == 3 and sum(few) <= room:
        return None  # three others may fit: not tried
    # At most two others fit. Any feasible pair x ≥ y has x ≤ one; if the longest possible y is ≤ two, {one, two} holds it.
    for y in reversed(open_.order[: bisect.bisect_right(open_.order, room // 2)]):
        free = open_.count[y] - own.get(y, 0)
        if free < 1:
            continue
        if free > 1 or (x := open_.largest(room - y, {**own, y: own.get(y, 0) + 1})) is not None and x >= y:
            return [one, two] if y <= two else None
    return [one, two]


def reduce_by_dominance(plan: Plan, open_: _Lengths) -> None:
    """Fix dominating sets, longest piece first; lengths without one stay open."""
    for length in reversed(list(open_.order)):
        while open_.count.get(length):
            others = dominating_set(open_, length, plan.capacity)
            if others is None:
                break
            members = [length, *others]
            times = min(open_.count[x] // members.count(x) for x in members)
            first, offset = plan.open(times), 0
            for x in members:
                plan.place(x, times, first, offset)
                open_.take(x, times)
                offset += x
            plan.fixed += times


def best_fit_decreasing(plan: Plan, open_: _Lengths) -> None:
    """Each piece, longest first, into the fullest sequence that it fits; runs of equal sequences move together."""
    rooms: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}

    def add(room: int, first: int, many: int) -> None:
        if room not in runs:
            bisect.insort(rooms, room)
            runs[room] = []
        runs[room].append((first, many))

    for length in reversed(list(open_.order)):
        left = open_.count[length]
        open_.take(length, left)
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = plan.capacity // length
                add(plan.capacity, plan.open(many := -(-left // each)), many)
                continue
            room = rooms[i]
            first, many = runs[room].pop()
            now = min(many, left)
            if now < many:
                runs[room].append((first + now, many - now))
            if not runs[room]:
                del runs[room]
                rooms.pop(i)
            plan.place(length, now, first, plan.capacity - room)
            add(room - length, first, now)
            left -= now


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    plan, open_ = Plan(capacity), _Lengths(histogram)
    reduce_by_dominance(plan, open_)
    best_fit_decreasing(plan, open_)
    return plan


_PIECES = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("rank", pa.int64())])


def document_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in its partition."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = bpe.column_bpe(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j, ids, counts in coder.texts(data, offsets):
                ids, counts = bpe.with_end(ids, counts, end_id)
                many = -(-counts // capacity)
                owner = np.repeat(np.arange(len(counts)), many)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
                head = counts - (many - 1) * capacity
                length = np.where(piece == 0, head[owner], capacity)
                start = np.where(piece == 0, 0, head[owner] + (piece - 1) * capacity)
                where = (np.cumsum(counts) - counts)[owner] + start
                crc = [bpe.crc32(ids[a : a + n]) for a, n in zip(where.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                sizes = length[order]
                rank = np.empty(len(owner), np.int64)
                rank[order] = np.arange(len(owner)) - np.searchsorted(sizes, sizes) + seen[sizes]
                seen += np.bincount(length, minlength=capacity + 1)
                doc = batch.column(0).slice(i, j - i).take(pa.array(owner))
                yield record(_PIECES, np.full(len(owner), part), doc, piece.astype(np.int32), start, length, crc, rank)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(lean(run, tokenizer), "part long, doc_id long, piece int, start long, length long, ids_crc32 long, rank long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece.

    Defined results: a null text is empty and takes one token; repeated rows are
    packed each; an empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    pieces = stage(document_pieces(docs, tokenizer or bpe.tokenizer_path(), capacity, end_id), "pieces")
    sizes = pieces.groupBy("part", "length").agg(F.count("*").alias("pieces"))
    # At most `capacity` rows reach the driver.
    histogram = {r["length"]: r["pieces"] for r in sizes.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect()}
    plan = make_plan(histogram, capacity)
    before = F.coalesce(F.sum("pieces").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("part", "length", before.alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    rows = sorted(plan.rows)
    lengths, firsts, sequences, offsets = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 3, 4))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    # The plan's size is bounded by the lengths, not by the documents.
    shared = spark.sparkContext.broadcast((lengths, firsts, sequences, offsets))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts, sequences, offsets = shared.value
        begin = np.searchsorted(lengths, np.arange(capacity + 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            row = np.empty(len(length), np.int64)
            for size in np.unique(length):
                mine = np.flatnonzero(length == size)
                row[mine] = begin[size] + np.searchsorted(firsts[begin[size] : begin[size + 1]], rank[mine], "right") - 1
            yield record(schema, *(batch.column(k) for k in range(5)), sequences[row] + rank - firsts[row], offsets[row])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
