"""Conversation structure repair: the cheapest edits that give a conversation legal turns.

Legal role initials are ``(s?(ua)+)?``: a grammar of four states (nothing yet, after the
system turn, after a user turn, after an assistant turn). For each turn and each
increasing cost there is a bitset of the states from which the rest of the conversation
can be accepted at that cost. The first layer that holds the start state at the first
turn is the cost; the least audit is read off the bitsets turn by turn, always by the
ASCII-least edit whose layer holds the state that it leads to.

The layers of a turn differ from those of another one by a cost that all have in common
and are otherwise one of a few patterns: patterns are kept once, with the pattern that
each kind of turn leads to. So a conversation takes time and memory with its turns, not
with turns times costs.

As Spark jobs: turns are reduced to a byte of role and fault and two hashes. Equal turns
are counted before they are shuffled. The first of equal turns is found by grouping and
sent along the others as a marker. Turns are sorted in ranges of (conversation, turn),
so a long conversation is many tasks' work; each task sends runs of bytes. A
conversation's bytes, as many as its audit has letters, are joined and solved. The turns
then stream past their audits, a row at a time.

Odd input: null roles and texts are one space, as are null ids where the damage hashes
them. Null turns come first. Turns of one number follow by a hash of role and text.
A null conv_id is a conversation. Roles of other initials are never legal and are
rewritten or deleted. Empty table: empty result. Columns are read by name, others are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.llm.plumbing import lean, prepare, record, stage

KEEP, DELETE, REROLE, INSERT, TRUNCATED = 0, 4, 3, 3, 3
#: What the contract of blank texts calls white space.
SPACES = " \t\n\x0b\x0c\r"
#: Bits of a turn's byte: role initial, fault.
INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER = 3
SOUND, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: Grammar: state → initial → state. 0 nothing yet, 1 after s, 2 after u, 3 after a.
NEXT = {0: {0: 1, 1: 2}, 1: {1: 2}, 2: {2: 3}, 3: {1: 2}}
#: The role that a new or rewritten turn takes in each state, and the state after it.
ROLE, AFTER = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
ACCEPT = 0b1001
ALL = 0b1111


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows as the hash of `conv_id:turn` damages them; copies 0: dropped, 2: repeated."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), what.alias("what"))
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("what") == 0, 0).when(F.col("what") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def keyed(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, copies) with h1, h2 (hashes of role and text) and code (role initial, fault of its own)."""
    trimmed = F.rtrim("text", F.lit(SPACES))
    fault = F.when(trimmed == "", BLANK).when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), SOUND).otherwise(CUT)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", INITIALS["s"]).when(initial == "u", INITIALS["u"]).when(initial == "a", INITIALS["a"]).otherwise(OTHER)
    return rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64("text", F.lit("|"), "role"), "code": (role + 4 * fault).cast("int")})


def runs_of(turns: DataFrame) -> DataFrame:
    """(conv_id, part, number, codes, turns, low, high): runs of the bytes of a conversation's turns in order, and what they say of turn numbers."""
    counted = stage(turns.groupBy("conv_id", "turn", "h1", "h2", "code").agg(F.sum("copies").cast("long").alias("n")), "repair-turns")
    lowest = F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn")))
    first = counted.where("n > 0").groupBy("conv_id", "h1", "h2").agg(lowest.alias("l")).select("conv_id", "l.turn", "h1", "h2", F.lit(0).alias("code"), F.lit(-1).cast("long").alias("n"))
    order = ["conv_id", "turn", "h1", "h2"]
    ranged = counted.unionByName(first).repartitionByRange(*order).sortWithinPartitions(*order, "n")
    kind = turns.schema["conv_id"].dataType
    fields = {"conv_id": to_arrow_type(kind), "part": pa.int64(), "number": pa.int64(), "codes": pa.binary(), "turns": pa.int64(), "low": pa.int64(), "high": pa.int64()}
    out = pa.schema(list(fields.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, marked = TaskContext.get().partitionId(), 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy()
            # A marker stands right before the turn that is the first of equal ones.
            first = np.concatenate([[marked], n[:-1] == -1])
            marked = bool(n[-1] == -1)
            own = n >= 0
            if not own.any():
                continue
            some, n, first = batch.filter(pa.array(own)), n[own], first[own]
            code, turn = some.column("code").to_numpy(), some.column("turn")
            ends = pc.run_end_encode(some.column("conv_id")).run_ends.to_numpy()
            starts = np.concatenate([[0], ends[:-1]])
            at = np.cumsum(n) - n
            codes = np.repeat(code, n).astype(np.uint8)
            again = np.ones(len(codes), bool)
            again[at[first & (n > 0)]] = False
            codes[again & (codes >> 2 != BLANK)] = codes[again & (codes >> 2 != BLANK)] & 3 | DUPLICATE << 2
            edges = np.concatenate([at, [len(codes)]])[np.concatenate([starts, [ends[-1]]])].astype(np.int32)
            told = np.flatnonzero((n > 0) & turn.is_valid().to_numpy(zero_copy_only=False))
            number_of = turn.cast(pa.int64()).fill_null(0).to_numpy()[told]
            run_of = np.searchsorted(ends, told, "right")
            fresh = np.ones(len(told), bool)
            fresh[1:] = (run_of[1:] != run_of[:-1]) | (number_of[1:] != number_of[:-1])
            distinct = np.bincount(run_of[fresh], minlength=len(ends))
            low, high = np.searchsorted(run_of, np.arange(len(ends))), np.searchsorted(run_of, np.arange(len(ends)), "right") - 1
            none = pa.array(distinct == 0)
            bound = lambda where: pc.if_else(none, pa.scalar(None, pa.int64()), pa.array(number_of[np.clip(where, 0, len(told) - 1)] if len(told) else np.zeros(len(ends), np.int64)))  # noqa: E731, B023
            texts = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(edges), pa.py_buffer(codes)])
            yield record(out, some.column("conv_id").take(pa.array(starts)), np.full(len(ends), part), number + np.arange(len(ends)), texts, distinct.astype(np.int64), bound(low), bound(high))
            number += len(ends)

    prepare(turns.sparkSession)
    return ranged.mapInArrow(lean(run), f"conv_id {kind.simpleString()}, part long, number long, codes binary, turns long, low long, high long")


class Layers:
    """Cost layers by pattern: bitsets of states for costs of 0, 1, 2 … above a pattern's own least, up to the layer that holds all."""

    def __init__(self):
        self.patterns: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, ...], int] = {}
        self.led: dict[tuple[int, int], tuple[int, int]] = {}
        # States that a letter leads into each set of states: inserted or rewritten turns, kept ones.
        self.before_new = [sum(1 << q for q in range(4) if s >> AFTER[q] & 1) for s in range(16)]
        self.before = [[sum(1 << q for q in range(4) if (t := NEXT[q].get(x)) is not None and s >> t & 1) for s in range(16)] for x in range(4)]
        self.end = self._pattern(self._with_inserts(lambda c: ACCEPT))[0]

    def _with_inserts(self, base) -> list[int]:
        """Layers of what ``base`` gives for each cost, and of inserts before it."""
        out: list[int] = []
        while not out or out[-1] != ALL:
            c = len(out)
            out.append(base(c) | (out[-1] if out else 0) | (self.before_new[out[c - INSERT]] if c >= INSERT else 0))
        return out

    def _pattern(self, layers: list[int]) -> tuple[int, int]:
        """(number of the pattern, its least cost)."""
        least = next(c for c, s in enumerate(layers) if s)
        key = tuple(layers[least:])
        if key not in self.known:
            self.known[key] = len(self.patterns)
            self.patterns.append(key)
        return self.known[key], least

    def at(self, pattern: int, cost: int) -> int:
        """States of a pattern's layer."""
        layers = self.patterns[pattern]
        return 0 if cost < 0 else layers[min(cost, len(layers) - 1)]

    def step(self, pattern: int, code: int) -> tuple[int, int]:
        """(pattern, cost above) before a turn whose rest has a pattern."""
        if (pattern, code) not in self.led:
            initial, fault = code & 3, code >> 2
            extra = TRUNCATED if fault == CUT else 0

            def base(c: int) -> int:
                found = self.at(pattern, c - DELETE)
                if fault in (SOUND, CUT):
                    found |= self.before[initial][self.at(pattern, c - KEEP - extra)] | self.before_new[self.at(pattern, c - REROLE - extra)]
                return found

            self.led[pattern, code] = self._pattern(self._with_inserts(base))
        return self.led[pattern, code]

    def solve(self, codes: bytes) -> tuple[int, str]:
        """(least cost, ASCII-least audit of that cost)."""
        pattern, least, trail = self.end, 0, [(self.end, 0)]
        for code in reversed(codes):
            pattern, more = self.step(pattern, code)
            least += more
            trail.append((pattern, least))
        left = next(c for c, s in enumerate(self.patterns[pattern]) if s & 1) + least
        cost, state, audit, i = left, 0, [], 0
        while i < len(codes) or not (ACCEPT >> state & 1 and left == 0):
            here, base = trail[len(codes) - i]
            if i < len(codes):
                rest, rest_base = trail[len(codes) - i - 1]
                code = codes[i]
                initial, fault = code & 3, code >> 2
                extra = TRUNCATED if fault == CUT else 0
                if self.at(rest, left - DELETE - rest_base) >> state & 1:
                    audit.append("D")
                    left, i = left - DELETE, i + 1
                    continue
            if self.at(here, left - INSERT - base) >> AFTER[state] & 1:
                audit.append("I")
                left, state = left - INSERT, AFTER[state]
                continue
            kept = NEXT[state].get(initial)
            if kept is not None and self.at(rest, left - KEEP - extra - rest_base) >> kept & 1:
                audit.append("K")
                left, state, i = left - KEEP - extra, kept, i + 1
            else:
                audit.append("R")
                left, state, i = left - REROLE - extra, AFTER[state], i + 1
        return cost, "".join(audit)


#: Pairs of role initials that may follow each other: su, ua, au.
_LEGAL = np.zeros(16, bool)
_LEGAL[[0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]] = True
_REPORT = {"gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string()}
_REPORT_KINDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plans(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of keyed rows."""
    kind = rows.schema["conv_id"].dataType
    out = pa.schema([("conv_id", to_arrow_type(kind)), *_REPORT.items()])

    def told(layers: Layers, parts: list[tuple]) -> tuple:
        codes = b"".join(p[0] for p in parts)
        byte = np.frombuffer(codes, np.uint8)
        faults = np.bincount(byte >> 2, minlength=4)
        initial = byte & 3
        illegal = int((~_LEGAL[initial[:-1] * 4 + initial[1:]]).sum())
        numbered = [p for p in parts if p[1]]
        distinct = sum(p[1] for p in numbered) - sum(a[3] == b[2] for a, b in zip(numbered[:-1], numbered[1:], strict=True))
        gaps = numbered[-1][3] - numbered[0][2] + 1 - distinct if numbered else 0
        return (min(gaps, 2**63 - 1), int(faults[BLANK]), int(faults[DUPLICATE]), int(faults[CUT]), illegal, *layers.solve(codes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers, parts, key = Layers(), [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = pc.run_end_encode(batch.column("conv_id")).run_ends.to_pylist()
            values = list(zip(*(batch.column(c).to_pylist() for c in ("codes", "turns", "low", "high")), strict=True))
            keys, done, start = [], [], 0
            for end in ends:
                own = batch.column("conv_id").slice(start, 1)
                if key is not None and not own.equals(key):
                    keys.append(key)
                    done.append(told(layers, parts))
                    parts = []
                key = own
                parts += values[start:end]
                start = end
            if done:
                yield record(out, pa.concat_arrays(keys), *map(list, zip(*done, strict=True)))
        if key is not None:
            yield record(out, key, *([v] for v in told(layers, parts)))

    order = ["conv_id", "part", "number"]
    return runs_of(rows).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(lean(run), f"conv_id {kind.simpleString()}, {_REPORT_KINDS}")


def edited(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns, as an audit edits some turns."""
    state = 0
    for edit in audit:
        if edit == "I":
            yield edit, ROLE[state], ""
            state = AFTER[state]
            continue
        role, text = next(turns)
        if edit == "K":
            yield edit, role, text
            state = NEXT[state][INITIALS[role[0]]]
        elif edit == "R":
            yield edit, ROLE[state], text
            state = AFTER[state]


def _met(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Each conversation's plan, then its turns in order, conversation by conversation in each task."""
    blank = {f.name: F.lit(None).cast(f.dataType) for f in planned.schema if f.name != "conv_id"}
    turns = rows.where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "h1", "h2", "role", "text", "copies", *(v.alias(k) for k, v in blank.items()))
    heads = planned.select("conv_id", F.lit(0).alias("kind"), *(F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in ("turn", "h1", "h2", "role", "text", "copies")), *blank)
    return heads.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "h1", "h2")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[str, str, str]]]]:
    """(row of the plan, its repaired turns) of each conversation; the turns of one must be read before the next is asked for."""
    held: list[pa.RecordBatch] = []

    def steps() -> Iterator[tuple[int, int, str, str, int, str]]:
        for batch in batches:
            held[:] = [batch]
            yield from zip(range(batch.num_rows), *(batch.column(c).to_pylist() for c in ("kind", "role", "text", "copies", "audit")), strict=True)

    rows = steps()
    ahead = next(rows, None)

    def turns() -> Iterator[tuple[str, str]]:
        nonlocal ahead
        while (ahead := next(rows, None)) is not None and ahead[1] == 1:
            for _ in range(ahead[4]):
                yield ahead[2], ahead[3]

    while ahead is not None:
        head, audit, own = held[0].slice(ahead[0], 1), ahead[5], turns()
        yield head, edited(audit, own)
        for _ in own:  # read on to the next plan
            pass


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of each repaired conversation of rows (conv_id, turn, role, text, copies) in order."""
    turns = keyed(rows)
    kind = turns.schema["conv_id"].dataType
    out = pa.schema([("conv_id", to_arrow_type(kind)), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, made in _conversations(batches):
            some: list[tuple] = []
            for place, turn in enumerate(made):
                some.append((place, *turn))
                if len(some) == 1000:
                    yield _rows(out, head, some)
                    some = []
            if some:
                yield _rows(out, head, some)

    prepare(turns.sparkSession)
    return _met(turns, plans(turns)).mapInArrow(lean(run), f"conv_id {kind.simpleString()}, place long, edit string, role string, text string")


def _rows(out: pa.Schema, head: pa.RecordBatch, some: list[tuple]) -> pa.RecordBatch:
    return record(out, head.column("conv_id").take(pa.array([0] * len(some))), *map(list, zip(*some, strict=True)))


def repair_report(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of rows (conv_id, turn, role, text, copies)."""
    turns = keyed(rows)
    kind = turns.schema["conv_id"].dataType
    out = pa.schema([("conv_id", to_arrow_type(kind)), *_REPORT.items(), ("repaired_sha256", pa.string())])

    def digest(made: Iterator[tuple[str, str, str]]) -> str:
        h, mark = hashlib.sha256(), ""
        for _, role, text in made:
            h.update(f"{mark}{role}:{text}".encode())
            mark = "\n"
        return h.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, found = [], []
        for head, made in _conversations(batches):
            heads.append(head.select(["conv_id", *_REPORT]))
            found.append(digest(made))
            if len(heads) == 1000:
                yield record(out, *pa.Table.from_batches(heads).columns, found)
                heads, found = [], []
        if heads:
            yield record(out, *pa.Table.from_batches(heads).columns, found)

    prepare(turns.sparkSession)
    return _met(turns, plans(turns)).mapInArrow(lean(run), f"conv_id {kind.simpleString()}, {_REPORT_KINDS}, repaired_sha256 string")
