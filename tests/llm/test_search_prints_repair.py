"""Ranked search, fingerprints and conversation repair against brute force, on odd tables too."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.llm import conversation_repair as R
from docloom.llm import fingerprints as P
from docloom.llm import threshold_search as S

# ------------------------------------------------------------------ ranked search


def _ranked(docs: list[tuple], items: list[tuple], k: int) -> set[tuple]:
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    held = [(d, words(t)) for d, t in docs]
    n, total = sum(1 for _, w in held if w), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    asks: dict = {}
    for i, t in items:
        asks.setdefault(i, set()).update(words(t))
    out = set()
    for i, terms in asks.items():
        scored = []
        for d, w in held:
            tf = Counter(w)
            m = 10 + (90 * len(w) * n) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if score > 0:
                scored.append((-score, d is None, d))
        out |= {(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])}
    return out


@pytest.mark.parametrize("shard, first, blocks", [(2_000_000, 16, 1_000_000), (40, 1, 7)])
def test_threshold_search_equals_brute_force(spark, monkeypatch, shard, first, blocks):
    """Ties, repeated rows, nulls, empty texts, a hot word, clashing columns; shards and turns of a few postings."""
    monkeypatch.setattr(S, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(S, "FIRST_TURN", first)
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["The", "é2", "a_b", "x" + str(rng.randint(0, 30))]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(150)] + [(7, "x1 x2"), (7, "x1 x2"), (None, "x1 x2"), (500, None), (501, ""), (502, "!?")]
    docs += [(600 + i, docs[3][1]) for i in range(15)]
    items = [(1, text(12)), (2, text(30)), (2, "x1"), (3, None), (4, "..."), (5, "nowhere"), (None, "X1 the"), (6, docs[3][1])]
    frame = spark.createDataFrame([(d, t, "t", 1) for d, t in docs], "doc_id long, text string, term string, score int").repartition(3)
    asks = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id int, text string, doc_id int")
    found = S.search(frame, asks, 10, blocks)
    assert [f.simpleString() for f in found.schema] == ["item_id:int", "rank:int", "doc_id:bigint", "score:bigint"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == _ranked(docs, items, 10)


def test_threshold_search_stops_before_the_lists_end():
    """A posting list of 10,000 is left once its next posting cannot reach the k-th score."""
    import numpy as np

    n = 10_000
    counts = np.ones(n, np.int64)
    counts[:20] = 50
    part = S.Shard(np.full(n, 100), np.arange(n + 1), np.zeros(n, np.int64), counts, np.array([700]), np.full(n, 100))
    looked = []
    look = part.look_up
    part.look_up = lambda docs, wanted: looked.append(len(docs)) or look(docs, wanted)
    found, _ = part.search(np.array([0]), np.array([True]), 0, 10)
    assert set(found) == set(range(20)) and sum(looked) < 100


def test_threshold_search_on_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert S.search(docs, items).count() == 0
    assert S.search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


# ------------------------------------------------------------------ fingerprints


def _kept(t: str) -> list[tuple[int, int]]:
    codes, size = [ord(c) for c in t], min(len(t), P.GRAM)
    hashes = []
    for i in range(len(t) - size + 1 if t else 0):
        h = 0
        for x in codes[i : i + size]:
            h = (h * P.BASE + x) % P.PRIME
        hashes.append(h)
    window = min(P.WINDOW, len(hashes))
    chosen = {min((hashes[j], -j) for j in range(i, i + window)) for i in range(len(hashes) - window + 1)} if hashes else set()
    return sorted(((-j, h) for h, j in chosen))


def _text_of(keys: list[tuple[int, int]]) -> str:
    return ",".join(f"{(p - (keys[i - 1][0] if i else 0)) * 2**31 + h:X}" for i, (p, h) in enumerate(keys))


def _alike(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> float:
    x, y = {h for _, h in a}, {h for _, h in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def _texts(rng: random.Random) -> list[str | None]:
    out: list[str | None] = [None, "", "a", "ab", "😀" * 30]
    for _ in range(120):
        size = rng.choice([0, 1, 5, 7, 8, 9, 22, 23, 24, 60, 91, 92, 93, 94, 120, 150, 200, 333]) + rng.randint(0, 3)
        out.append("".join(rng.choice(rng.choice(["ab", "abcdefghij é😀ß", "xyz \n"])) for _ in range(size)))
    return [*out, "q é" * 12_000, "q é" * 12_000, "".join(rng.choice("abc d") for _ in range(40_000))]


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(5)
    texts = _texts(rng)
    rows = [(3 * i - 50, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, range int, kept string").repartition(4)
    found = {r["doc_id"]: r for r in P.fingerprint_report(frame).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    assert len(found) == len(rows)
    for i, (d, t) in enumerate(order):
        text, following = t or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        other = text[: len(text) - third] + following[:third]
        a, b, c = _kept(text), _kept(other), _kept(following)
        expected = (d, len(text), hashlib.sha256(other.encode()).hexdigest(), _text_of(a), _text_of(b), _alike(a, b), _alike(a, c))
        assert tuple(found[d]) == expected


def test_fingerprints_of_null_and_repeated_ids(spark):
    """Every row has a result; a null id is last, so its next row is the first one."""
    rows = [(5, "five five five five"), (5, "other text of five"), (5, "other text of five"), (None, "no id here at all"), (9, "nine nine nine nine")]
    found = P.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 5
    last = next(r for r in found if r["doc_id"] is None)
    assert last["edited_sha256"] == hashlib.sha256(("no id here at all"[:12] + "nine nine"[:5]).encode()).hexdigest()
    same = [r for r in found if r["fingerprint"] == _text_of(_kept("other text of five"))]
    assert len(same) == 2 and P.fingerprint_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = P.fingerprint_report(spark.createDataFrame([(1, "abcdefghijkl")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"abcdefghabcd").hexdigest()


def test_winnowing_guarantee(spark):
    """Texts that share GRAM + WINDOW - 1 characters in a row keep a common hash at the same place of the run."""
    rng = random.Random(11)
    rows = []
    for i in range(60):
        run = "".join(rng.choice("abcdef ") for _ in range(P.SPAN))
        pads = ["".join(rng.choice("uvwxyz") for _ in range(rng.randint(0, 40))) for _ in range(4)]
        rows += [(2 * i, pads[0] + run + pads[1], len(pads[0])), (2 * i + 1, pads[2] + run + pads[3], len(pads[2]))]
    keys = F.transform("kept", lambda k: F.struct(P.place(k).alias("p"), P.hash_of(k).alias("h")))
    found = {r["doc_id"]: r["k"] for r in P.fingerprints(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).select("doc_id", keys.alias("k")).collect()}
    for i in range(60):
        a, b = ({(k["p"] - start, k["h"]) for k in found[d] if 0 <= k["p"] - start <= P.WINDOW - 1} for d, _, start in rows[2 * i : 2 * i + 2])
        assert a & b


def test_fingerprints_stay_in_the_jvm(spark):
    plan = P.fingerprint_report(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ------------------------------------------------------------------ conversation repair


def _cheapest(codes: bytes) -> tuple[int, str]:
    """Dijkstra over (turn, state) with the audit in the key: the first accepting pair is the cheapest, then the least."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(codes) and q in (0, 3):
            return cost, audit
        heapq.heappush(heap, (cost + 3, audit + "I", i, R.AFTER[q]))
        if i < len(codes):
            initial, fault = codes[i] & 3, codes[i] >> 2
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q))
            if fault in (R.SOUND, R.CUT):
                extra = 3 if fault == R.CUT else 0
                if initial in R.NEXT[q]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, R.NEXT[q][initial]))
                heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, R.AFTER[q]))
    raise AssertionError


def test_layers_give_the_cheapest_and_least_audit():
    rng = random.Random(2)
    layers = R.Layers()
    for _ in range(3000):
        weights = rng.choice([(9, 1, 1, 1), (1, 1, 1, 9), (1, 1, 1, 1)])
        codes = bytes(rng.randint(0, 3) + 4 * rng.choices([0, 1, 2, 3], weights)[0] for _ in range(rng.randint(0, 14)))
        assert layers.solve(codes) == _cheapest(codes)
    assert len(layers.patterns) < 100  # a handful, however many turns are solved


def _report(rows: list[tuple]) -> dict:
    """The contract's result by plain Python; rows: (conv_id, turn, role, text)."""
    text = lambda v: " " if v is None else str(v)
    convs: dict = {}
    for conv, turn, role, body in rows:
        some = convs.setdefault(conv, [])
        role, body = text(role), text(body)
        what = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        if what == 0:
            continue
        body = "" if what == 1 else re.sub("[.!?]", "", body) if what == 2 else body
        some += [(turn, "user" if what == 4 else role, body)] * (2 if what == 3 else 1)
    out = {}
    for conv, some in convs.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults, codes = set(), Counter(), bytearray()
        for _, role, body in some:
            bare = body.strip(R.SPACES)
            fault = R.BLANK if not bare else R.DUPLICATE if (role, body) in seen else R.SOUND if bare[-1] in ".!?" else R.CUT
            seen.add((role, body))
            faults[fault] += 1
            codes.append(R.INITIALS.get(role[:1], R.OTHER) + 4 * fault)
        turns = {t for t, _, _ in some if t is not None}
        cost, audit = _cheapest(bytes(codes))
        made, state, at = [], 0, iter(some)
        for edit in audit:
            row = None if edit == "I" else next(at)
            if edit == "D":
                continue
            role = row[1] if edit == "K" else R.ROLE[state]
            made.append(f"{role}:{row[2] if row else ''}")
            state = R.NEXT[state][R.INITIALS[role[0]]]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(some[:-1], some[1:], strict=True))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults[R.BLANK], faults[R.DUPLICATE], faults[R.CUT], illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def _talks(rng: random.Random) -> list[tuple]:
    rows = []
    for conv in [None, *range(80)]:
        turn, said = rng.randint(-3, 3), [f"Words {rng.randint(0, 3)}." for _ in range(3)]
        for _ in range(rng.randint(1, 15)):
            turn += rng.choice([1, 1, 1, 2])
            body = rng.choice([*said, "Cut off", " \t", "", None, "Done!  \n", "Line ", "é?"])
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "a"]), body))
    return [*rows, (900, None, "user", "No number."), (900, 4, "assistant", "Four."), (901, None, "user", "All null.")]


def test_repair_equals_brute_force(spark):
    rng = random.Random(9)
    rows = _talks(rng)
    # One conversation of many turns spans several ranges.
    rows += [(1000, i, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"Turn {i}.", f"Turn {i}"])) for i in range(3000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, kind int, audit string").repartition(5)
    found = R.repair_report(R.damaged(frame)).collect()
    assert len(found) == len({r["conv_id"] for r in found})
    expected = _report(rows)
    assert {r["conv_id"]: tuple(r)[1:] for r in found} == expected


def test_repaired_turns_are_legal_and_follow_the_audit(spark):
    rows = _talks(random.Random(4))
    frame = R.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns: dict = {}
    for r in R.repaired_turns(frame).orderBy("conv_id", "place").collect():
        turns.setdefault(r["conv_id"], []).append(r)
    for r in R.repair_report(frame).collect():
        own = turns.get(r["conv_id"], [])
        assert [t["place"] for t in own] == list(range(len(own)))
        assert "".join(t["edit"] for t in own) == r["audit"].replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in own))
        assert hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in own).encode()).hexdigest() == r["repaired_sha256"]


def test_repair_of_dropped_and_empty_tables(spark):
    gone = next(i for i in range(200) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 1, "user", "Dropped.")], "conv_id long, turn long, role string, text string")
    assert tuple(R.repair_report(R.damaged(one)).first()) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert R.repair_report(R.damaged(one.limit(0))).count() == 0
