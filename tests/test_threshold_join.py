"""The pruned cosine join against brute force; how much it compares; linear entity scans; bounded co-occurrence."""

from __future__ import annotations

import numpy as np

from docloom.operators import threshold_join as J


def _brute(store, asks, threshold, k):
    out = set()
    for name, q, last in asks:
        scored = []
        for i, seq, v in store:
            if q is None or v is None or (last is not None and seq > last):
                continue
            a, b = np.array(q, float), np.array(v, float)
            scale = np.linalg.norm(a) * np.linalg.norm(b) if len(a) == len(b) else 0
            score = float(a @ b / scale) if scale else 0.0
            if score >= threshold:
                scored.append((-round(score, 9), i))
        out |= {(name, i, rank + 1) for rank, (_, i) in enumerate(sorted(scored)[:k])}
    return out


def test_threshold_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 8))
    made = [(centres[i % 6] + rng.standard_normal(8) * 0.3).tolist() for i in range(240)]
    store = [(f"v{i:03d}", i, v) for i, v in enumerate(made)] + [("zero", 500, [0.0] * 8), ("short", 501, [1.0, 2.0]), ("none", 502, None), ("same", 503, made[0]), ("twice", 504, (np.array(made[0]) * 2).tolist())]
    asks = [(f"q{i}", made[i * 7], None if i % 2 else 120) for i in range(30)] + [("z", [0.0] * 8, None), ("s", [1.0, 1.0], None), ("n", None, None)]
    held = spark.createDataFrame(store, "id string, seq long, embedding array<double>").repartition(4)
    asked = spark.createDataFrame(asks, "query string, embedding array<double>, last long")
    for threshold, k, values, pivots in ((0.9, 3, 10**6, 16), (0.5, 5, 64, 4), (0.99, 2, 10**6, 1), (-0.2, 3, 10**6, 8), (0.0, 400, 100, 8)):
        found = {(r["query"], r["id"], r["rank"]) for r in J.threshold_join(held, asked, threshold, k, None, values, pivots).collect()}
        assert found == _brute(store, asks, threshold, k), threshold
    assert J.threshold_join(held.limit(0), asked, 0.5, 3).count() == 0 == J.threshold_join(held, asked.limit(0), 0.5, 3).count()


def test_clusters_are_pruned_and_the_work_is_reported(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    rows = [(i, i, (centres[i % 40] + rng.standard_normal(16) * 0.02).tolist()) for i in range(4000)]
    held = spark.createDataFrame(rows, "id long, seq long, embedding array<double>")
    asks = held.where("id % 20 = 0").selectExpr("id as query", "embedding", "cast(null as long) as last")
    work = J.Work()
    found = J.threshold_join(held, asks, 0.95, 5, work)
    assert found.count() == 200 * 5 and work.possible == 200 * 4000
    assert 0 < work.share < 0.2 and sum(work.blocks) == work.compared


def _old_scan(text):
    """Each match against all claimed spans."""
    from docloom.operators import text as X

    found = []
    for kind, pattern, group in X._PATTERNS:
        for hit in pattern.finditer(text):
            a, b = hit.span(group)
            if not any(a < d and c < b for c, d, _ in found):
                found.append((a, b, kind))
    return [(a, b, kind) for a, b, kind in sorted(found)]


def test_entity_scan_equals_plain_one_and_is_linear():
    import random
    import time

    from docloom.operators.text import find_entities

    rng = random.Random(6)
    parts = ["Dr. Jane Smith", "Acme Corporation", "Python 3.12", "Berlin", '"Attention Is All You Need" (2017)', "Deep Neural Networks", "Schmidt GmbH", "of", "and the", ". ", ", ", "\n"]
    for _ in range(300):
        text = " ".join(rng.choices(parts, k=rng.randint(0, 30)))
        assert [(a, b, kind) for _, _, kind, a, b in find_entities(text)] == _old_scan(text)
    began = time.perf_counter()
    assert len(find_entities("Acme Corporation met Dr. Jane Smith. " * 40_000)) >= 80_000
    assert time.perf_counter() - began < 10


MENTION = "source string, section_id string, entity_id string, ord int, start_char int, end_char int"


def test_pairs_and_evidence_rows_equal_the_gathered_form(spark, monkeypatch):
    import random

    from docloom.operators import graph as G

    rng = random.Random(8)
    rows = [(rng.choice("de"), rng.choice(["s-1", "s-2", None]), f"e{rng.randint(0, 14):02d}", i, i, i + 1) for i in range(150)]
    found = spark.createDataFrame(rows, MENTION)
    whole = {(r["source_id"], r["target_id"]): [(e["source"], e["section_id"], e["ord"], e["entity_id"]) for e in r["evidence"]] for r in G.relationships(found).collect()}
    for block in (256, 3):
        monkeypatch.setattr(G, "PAIR_BLOCK", block)
        assert {(r["source_id"], r["target_id"]): r["evidence"] for r in G.related_pairs(found).collect()} == {p: len(e) for p, e in whole.items()}
        rows_ = {}
        for r in G.pair_evidence(found).orderBy("place").collect():
            rows_.setdefault((r["source_id"], r["target_id"]), []).append((r["source"], r["section_id"], r["ord"], r["entity_id"]))
        assert {p: sorted(map(str, e)) for p, e in rows_.items()} == {p: sorted(map(str, e)) for p, e in whole.items()}


def test_many_starts_walk_as_one(spark, monkeypatch):
    import random

    from docloom.operators import graph as G

    rng = random.Random(3)
    names = [f"n{i}" for i in range(80)]
    edges = [(rng.choice(names), rng.choice([*names, "missing"])) for _ in range(110)]
    n = spark.createDataFrame([(x,) for x in names], "id string")
    e = spark.createDataFrame(edges, "source_id string, target_id string")
    near = {}
    for a, b in edges:
        if "missing" not in (a, b):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def walk(start, depth):
        out, level = {start: 0}, [start]
        for d in range(1, depth + 1):
            level = [y for x in level for y in near.get(x, ()) if y not in out and not out.update({y: d})]
        return {(start, x, d) for x, d in out.items()}

    for starts, most in ((names[:70], 500), (names[:3], 0)):
        monkeypatch.setattr(G, "LOOKED_UP", most)
        got = {tuple(r) for r in G.many_distances(n, e, [*starts, "missing"], 3).collect()}
        assert got == set().union(*(walk(s, 3) for s in starts))


def test_equal_vectors_tie_wherever_they_stand(spark):
    """In a worker, to which Spark gives one BLAS thread."""

    def run(batches):
        import pyarrow as pa

        from docloom.operators import threshold_join as J

        for _ in batches:
            rng, odd = np.random.default_rng(2), []
            for d in (8, 64, 100):
                v, q = rng.standard_normal(d), rng.standard_normal((1024, d))
                whole = J.dots(q, np.tile(v, (1024, 1)))[:, 0]
                for nq in (1, 3, 17, 1000, 1024):
                    for nr in (1, 5, 9, 33, 517):
                        odd += [f"{d} {nq} {nr}" for part in (slice(0, nq), slice(-nq, None)) if not (J.dots(q[part], np.tile(v, (nr, 1))) == whole[part, None]).all()]
            yield pa.RecordBatch.from_arrays([pa.array(odd, pa.string())], names=["odd"])

    from docloom.runtime import importable

    importable(spark)
    assert spark.range(1, numPartitions=1).mapInArrow(run, "odd string").collect() == []


def test_first_hits_and_best_equal_a_sort():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    for k in (0, 1, 3):
        best, seen = J.Best(6, k, 1.0, pa.string()), []
        for start in (40, 0, 20):  # ids come in any order of parts
            score = rng.integers(0, 4, (6, 20)).astype(float)
            q, r = J.first_hits(score, score >= best.bound[:, None], k)
            best.add(q, pa.array([f"{start + i:02d}" for i in r]), score[q, r])
            best.merge()
            seen += [(i, -score[i, j], f"{start + j:02d}") for i in range(6) for j in range(20) if score[i, j] >= 1]
        want = [x for i in range(6) for x in sorted(s for s in seen if s[0] == i)[:k]]
        assert list(zip(best.q.tolist(), (-best.s).tolist(), best.ids.to_pylist(), strict=True)) == want


def test_blocks_of_queries_count_their_angles_to_the_pivots(spark):
    """Short vectors in many queries: a task holds more angles than values."""
    rng = np.random.default_rng(7)
    rows = [(i, i, rng.standard_normal(2).tolist()) for i in range(100)]
    held = spark.createDataFrame(rows, "id long, seq long, embedding array<double>")
    asks = held.selectExpr("id as query", "embedding", "cast(null as long) as last")
    work = J.Work()
    found = {(r["query"], r["id"], r["rank"]) for r in J.threshold_join(held, asks, 0.9, 3, work, 500, 8).collect()}
    assert found == _brute(rows, [(i, v, None) for i, _, v in rows], 0.9, 3)
    assert len(work.blocks) == 2
