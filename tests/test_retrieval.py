from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from docloom.operators import retrieval as R
from docloom.operators.threshold_join import threshold_join

SCHEMA = "id string, seq long, text string, embedding array<double>, source string, source_type string, metadata map<string,string>"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        ("doc.py::chunk_0", 0, "python is great", [1.0, 0.0, 0.0], "doc.py", "pdf", {"heading": "Intro"}),
        ("doc.py::chunk_1", 1, "rust is fast", [0.0, 1.0, 0.0], "doc.py", "pdf", {"heading": "Outro"}),
        ("other.md::chunk_0", 2, "java is okay", [0.9, 0.1, 0.0], "other.md", "markdown", {}),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_hybrid_order_filters_and_thresholds(corpus):
    q = [1.0, 0.0, 0.0]
    assert ids(R.hybrid_search(corpus, "python", q, 5)) == ["doc.py::chunk_0", "other.md::chunk_0", "doc.py::chunk_1"]
    assert ids(R.service_search(corpus, "python", lambda _: q, 5, filters={"source_type": "markdown"})) == ["other.md::chunk_0"]
    assert ids(R.hybrid_search(corpus, "python", q, 5, min_score=0.03)) == ["doc.py::chunk_0"]

    def broken(_):
        raise RuntimeError

    assert ids(R.service_search(corpus, "python", broken, 5)) == ["doc.py::chunk_0"]
    assert ids(R.service_search(corpus, "zzz", None, 5)) == []
    assert ids(R.service_search(corpus, "  ", None, 5)) == []
    assert ids(R.hybrid_search(corpus, "python", q, 0)) == []


def test_dense_zero_short_and_negative(spark):
    rows = spark.createDataFrame([("zero", 0, [0.0, 0.0]), ("dim", 1, [1.0]), ("live", 2, [1.0, 0.0])], "id string, seq long, embedding array<double>")
    assert ids(R.dense_search(rows, [1.0, 0.0], 5)) == ["live", "dim", "zero"]
    pair = spark.createDataFrame([("e1", 0, [1.0, 0.0]), ("e2", 1, [-1.0, 0.0])], "id string, seq long, embedding array<double>")
    assert ids(R.dense_search(pair, [1.0, 0.0], 5)) == ["e1"]
    assert ids(R.dense_search(pair, [1.0, 0.0], 5, -1.0)) == ["e1", "e2"]
    assert R.dense_search(pair, [1.0, 0.0], 0).count() == 0


def test_rrf_values(spark):
    legs = [spark.createDataFrame(rows, "id string, rank int") for rows in ([("a", 1), ("b", 2)], [("a", 1), ("c", 2)])]
    got = {r["id"]: r["rrf"] for r in R.rrf(legs).collect()}
    assert got == pytest.approx({"a": 2 / 61, "b": 1 / 62, "c": 1 / 62})
    again = spark.createDataFrame([("a", 1), ("a", 2)], "id string, rank int")
    assert R.rrf([again]).first()["rrf"] == pytest.approx(1 / 61 + 1 / 62)


def bm25(texts, query):
    """Okapi BM25 by the formula."""
    import re

    toks = [re.findall("[a-z0-9_]+", t.lower()) for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    out = {}
    for i, words in enumerate(toks):
        s = 0.0
        for q in set(re.findall("[a-z0-9_]+", query.lower())):
            tf, df = words.count(q), sum(q in w for w in toks)
            if tf:
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg))
        if s:
            out[i] = s
    return sorted(out, key=lambda i: (-out[i], i)), out


@pytest.mark.parametrize(
    ("texts", "query"),
    [
        (["python is great", "java is okay", "rust is fast"], "python"),
        (["python", "python", "python"], "python"),
        (["python zebra", "python " + " ".join(f"word{i}" for i in range(99))], "python"),
        (["python async", "python sync", "python only", ""], "python async python"),
    ],
)
def test_bm25_matches_the_formula(spark, texts, query):
    docs = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "seq long, id string, text string")
    got = R.bm25_search(docs, query, 10).orderBy("rank").collect()
    order, scores = bm25(texts, query)
    assert [r["seq"] for r in got] == order
    assert [r["score"] for r in got] == pytest.approx([scores[i] for i in order])
    assert R.bm25_search(docs, query, 0).count() == 0 and R.bm25_search(docs, "!!", 5).count() == 0


def test_batch_equals_single(spark):
    import random

    random.seed(3)
    rows = [(i, i, [random.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, seq long, embedding array<double>").repartition(5)
    asks = [(r[0], r[2]) for r in rows[:4]]
    batch = {(r["query"], r["rank"]): r["id"] for r in R.dense_batch(df, asks, 3).collect()}
    for name, q in asks:
        assert [batch[name, k] for k in (1, 2, 3)] == ids(R.dense_search(df, q, 3))


def test_batches_of_any_size_meet_all_rows(spark, monkeypatch):
    import random

    random.seed(4)
    rows = [(i, i, [random.gauss(0, 1) for _ in range(8)]) for i in range(90)] + [(90, 90, None), (91, 91, [1.0]), (92, 92, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, seq long, embedding array<double>").repartition(5)
    asks = df.where("id % 2 = 0").select(F.col("id").alias("query"), "embedding")
    get = lambda q: sorted((r["query"], r["rank"], r["id"], round(r["score"], 9)) for r in R.dense_batch(df, q, 3).collect())
    want = get(asks)
    assert len(want) == 3 * 46  # 45 whole vectors and the zero one; null asks nothing
    for values, block in ((10, 7), (10, 1000)):
        for name, value in (("QUERY_VALUES", values), ("BATCH_BLOCK", block), ("SCORE_BLOCK", 4)):
            monkeypatch.setattr(R, name, value)
        assert get(asks) == want
    assert get(asks.limit(0)) == []


def test_all_scores_have_no_row_cap(spark, tmp_path):
    from docloom.plans import catalog

    n = 100_030
    vector = F.array(F.when(F.col("vec_id") % 3 == 0, 1.0).otherwise(-1.0).cast("float"), (F.col("vec_id") % 7).cast("float"))
    spark.range(n).select(F.col("id").alias("vec_id"), vector.alias("embedding"), F.lit(0).alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["dense_negative_scores"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, n + 1)) and got[-1]["score"] < 0
    assert all((-a["score"], a["id"]) < (-b["score"], b["id"]) for a, b in zip(got, got[1:], strict=False))


def test_context_budget(spark):
    hits = spark.createDataFrame([(i, f"d{i}", "s", "x" * 5000, 0.03) for i in range(1, 101)], "rank int, id string, source string, text string, rrf double")
    kept = [len(r["kept"]) for r in R.context_blocks(hits).orderBy("rank").collect()]
    assert kept == [5000, 5000, 2000]
    assert len(R.build_context(hits).first()["context"]) <= 13_000


def test_cross_links_against_brute_force(spark, monkeypatch):
    import numpy as np

    # Several blocks of queries, few pivots.
    monkeypatch.setattr(R, "threshold_join", lambda *a: threshold_join(*a, query_values=20, pivots=4))
    rng = np.random.default_rng(5)
    rows = [(f"c{i:02d}", f"s{i // 4}", i % 4, i, rng.normal(size=3).tolist()) for i in range(40)]
    got = {r["source"]: r["links"] for r in R.cross_document_links(spark.createDataFrame(rows, "id string, source string, chunk_index int, seq long, embedding array<double>"), 0.6).collect()}
    want = {r[1]: set() for r in rows}
    for a in (r for r in rows if r[2] < 3):
        cos = lambda u, v: float(np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v))
        best = sorted(((-cos(a[4], b[4]), b[0], b[1]) for b in rows if cos(a[4], b[4]) >= 0.6))[:3]
        want[a[1]] |= {s for _, _, s in best if s != a[1]}
    assert got == {k: len(v) for k, v in want.items()}


def test_filters_use_fields_or_metadata(corpus):
    fields = {c: F.col(c) for c in ("source", "source_type")}
    from docloom.functions.columns import matches

    count = lambda f: corpus.where(matches(fields, F.col("metadata"), f)).count()
    assert count({"heading": "Intro"}) == 1 and count({"source": "doc.py", "heading": "Outro"}) == 1
    assert count({"unknown": None}) == 3 and count({"unknown": "x"}) == 0 and count({}) == 3


def test_many_queries_hold_the_scores_of_a_block_only(spark, monkeypatch):
    """6,000 queries and 9,000 rows in one Arrow batch; of equal vectors the first ids."""
    import tracemalloc

    import numpy as np
    from pyspark.sql.classic.dataframe import DataFrame

    rng = np.random.default_rng(12)
    m = rng.integers(-3, 4, (9000, 16)).astype(float)
    m[8000:] = m[:1000]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>").coalesce(1)
    asks = spark.createDataFrame([(i, m[i].tolist()) for i in range(6000)], "query long, embedding array<double>")
    plain = DataFrame.mapInArrow

    def limited(self, body, *a, **b):
        def run(batches):
            tracemalloc.start()
            try:
                yield from body(batches)
                held = tracemalloc.get_traced_memory()[1]
            finally:
                tracemalloc.stop()
            if held > 100 << 20:
                raise MemoryError(f"a task held {held >> 20} MB")

        return plain(self, run, *a, **b)

    monkeypatch.setattr(DataFrame, "mapInArrow", limited)
    got = {(r["query"], r["rank"]): (r["id"], r["score"]) for r in R.dense_batch(df, asks, 3).collect()}
    assert len(got) == 3 * 6000
    u = m / np.sqrt((m * m).sum(1))[:, None]
    for i in range(0, 6000, 50):
        scores = np.round(u @ u[i], 9)
        want = np.lexsort((np.arange(len(m)), -scores))[:3]
        assert [got[i, k + 1][1] for k in range(3)] == pytest.approx(scores[want].tolist())
        assert got[i, 1][0] == i and (i >= 1000 or got[i, 2][0] == i + 8000)
