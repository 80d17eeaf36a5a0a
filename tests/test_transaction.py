"""The watched folder's transactions: killed after each step and run again, they give the tables of an undisturbed run."""

from __future__ import annotations

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.operators import registry
from docloom.operators import retrieval as R
from docloom.operators.models import hash_embedder
from docloom.sources.files import scan
from docloom.streaming import transaction as T


def _files(folder: Path) -> str:
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "harbour.md").write_text("# Harbour\n\nDr. Jane Smith met Acme Corporation in Berlin.\n\n## Trade\n\nWheat and salt.")
    (folder / "copy.txt").write_text("Plain words about the sea.")
    (folder / "copy2.txt").write_text("Plain words about the sea.")
    (folder / "people.csv").write_text("name,age\nAda,36\n")
    (folder / "broken.ipynb").write_text("{no notebook")
    (folder / "odd.xyz").write_text("?")
    (folder / "sub").mkdir(exist_ok=True)
    (folder / "sub" / "harbour.md").write_text("# Harbour\n\nAnother text. Plain words about the sea.")
    return str(folder)


def _flow(calls: Path | None = None) -> T.Workflow:
    inner = hash_embedder(8)

    def embed(texts):
        if calls is not None:
            with calls.open("a") as f:
                f.writelines(hashlib.sha256(t.encode()).hexdigest() + "\n" for t in texts)
        return inner(texts)

    return T.Workflow(embed, "hash-8")


def _tables(spark, out) -> dict:
    drop = {"manifest": ["processed_at"], "documents": ["modified_at"]}
    text = lambda r: tuple(str(v) for v in r)
    return {name: sorted(text(r) for r in T.read(spark, out, name).drop(*drop.get(name, [])).collect()) for name in T.TABLES}


def test_a_batch_killed_after_each_step_and_run_again_equals_an_undisturbed_one(spark, tmp_path, monkeypatch):
    folder, write = _files(tmp_path / "in"), T._Batch.write
    files = scan(spark, folder)
    T.process(files, 0, f"{tmp_path}/whole", _flow())
    whole = _tables(spark, f"{tmp_path}/whole")
    assert {n: len(r) for n, r in whole.items() if n in ("documents", "notes", "manifest", "quarantine")} == {"documents": 4, "notes": 4, "manifest": 4, "quarantine": 1}
    assert whole["nodes"] and whole["edges"] and len(whole["vectors"]) <= len(whole["chunks"])

    for name in ("quarantine", "vectors", "notes", "manifest", "commit"):
        out = f"{tmp_path}/killed-{name}"

        def lost(self, table, rows, name=name):
            found = write(self, table, rows)
            if table == name:
                raise RuntimeError("lost")
            return found

        with monkeypatch.context() as m:
            m.setattr(T._Batch, "write", lost)
            if name == "commit":
                m.setattr(T._Batch, "commit", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                T.process(files, 0, out, _flow())
        assert not any(_tables(spark, out).values())  # readers see nothing of it
        T.process(files, 0, out, _flow())
        assert _tables(spark, out) == whole
    T.process(files, 0, f"{tmp_path}/whole", _flow())  # a committed batch isn't run again
    assert _tables(spark, f"{tmp_path}/whole") == whole


def test_texts_are_embedded_once_and_names_stay_free(spark, tmp_path):
    calls, out = tmp_path / "calls", f"{tmp_path}/out"
    folder = _files(tmp_path / "in")
    T.process(scan(spark, folder), 0, out, _flow(calls))
    first = calls.read_text().split()
    assert len(first) == len(set(first)) == T.read(spark, out, "vectors").count()
    # The same contents again: nothing is new, nothing is embedded.
    T.process(scan(spark, folder), 1, out, _flow(calls))
    assert calls.read_text().split() == first and T.read(spark, out, "documents").count() == 4
    # Another document with a known chunk and a new one: only the new one is embedded.
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "harbour.md").write_text("# Harbour\n\nThird text.")
    (tmp_path / "more" / "again.txt").write_text("Plain words about the sea.\n")
    T.process(scan(spark, f"{tmp_path}/more"), 2, out, _flow(calls))
    now = calls.read_text().split()
    assert len(now) == len(set(now))
    notes = sorted(r["filename"] for r in T.newest(T.read(spark, out, "notes"), "source").collect())
    assert len(notes) == len(set(notes)) and {"Harbour.md", "Harbour 2.md", "Harbour 3.md"} <= set(notes)
    steps = {r["step"]: r["rows"] for r in T.totals(spark, out).collect()}
    assert steps["detected"] == 6 + 6 + 2 and steps["vectors"] == len(now) and steps["processed"] == T.read(spark, out, "documents").count()
    found = R.bm25_search(T.searchable(spark, out, "hash-8"), "third", 3).collect()
    assert len(found) == 1 and found[0]["source"].endswith("more/harbour.md")


def test_hooks_run_and_streams_drain(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "before_ingest", registry.Hooks())
    monkeypatch.setattr(T, "after_ingest", registry.Hooks())
    T.before_ingest.register("no csv", lambda df: df.where(~F.col("path").endswith(".csv")))
    T.after_ingest.register("failing", lambda df: df.select("nothing of that name"))
    T.after_ingest.register("title", lambda df: df.withColumn("title", F.coalesce("title", F.lit("Untitled"))))
    folder, out = _files(tmp_path / "in"), f"{tmp_path}/out"
    T.watch(spark, folder, out, f"{tmp_path}/checkpoint", T.Workflow(), per_batch=3).awaitTermination()
    found = T.read(spark, out, "documents").collect()
    assert len(found) == 3 and all(r["title"] for r in found)
    assert T.commits(spark, out).select("batch").distinct().count() >= 2 and T.read(spark, out, "vectors").count() == 0


def _held_to(monkeypatch, most: int) -> None:
    """From now on a Python task of mapInArrow fails that has held more bytes than this at a time."""
    from pyspark.sql.classic.dataframe import DataFrame

    plain = DataFrame.mapInArrow

    def limited(self, body, *a, **b):
        def run(batches):
            import tracemalloc

            tracemalloc.start()
            try:
                yield from body(batches)
                held = tracemalloc.get_traced_memory()[1]
            finally:
                tracemalloc.stop()
            if held > most:
                raise MemoryError(f"a task held {held >> 20} MB")

        return plain(self, run, *a, **b)

    monkeypatch.setattr(DataFrame, "mapInArrow", limited)


def test_links_of_many_chunks_hold_little_and_equal_brute_force(spark, monkeypatch):
    import numpy as np

    rng, n = np.random.default_rng(11), 9000
    m = rng.standard_normal((n, 8))
    m[:300] = m[300:600] + rng.standard_normal((300, 8)) * 0.003  # texts that are close
    hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    # Of every source two chunks; some texts are shared, and one chunk was made twice, with two texts.
    rows = [(f"s{i // 2}::chunk_{i % 2}", hashes[i], i % 2) for i in range(n)] + [(f"t{i}::chunk_0", hashes[i % 7], 0) for i in range(40)] + [("s0::chunk_0", hashes[600], 0)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text_hash string, chunk_index int").coalesce(1)
    vectors = spark.createDataFrame([(h, v.tolist()) for h, v in zip(hashes, m, strict=True)], "text_hash string, embedding array<double>").coalesce(1)
    _held_to(monkeypatch, 100 << 20)
    found = {(r["source"], r["other"]): r["score"] for r in T._links(chunks, chunks.select("chunk_id", "text_hash"), vectors, 0.999).collect()}

    place, u = {h: i for i, h in enumerate(hashes)}, m / np.linalg.norm(m, axis=1)[:, None]
    by_vector = {}
    for name, h, _ in rows:
        by_vector.setdefault(place[h], []).append(name)
    want = {}
    for i, names in by_vector.items():
        near = [(-1.0 if j == i else -float(u[i] @ u[j]), other) for j in np.flatnonzero(u @ u[i] >= 0.999 - 1e-12) for other in by_vector[j]]
        for score, other in sorted(near)[:3]:
            for name in names:
                pair = (name.split("::")[0], other.split("::")[0])
                if pair[0] != pair[1]:
                    want[pair] = max(want.get(pair, 0), -score)
    assert found.keys() == want.keys() and len(want) > 300
    assert all(abs(found[p] - s) < 1e-9 for p, s in want.items())


def test_a_batch_leaves_no_second_copy_of_its_texts(spark, tmp_path):
    from docloom.runtime import shared_dir

    there = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file://")).glob("watched-parsed-*")}
    before = there()
    T.process(scan(spark, _files(tmp_path / "in")), 0, f"{tmp_path}/out", _flow())
    assert there() == before
    assert T.read(spark, f"{tmp_path}/out", "documents").count() == 4 and T.read(spark, f"{tmp_path}/out", "quarantine").count() == 1


def test_mentions_take_one_pass_over_the_texts_and_equal_the_form_of_many(spark):
    from docloom.operators import text as X

    texts = ["# Harbour\n\nDr. Jane Smith met Acme Corporation in Berlin.\n\n- Python 3.12\n\n```\nAcme Corporation\n```\n\n## Trade\n\n> Schmidt GmbH\n\n|a|b|\n|-|-|\n|Berlin|x|\n", "Before.\n# One\nAcme Corporation", "Dr. Jane Smith met Acme Corporation.", "", None, "# Empty"]
    docs = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "source string, text string")
    base = docs.withColumn("sections", X.sections("text"))
    inner = base.select("source", F.inline("sections")).select("source", "section_id", F.inline("blocks")).where(F.col("type").isin("paragraph", "list", "blockquote", "table"))
    inner = inner.select("source", "section_id", F.col("start_char").alias("shift"), F.inline(X.entities("text"))).selectExpr("source", "section_id", "entity_id", "label", "entity_type", "start_char + shift", "end_char + shift")
    whole = base.where(F.size("sections") == 0).select("source", F.lit(None).cast("string"), F.inline(X.entities("text")))
    found = X.mentions(docs)
    got = [tuple(r) for r in found.drop("ord").collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted((tuple(r) for r in inner.union(whole).collect()), key=key) and len(got) >= 6
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
