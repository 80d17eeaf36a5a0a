from __future__ import annotations

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import words
from docloom.functions.tables import STOP_WORDS
from docloom.operators import registry
from docloom.operators import retrieval as R
from docloom.operators import study
from docloom.plans import built, catalog
from docloom.runtime import shared_dir
from docloom.sources import files
from docloom.streaming import watch as W


def test_word_counts_against_regular_expressions():
    import re

    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB_9 .é\nİK") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, ""]
    size, row, code, known, count = words.term_counts(pa.array(texts))
    got = [{} for _ in texts]
    for r, c, n in zip(row.tolist(), code.tolist(), count.tolist(), strict=True):
        got[r][known[c]] = n
    for i, t in enumerate(texts):
        want = re.findall("[a-z0-9_]+", (t or "").lower())
        assert size[i] == len(want) and got[i] == {w: want.count(w) for w in want}
    some = ["Der Hund und die Katze", "für ÉTÉ est", "", None, "œuvre d'à"]
    n, hits = words.stop_word_hits(pa.array(some), list(STOP_WORDS.values()))
    for i, t in enumerate(some):
        want = re.findall("[a-zà-öø-ÿœæ]+", (t or "").lower())
        assert n[i] == len(want) and hits[i].tolist() == [sum(w in known for w in want) for known in STOP_WORDS.values()]


def test_index_and_single_pass_agree(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"d{i}", i, None if i == 7 else " ".join(rng.choices(["sea", "sand", "salt", "Sea", "x"], k=rng.randint(0, 9)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "id string, seq long, text string").withColumns({c: F.lit("own") for c in ("score", "rank", "words")})
    index = R.build_index(docs, f"{tmp_path}/index")
    assert index.documents == 60 and R.open_index(spark, f"{tmp_path}/index").words == index.words
    for query in ("sea", "salt sea sea", "none here", "x"):
        one = [(r["id"], round(r["score"], 9), r["rank"]) for r in R.bm25_search(docs, query, 8).orderBy("rank").collect()]
        two = [(r["id"], round(r["score"], 9), r["rank"]) for r in R.bm25_search(R.Corpus(docs, docs, index), query, 8).orderBy("rank").collect()]
        assert one == two
    # Columns of the corpus that have the results' names are replaced.
    hit = R.bm25_search(docs, "sea", 3).first()
    assert isinstance(hit["score"], float) and hit["words"] == "own"


def test_index_follows_the_version_of_the_files(spark, tmp_path):
    write = lambda text, mode: spark.createDataFrame([(1, text)], "doc_id long, text string").write.mode(mode).parquet(f"{tmp_path}/docs")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    found = lambda: {r["doc_id"] for r in R.bm25_search(R.corpus_of(spark.read.parquet(f"{tmp_path}/docs"), vectors), "gull", 5).collect()}
    write("a gull", "overwrite")
    assert found() == {1}
    first = len(R._INDEXES)
    assert found() == {1} and len(R._INDEXES) == first
    time.sleep(0.01)
    write("no bird", "overwrite")
    assert found() == set()


def test_study_note_leaves_out_what_is_empty(spark):
    note = study.study_notes(spark.createDataFrame([("  A  note ", "s", None), (None, None, None)], "title string, source string, keywords array<string>")).orderBy(F.col("title").desc()).collect()
    assert [r["title"] for r in note] == ["Untitled", "A note"] and note[1]["filename"] == "A note.md"
    assert "## Keywords" not in note[1]["markdown"] and "## Flashcards" not in note[1]["markdown"] and "- None found." in note[1]["markdown"]


def test_names_of_moved_files(spark):
    paths = spark.createDataFrame([("/in/a.txt",), ("/in/b/a.txt",), ("/in/c.txt",), ("/in/d",)], "path string")
    taken = spark.createDataFrame([("a.txt",), ("a 2.txt",)], "name string")
    got = {r["path"]: r["destination"] for r in W.destinations(paths, "/failed/", taken).collect()}
    assert got == {"/in/a.txt": "/failed/a 3.txt", "/in/b/a.txt": "/failed/a 4.txt", "/in/c.txt": "/failed/c.txt", "/in/d": "/failed/d"}
    assert files.unique_names(["x.txt", "x.txt", "x-1.txt", "x.txt"]) == ["x.txt", "x-1.txt", "x-1-1.txt", "x-2.txt"]


def test_failed_and_unsettled_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "failed").mkdir()
    (tmp_path / "failed" / "bad.txt").write_text("earlier")
    (tmp_path / "in" / "good.md").write_text("# Good")
    (tmp_path / "in" / "copy.md").write_text("# Good")
    (tmp_path / "in" / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    W.watch(spark, f"file://{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/point", failed=f"file://{tmp_path}/failed").awaitTermination()
    assert {r["filename"] for r in spark.read.parquet(f"{tmp_path}/out/documents/*").collect()} <= {"good.md", "copy.md"}
    assert spark.read.parquet(f"{tmp_path}/out/stats/*").first()["skipped_duplicates"] == 1
    assert sorted(p.name for p in (tmp_path / "failed").iterdir()) == ["bad 2.txt", "bad.txt"] and not (tmp_path / "in" / "bad.txt").exists()
    (tmp_path / "new").mkdir()
    (tmp_path / "new" / "growing.md").write_text("# Still")
    W.watch(spark, f"file://{tmp_path}/new", f"{tmp_path}/out2", f"{tmp_path}/point2", settle=3600).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out2/documents/*").count() == 0


def test_hooks_see_ingested_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "b.md").write_text("# B")
    registry.before_ingest.register("only a", lambda df: df.where("path like '%a.md'"))
    registry.after_ingest.register("mark", lambda df: df.withColumn("seen", F.lit(True)))
    try:
        good, _ = files.ingest(spark, f"file://{tmp_path}")
        assert [(r["filename"], r["seen"]) for r in good.collect()] == [("a.md", True)]
    finally:
        registry.before_ingest.chain.clear()
        registry.after_ingest.chain.clear()


def test_shared_folder_is_needed_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_built_queries_have_sql():
    mine = [n for n, q in catalog.QUERIES.items() if n in vars(built)]
    assert len(mine) >= 27 and all(n in catalog.SQL for n in mine)
