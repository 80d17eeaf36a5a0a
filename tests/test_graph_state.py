from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import graph as G
from docloom.operators import notes as N
from docloom.operators import state as S
from docloom.operators import tables as T

NODE = "id string, label string, node_type string, source string, metadata map<string,string>, seq long"
EDGE = "source_id string, target_id string, edge_type string, weight double, metadata map<string,string>, seq long"


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(x, x.upper(), "entity", "s", {}, i) for i, x in enumerate(nodes)], NODE)
    e = spark.createDataFrame([(a, b, "related_to", 1.0, {}, i) for i, (a, b) in enumerate(edges)], EDGE)
    return n, e


def test_subgraph_neighbours_and_loops(spark):
    n, e = graph(spark, "abcd", [("a", "b"), ("b", "c"), ("c", "d"), ("a", "a"), ("a", "b")])
    nodes, edges = G.subgraph(n, e, "a", 1)
    assert {r["id"] for r in nodes.collect()} == {"a", "b"} and edges.count() == 2
    assert {r["id"]: r["distance"] for r in G.distances(n, e, "a", 9).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert G.distances(n, e, "zzz", 2).count() == 0 and G.distances(n, e, "a", -1).count() == 0
    assert sorted(r["id"] for r in G.neighbors(n, e, "a").collect()) == ["a", "b", "b"]


def test_merge_keeps_the_last_node_and_all_valid_edges(spark):
    n, e = graph(spark, "ab", [("a", "b"), ("a", "x")])
    nodes, edges = G.merge([(n, e), (n.withColumn("label", F.lit("new")), e)])
    assert {r["label"] for r in nodes.collect()} == {"new"} and nodes.count() == 2 and edges.count() == 2
    assert G.merge([(n, e), (n, e)], distinct_edges=True)[1].count() == 1


def test_star_counts(spark):
    schema = "title string, source string, concepts array<string>, definitions array<struct<name:string,text:string>>, entities array<string>, topics array<string>"
    notes = spark.createDataFrame([("Test Note", "s", ["Pytest", "Coverage"], [("Fixture", "x" * 300)], ["Python"], ["TDD"])], schema)
    nodes, edges = G.star(notes)
    assert nodes.count() == 6 and edges.count() == 7
    assert max(len(v) for r in nodes.collect() for v in r["metadata"].values()) == 200


def test_relationships(spark):
    schema = "source string, section_id string, entity_id string, ord int, start_char int, end_char int"
    rows = [("d", "s-1", x, i, i, i + 1) for i, x in enumerate(["b", "a", "c", "a"])] + [("d", "s-2", "z", 9, 0, 1), ("e", None, "a", 0, 0, 1), ("e", None, "b", 1, 0, 1)]
    got = {(r["source_id"], r["target_id"]): len(r["evidence"]) for r in G.relationships(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("a", "b"): 5, ("a", "c"): 3, ("b", "c"): 2}


def test_state_tables(spark):
    docs = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y"), (3, None)], "doc_id long, text string")
    assert [tuple(r)[1:] for r in S.exact_duplicates(docs).collect()] == [(0, 2)]
    hashed = docs.select("doc_id", S.content_hash(F.col("text")).alias("sha256"))
    assert {r["doc_id"] for r in S.new_files(hashed, hashed.where("doc_id = 0")).collect()} == {2, 3}
    empty = spark.createDataFrame([], "status string, duplicate boolean, seconds double")
    assert S.runtime_stats(empty).first().asDict() == {"processed": 0, "skipped_duplicates": 0, "failed": 0, "detection_events": 0, "average_seconds": 0.0}


def test_tables(spark):
    df = spark.createDataFrame([("name,age,city\nAlice,30,Springfield\nBob,25,Shelbyville\n\nCarol,40,Capital City\n",), ("",), (None,)], "text string")
    t = df.select(T.csv_table(F.col("text")).alias("t")).select(T.markdown_table(F.col("t.header"), F.col("t.rows")).alias("m"))
    assert t.first()["m"] == "| name | age | city |\n| --- | --- | --- |\n| Alice | 30 | Springfield |\n| Bob | 25 | Shelbyville |\n| Carol | 40 | Capital City |"
    ragged = spark.createDataFrame([(["a"], [["1", "x|y\nz"], []])], "h array<string>, r array<array<string>>")
    assert ragged.select(T.markdown_table(F.col("h"), F.col("r"))).first()[0] == "| a |  |\n| --- | --- |\n| 1 | x\\|y<br>z |\n|  |  |"


def test_code():
    source = 'import os\nfrom a.b import c\n\ndef greet(name):\n    "doc"\n\nclass Greeter(Base):\n    def one(self): pass\n    def two(self): pass\n'
    kinds = [(k, n, p) for k, n, p, *_ in T.code_items(source)]
    assert kinds == [("import", "os", None), ("import", "a.b", None), ("function", "greet", None), ("class", "Greeter", None), ("method", "one", "Greeter"), ("method", "two", "Greeter")]
    assert [x[:2] for x in T.code_items("export async function go() {}\nclass X {", python=False)] == [("function", "go"), ("class", "X")]
    assert T.code_items("def broken(:") == []


def test_notes(spark):
    old = spark.createDataFrame([("s1", "T", "T.md", f"mine\n{N.BEGIN}\nold\n{N.END}\ntail")], "source string, title string, filename string, markdown string")
    made = spark.createDataFrame([("s1", "T", "T.md", f"{N.BEGIN}\nnew\n{N.END}\n"), ("s2", "T", "T.md", "other")], "source string, title string, filename string, markdown string")
    got = {r["source"]: r for r in N.upsert(old, made).collect()}
    assert got["s1"]["markdown"] == f"mine\n{N.BEGIN}\nnew\n{N.END}\ntail" and got["s2"]["filename"] == "T 2.md"
    page = N.render(spark.createDataFrame([("A", "s", ["x"], "body", "")], "title string, source string, tags array<string>, summary string, extra string"), [("Summary", F.col("summary")), ("Extra", F.col("extra"))]).first()["markdown"]
    assert "## Summary\n\nbody" in page and "Extra" not in page
    assert spark.range(1).select(N.front_matter(F.lit('---\ntitle: "A \\"q\\""\n---\n'), "title")).first()[0] == 'A "q"'
