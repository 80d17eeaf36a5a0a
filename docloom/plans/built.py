"""Queries over texts and files that are built from the driver's tables, so that SQL knows their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import columns as C
from docloom.operators import graph as G
from docloom.operators import notes as N
from docloom.operators import retrieval as R
from docloom.operators import study
from docloom.operators import tables as T
from docloom.operators import text as X
from docloom.plans.catalog import query
from docloom.sources import files, store


def _say(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _nations(t) -> DataFrame:
    return t("nation").select("n_nationkey", "n_regionkey", F.initcap("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("key"))


_N = "n as (select n_nationkey, n_regionkey, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) as name, cast(n_nationkey as varchar) as key from nation where position(' ' in n_name) = 0)"


def _one_word(t) -> DataFrame:
    return _nations(t).where(~F.col("name").contains(" "))


@query(f"""with {_N}, s as (select name, unnest([name || ' has ' || key || '.5 ports.', 'Dr. ' || name || ' met Mrs. Lane!', 'Was it e.g. late?', '"So it was." They left...', 'no end']) as sentence,
  unnest([1, 2, 3, 4, 5]) as place from n) select name, place - 1 as place, sentence from (
  select name, case when place < 4 then place when place = 5 then 6 else 4 end as place, case when place = 4 then '"So it was."' else sentence end as sentence from s
  union all select name, 5, 'They left... no end' from s where place = 4) where place <> 6""")
def sentences_built(t):
    text = _say(F.col("name"), " has ", F.col("key"), ".5 ports. Dr. ", F.col("name"), ' met Mrs. Lane!  Was it e.g. late?\n"So it was." They left... no end')
    return _one_word(t).select("name", F.posexplode(X.sentences(text)).alias("place", "sentence"))


@query(f"with {_N} select name, '# ' || name || chr(10) || chr(10) || 'Port ' || key || ' is open.' || chr(10) || chr(10) || '- one' || chr(10) || '- two words' || chr(10) || chr(10) || '> said so' as text from n")
def clean_text_built(t):
    raw = _say("\n#   ", F.col("name"), "  \n\n\n\nPort   ", F.col("key"), "\tis  open. \n\n-   one\n-  two   words\n\n>  said   so\n\n")
    return _one_word(t).select("name", X.clean_text(raw).alias("text"))


@query(f"""with {_N}, c as (select name, 0 as chunk_index, '# ' || name || chr(10) || chr(10) || 'Port ' || key || ' is open.' as text, name as heading, '1' as level from n
  union all select name, 1, '## Trade' || chr(10) || chr(10) || 'Wheat from ' || name || '.', 'Trade', '2' from n)
  select name || '::chunk_' || chunk_index as chunk_id, case when chunk_index = 0 then text else 'Port ' || key || ' is open.' end as seen, heading, level from c join n using (name)""")
def chunks_built(t):
    text = _say("# ", F.col("name"), "\n\nPort ", F.col("key"), " is open.\n\n## Trade\n\nWheat from ", F.col("name"), ".")
    made = X.chunks(_one_word(t).select(F.col("name").alias("source"), text.alias("text"), "key"))
    keys = _one_word(t).select(F.col("name").alias("source"), "key")
    seen = F.when(F.col("chunk_index") == 0, F.col("text")).when(F.col("text").endswith(_say("Wheat from ", F.col("source"), ".")), _say("Port ", F.col("key"), " is open."))
    return made.join(keys, "source").select("chunk_id", seen.alias("seen"), F.col("metadata")["heading"].alias("heading"), F.col("metadata")["heading_level"].alias("level"))


_ENTITIES = """select name, 'person::ada_' || lower(name) as entity_id, 'person' as entity_type, 'Ada ' || name as label from n
  union all select name, 'organization::' || lower(name) || '_labs', 'organization', name || ' Labs' from n
  union all select name, 'place::' || lower(name), 'place', name from n
  union all select name, 'technology::parser_2.' || key, 'technology', 'Parser 2.' || key from n"""


def _named(t) -> DataFrame:
    """Nations under names of letters alone."""
    return t("nation").select(_say("Por", F.translate(F.col("n_nationkey").cast("string"), "0123456789", "abcdefghij")).alias("name"), F.col("n_nationkey").cast("string").alias("key"))


_L = "n as (select 'Por' || translate(cast(n_nationkey as varchar), '0123456789', 'abcdefghij') as name, cast(n_nationkey as varchar) as key from nation)"


def _entity_text(t) -> DataFrame:
    text = _say("Mr. Ada ", F.col("name"), " runs Parser 2.", F.col("key"), ". It came from ", F.col("name"), ", and ", F.col("name"), " Labs paid.")
    return _named(t).select(F.col("name").alias("source"), text.alias("text"))


@query(f"with {_L}, e as ({_ENTITIES}) select name as source, entity_id, entity_type, label, row_number() over (partition by name order by case entity_type when 'person' then 1 when 'technology' then 2 when 'place' then 3 else 4 end) as ord from e")
def entity_mentions_built(t):
    return X.mentions(_entity_text(t)).select("source", "entity_id", "entity_type", "label", F.col("ord").cast("long").alias("ord"))


@query(f"with {_L}, e as ({_ENTITIES}) select name as source, entity_id, entity_type, label, 2 as n_mentions from e")
def entity_table_built(t):
    twice = _entity_text(t).select("source", _say(F.col("text"), " ", F.col("text")).alias("text"))
    return X.entity_table(X.mentions(twice)).select("source", "entity_id", "entity_type", "label", F.col("n_mentions").cast("int").alias("n_mentions"))


@query(f"""with {_N} select name, kind, item, parent, start_line from (
  select name, 'import' as kind, 'os' as item, null as parent, 1 as start_line from n union all select name, 'class', name, null, 2 from n
  union all select name, 'method', 'port', name, 3 from n union all select name, 'function', 'run_' || key, null, 5 from n)""")
def python_code_built(t):
    code = _say("import os\nclass ", F.col("name"), ":\n    def port(self):\n        return ", F.col("key"), "\ndef run_", F.col("key"), "(a, b):\n    pass\n")
    return _code(_one_word(t), T.python_code(code))


def _code(rows: DataFrame, items: Column) -> DataFrame:
    return rows.select(F.col("name").alias("owner"), F.explode(items).alias("i")).select(F.col("owner").alias("name"), "i.kind", F.col("i.name").alias("item"), "i.parent", "i.start_line")


@query(f"with {_N} select name, 'import' as kind, 'lib.' || lower(name) as item, cast(null as varchar) as parent, 1 as start_line from n union all select name, 'class', name, null, 2 from n union all select name, 'function', 'port' || key, null, 3 from n")
def other_code_built(t):
    code = _say("import lib.", F.lower("name"), "\nexport class ", F.col("name"), " {\n  async function port", F.col("key"), "() {}\n}\n")
    return _code(_one_word(t), T.other_code(code))


@query(f"with {_N} select name, cell, cell_type, source_text from (select name, 0 as cell, 'markdown' as cell_type, '# ' || name as source_text from n union all select name, 1, 'code', 'x = ' || key || chr(10) || 'y' from n)")
def notebook_cells_built(t):
    text = _say('{"cells": [{"cell_type": "markdown", "source": ["# ', F.col("name"), '"]}, {"cell_type": "code", "source": ["x = ', F.col("key"), '\\n", "y"]}]}')
    return T.notebook_cells(_one_word(t).select("name", text.alias("text")), "name").select("name", "cell", "cell_type", "source_text")


@query(f"with {_N} select name, 'flowchart TD' || chr(10) || '    n0[\"' || name || '\"]' || chr(10) || '    n1[\"Port ' || key || '\"]' as mermaid from n")
def drawio_mermaid_built(t):
    xml = _say("<m><mxCell value='", F.col("name"), "'/><mxCell value=' '/><mxCell value='&lt;b&gt;Port ", F.col("key"), "&lt;/b&gt;'/></m>")
    return _one_word(t).select("name", T.diagram_mermaid(T.drawio_labels(xml)).alias("mermaid"))


# ------------------------------------------------------------------ files: every row is a file of one kind, built in SQL terms


def _file(rows: DataFrame, ending: str, content: Column, folder: str = "/in/") -> DataFrame:
    raw = content.cast("binary")
    return rows.select(_say(folder, F.col("name"), ending).alias("path"), raw.alias("content"), F.octet_length(raw).cast("long").alias("length"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("modificationTime"))


def _mail(name: Column) -> Column:
    part = lambda file, body: _say("--b\nContent-Type: text/plain\nContent-Disposition: attachment; filename=\"", file, "\"\n\n", body, "\n")
    head = _say("Subject: About ", name, "\nFrom: a@example.com\nTo: b@example.com\nDate: Mon, 1 Jan 2024 00:00:00 +0000\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=b\n\n")
    return _say(head, "--b\nContent-Type: text/plain\n\nDear ", name, "\n", part("one.txt", "first"), part("one.txt", "second"), part("one.txt", "third"), "--b--\n")


_KINDS = {
    ".md": (lambda n, k: _say("#  ", n, "\n\n\nPort  ", k), "'# ' || name || chr(10) || chr(10) || 'Port ' || key", "markdown", "name"),
    ".txt": (lambda n, k: _say(n, "   and ", k, "\n"), "name || ' and ' || key", "text", "name"),
    ".log": (lambda n, k: _say("at ", k, ":  ", n), "'at ' || key || ': ' || name", "text", "name"),
    ".rtf": (lambda n, k: _say(n, "  text"), "name || ' text'", "text", "name"),
    ".csv": (lambda n, k: _say("a;b\n", n, "; ", k, "\n"), "'a;b' || chr(10) || name || '; ' || key || chr(10)", "csv", "name"),
    ".yaml": (lambda n, k: _say("name: ", n, "\n"), "'name: ' || name", "config", "name"),
    ".toml": (lambda n, k: _say("key = ", k, "\n"), "'key = ' || key", "config", "name"),
    ".py": (lambda n, k: _say("x  =  ", k, "\n"), "'x  =  ' || key || chr(10)", "code", "name"),
    ".mmd": (lambda n, k: _say("graph TD\n  ", n, "-->B\n"), "'graph TD' || chr(10) || '  ' || name || '-->B' || chr(10)", "code", "name"),
    ".ipynb": (lambda n, k: _say('{"cells": [{"cell_type": "markdown", "source": "# ', n, '"}, {"cell_type": "code", "source": ["y = ', k, '"]}]}'), "'# ' || name || chr(10) || chr(10) || '```python' || chr(10) || 'y = ' || key || chr(10) || '```'", "notebook", "name"),
    ".ris": (lambda n, k: _say("TY  - JOUR\nTI  - ", n, "\nER  - \n"), "'TY: JOUR' || chr(10) || 'TI: ' || name", "research", "name"),
}
_SOURCES = " union all ".join(f"select name || '{ending}' as filename, '{kind}' as source_type, {title} as title, {text} as text from n" for ending, (_, text, kind, title) in _KINDS.items())


@query(f"with {_N} {_SOURCES}")
def source_kinds(t):
    rows = _one_word(t)
    made = None
    for ending, (content, *_) in _KINDS.items():
        part = _file(rows, ending, content(F.col("name"), F.col("key")))
        made = part if made is None else made.unionByName(part)
    return files.parse(made).where("reason is null").select("filename", "source_type", "title", "text")


@query(f"with {_N} select '/in/' || name || '.eml' as parent, filename, text from n, (values ('one.txt', 'first'), ('one-1.txt', 'second'), ('one-2.txt', 'third')) as a(filename, text)")
def source_mail_attachments(t):
    parsed = files.parse(_file(_one_word(t), ".eml", _mail(F.col("name"))))
    return files.children(parsed).select(F.col("parent_id").alias("parent"), "filename", "text")


@query(f"with {_N} select name || '.txt' as filename, 'text' as source_type from n union all select name || '.pptx', 'pptx' from n")
def source_quarantine(t):
    rows = _one_word(t)
    bad = _file(rows, ".txt", F.lit("  \n")).unionByName(_file(rows, ".pptx", F.lit("no archive"))).unionByName(_file(rows, ".md", _say("# ", F.col("name"))))
    return files.parse(bad).where("reason is not null").select("filename", "source_type")


@query(f"with {_N}, f as (select name || e as path from n, (values ('.md'), ('.XLSX'), ('.unknown'), ('.tmp'), ('.log')) as x(e) union all select '.git/' || name || '.md' from n) select path, (path like '%.md' or path like '%.XLSX' or path like '%.log') and path not like '.git/%' as watched from f")
def watchable_files(t):
    rows = _one_word(t).select("name", F.explode(F.array(*(F.lit(e) for e in (".md", ".XLSX", ".unknown", ".tmp", ".log")))).alias("e")).select(_say(F.col("name"), F.col("e")).alias("path"))
    rows = rows.unionByName(_one_word(t).select(_say(".git/", F.col("name"), ".md").alias("path")))
    return rows.select("path", files.watchable(_say("/in/", F.col("path"))).alias("watched"))


@query("select p_partkey, [ 'python', 'c++', 'shell', 'generic', 'r', 'generic' ][p_partkey % 6 + 1] as language, least(greatest(p_partkey % 9, 1), 6) as level from part")
def code_language_and_level(t):
    ending = F.element_at(F.array(*map(F.lit, (".PY", ".cpp", ".bash", ".md", ".R", ""))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return t("part").select("p_partkey", C.code_language(_say("src/f", F.col("p_partkey").cast("string"), ending)).alias("language"), C.heading_level(F.col("p_partkey") % 9).alias("level"))


# ------------------------------------------------------------------ stores, notes, graphs


@query("select vec_id as id, cast(vec_id as bigint) as seq, case when vec_id % 3 = 0 then label + 100 else label end as label from embeddings where vec_id % 7 <> 0")
def vector_upsert_remove(t):
    old = t("embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").cast("long").alias("seq"), "label")
    new = old.where("id % 3 = 0").select("id", "seq", (F.col("label") + 100).alias("label"))
    return store.remove_vectors(store.upsert_vectors(old, new), old.where("id % 7 = 0").select("id")).select("id", "seq", "label")


@query("select s_suppkey, case when s_suppkey % 4 = 0 then 'blank source' when s_suppkey % 4 = 1 then 'half an offset pair' when s_suppkey % 4 = 2 then 'end before start' end as reason from supplier where s_suppkey % 4 <> 3")
def validate_documents(t):
    k = F.col("s_suppkey") % 4
    docs = t("supplier").select("s_suppkey", F.when(k == 0, " ").otherwise(F.col("s_name")).alias("source"), F.when(k != 1, 5).alias("start_char"), F.when(k == 2, 4).otherwise(9).alias("end_char"))
    return store.validate(docs)[1].select("s_suppkey", "reason")


@query("select s_name || '.md' as filename, 'kept' || chr(10) || '<!-- docloom:begin -->' || chr(10) || 'new' || chr(10) || '<!-- docloom:end -->' || chr(10) || 'own words' as markdown from supplier")
def note_merge_managed(t):
    old = _say("kept\n", N.BEGIN, "\nold\n", N.END, "\nown words")
    new = _say(N.BEGIN, "\nnew\n", N.END, "\n")
    return t("supplier").select(_say(F.col("s_name"), ".md").alias("filename"), N.merge_managed(old, new).alias("markdown"))


@query("select s_suppkey, case when n = 1 then 'Note.md' else 'Note ' || n || '.md' end as filename from (select s_suppkey, row_number() over (order by s_name) as n from supplier where s_nationkey < 3)")
def note_free_names(t):
    notes = t("supplier").where("s_nationkey < 3").select("s_suppkey", F.col("s_name").alias("source"), F.lit("Note.md").alias("filename"), F.lit(False).alias("known"))
    return N.free_names(notes).select("s_suppkey", "filename")


@query("select s_suppkey, case when s_suppkey % 2 = 0 then 'text' || chr(10) || chr(10) || '## Backlinks' || chr(10) || chr(10) || '- [[Home|Start]]' || chr(10) else 'has ## Backlinks' end as markdown from supplier")
def note_backlinks(t):
    notes = t("supplier").select("s_suppkey", _say(F.col("s_name"), ".md").alias("filename"), F.when(F.col("s_suppkey") % 2 == 0, "text \n").otherwise("has ## Backlinks").alias("markdown"))
    return N.backlinks(notes, "Home", "Start").select("s_suppkey", "markdown")


@query("select s_suppkey, '- 2024-01-02T03:04:05Z - ' || case when s_suppkey % 2 = 0 then 'created' else 'updated' end || ' [[' || s_name || '|' || s_name || ']] from ' || s_name || chr(10) as line from supplier")
def note_log_entries(t):
    notes = t("supplier").select("s_suppkey", F.col("s_name").alias("title"), _say(F.col("s_name"), ".md").alias("filename"), F.col("s_name").alias("source"), (F.col("s_suppkey") % 2 == 0).alias("created"))
    return notes.select("s_suppkey", N.log_line(F.lit("2024-01-02T03:04:05Z")).alias("line"))


@query("select s_name as title, 'a \"b\" \\ c' as value from supplier")
def note_front_matter(t):
    notes = t("supplier").select(F.col("s_name").alias("title"), F.lit('a "b" \\ c').alias("source"), F.expr("array('x')").alias("tags"))
    return N.render(notes, [("Body", F.lit("text"))]).select("title", N.front_matter(F.col("markdown"), "source").alias("value"))


@query("""select s_name as title, '**Q1: What is ' || s_name || '?**' || chr(10) || 'A1: A supplier' || chr(10) || chr(10) || '**Q2: Where?**' || chr(10) || 'A2: ' || s_nationkey as questions,
  '**Card 1 - Front:** ' || s_name || chr(10) || '**Back:** ' || s_suppkey as cards,
  '**1. Which?**' || chr(10) || '   A. [ ] x' || chr(10) || '   B. [X] ' || s_name || chr(10) || '   *Explanation: so*' as choices,
  '**1. Where?**' || chr(10) || '*Answer: ' || s_nationkey || '*' as answers from supplier""")
def study_numbering(t):
    rows = _analyses(t)
    return rows.select("title", study.questions().alias("questions"), study.cards().alias("cards"), study.choices().alias("choices"), study.answers("short_answers").alias("answers"))


def _analyses(t) -> DataFrame:
    return t("supplier").select(
        F.col("s_name").alias("title"), F.col("s_name").alias("source"), F.lit("Short.").alias("short"), F.lit(" Long. ").alias("detailed"), F.lit(3).alias("reading_time_minutes"), F.lit("easy").alias("difficulty"),
        F.array(F.struct(_say("What is ", F.col("s_name"), "? ").alias("question"), F.lit("A supplier").alias("answer")), F.struct(F.lit("Where?").alias("question"), F.col("s_nationkey").cast("string").alias("answer"))).alias("questions"),
        F.array(F.struct(F.col("s_name").alias("front"), F.col("s_suppkey").cast("string").alias("back"))).alias("cards"),
        F.array(F.struct(F.lit("Which?").alias("question"), F.array(F.lit("x"), F.col("s_name")).alias("options"), F.col("s_name").alias("correct"), F.lit("so").alias("explanation"))).alias("choices"),
        F.array(F.struct(F.lit("Where?").alias("question"), F.col("s_nationkey").cast("string").alias("answer"))).alias("short_answers"), F.array(F.lit("trade")).alias("tags"),
    )


_TOC = "Reading Time,Difficulty Level,Key Concepts,Definitions,Important Entities,Related Topics,Frequently Asked Questions,Flashcards,Multiple Choice Questions,Short Answer Questions,Tags,Metadata,References"


@query(f"select s_name as title, s_name || '.md' as filename, '{_TOC}' as contents, '{_TOC}' as headings, 'Short.' || chr(10) || chr(10) || 'Long.' as summary from supplier")
def study_notes(t):
    made = study.study_notes(_analyses(t))
    names = lambda shape: F.array_join(F.regexp_extract_all("markdown", F.lit(shape), F.lit(1)), ",")
    headings = F.regexp_replace(names(r"(?m)^## (.+)$"), "^Summary,Table of Contents,", "")
    summary = F.regexp_extract("markdown", r"(?s)## Summary\n\n(.*?)\n\n## Table", 1)
    return made.select("title", "filename", names(r"- \[\[#([^|\]]+)\|").alias("contents"), headings.alias("headings"), summary.alias("summary"))


@query("select 26 as nodes_added, 2 * 25 as edges_added from (select 1) where (select count(*) from nation) = 25")
def graph_build_counters(t):
    nodes = t("nation").select(_say("nation::", F.col("n_name")).alias("id")).unionByName(t.spark.createDataFrame([("world::all",)], "id string"))
    edges = t("nation").select(_say("nation::", F.col("n_name")).alias("source_id"), F.lit("world::all").alias("target_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("edge_type"))
    none = lambda df: df.limit(0)
    return G.build_counters((none(nodes), none(edges)), (nodes, edges)).select(F.col("nodes_added").cast("int").alias("nodes_added"), F.col("edges_added").cast("int").alias("edges_added"))


@query("select 'node' as kind, count(*) as rows, count(*) as parsed from nation union all select 'edge', count(*), count(*) from nation")
def graph_json_lines(t):
    nodes = t("nation").select(F.col("n_name").alias("id"), F.col("n_name").alias("label"), F.lit("entity").alias("node_type"), F.lit("s").alias("source"), F.expr("map('k', 'v')").alias("metadata"))
    edges = t("nation").select(F.col("n_name").alias("source_id"), F.lit("x").alias("target_id"), F.lit("e").alias("edge_type"), F.lit(1.0).alias("weight"), F.expr("map('k', 'v')").alias("metadata"))
    lines = G.graph_json(nodes, edges)
    return lines.groupBy("kind").agg(F.count("*").alias("rows"), F.count(F.get_json_object("json", "$.metadata.k")).alias("parsed"))


@query("select o_orderkey, 'PENDING' as status, o_orderstatus = 'P' as first from orders where o_orderstatus in ('P', 'O')")
def queue_recoverable(t):
    from docloom.operators import state as S

    status = F.when(F.col("o_orderstatus") == "P", "PROCESSING").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("DONE")
    return S.recoverable(t("orders").select("o_orderkey", status.alias("status"))).select("o_orderkey", "status", "first")


@query("select 0 as hits")
def blank_query(t):
    return R.service_search(R.corpus_of(t("documents"), t("embeddings"), indexed=False), " \t ", None).agg(F.count("*").cast("int").alias("hits"))
