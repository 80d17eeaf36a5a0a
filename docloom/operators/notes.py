"""Notes as a table: rendering, managed blocks, index, overview, placeholders, backlinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<!-- docloom:begin -->", "<!-- docloom:end -->"
RECENT = 10


def safe_name(title: Column) -> Column:
    return F.regexp_replace(title, r'[\\/:*?"<>|]', "_")


def wiki_link(title: Column) -> Column:
    return F.concat(F.lit("[["), title, F.lit("]]"))


def quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def render(notes: DataFrame, sections: list[tuple[str, Column]]) -> DataFrame:
    """Add markdown: front matter, contents, then each non-empty section in order (null or blank ones are left out)."""
    tags = F.concat(F.lit("tags:\n"), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("  - "), t)), "\n"))
    front = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), quoted(F.col("title"))), F.concat(F.lit("source: "), quoted(F.col("source").cast("string"))), F.when(F.size("tags") > 0, tags), F.lit("---"))
    filled = [(name, F.when(F.trim(body) != "", body)) for name, body in sections]
    contents = F.concat_ws("\n", F.lit("## Contents"), *(F.when(b.isNotNull(), F.lit(f"- [[#{n}]]")) for n, b in filled))
    parts = [F.concat(F.lit(f"## {n}\n\n"), b) for n, b in filled]
    body = F.concat_ws("\n\n", front, F.concat(F.lit("# "), F.col("title")), contents, *parts)
    return notes.withColumn("markdown", F.concat(F.lit(f"{BEGIN}\n"), body, F.lit(f"\n{END}\n")))


def merge_managed(old: Column, new: Column) -> Column:
    """Replace what stands between the markers; without markers the new block is appended."""
    at, stop = F.instr(old, BEGIN), F.instr(old, END)
    inner = F.concat(F.substr(old, F.lit(1), at - 1), F.regexp_replace(new, r"^\s+|\s+$", ""), F.substr(old, stop + len(END)))
    return F.when(old.isNull(), new).when((at > 0) & (stop > at), inner).otherwise(F.concat(F.regexp_replace(old, r"\s+$", ""), F.lit("\n\n"), new))


def upsert(stored: DataFrame, made: DataFrame) -> DataFrame:
    """Notes by source: a known source keeps its file name and gets its managed block replaced; others are added with free names."""
    new = made.select("source", F.col("title").alias("__t"), F.col("filename").alias("__f"), F.col("markdown").alias("__m"))
    both = stored.join(new, "source", "full_outer")
    merged = both.select(
        "source", F.coalesce("__t", "title").alias("title"), F.coalesce("filename", "__f").alias("filename"),
        F.when(F.col("__m").isNull(), F.col("markdown")).otherwise(merge_managed(F.col("markdown"), F.col("__m"))).alias("markdown"), F.col("filename").isNotNull().alias("known"),
    )
    return free_names(merged)


def free_names(notes: DataFrame) -> DataFrame:
    """`name.md`, `name 2.md`, …: stored notes keep theirs, later sources count up."""
    order = Window.partitionBy("filename").orderBy(F.desc("known"), "source")
    n = F.row_number().over(order)
    stem = F.regexp_replace("filename", r"\.md$", "")
    return notes.withColumn("__n", n).withColumn("filename", F.when(F.col("__n") == 1, F.col("filename")).otherwise(F.concat(stem, F.lit(" "), F.col("__n").cast("string"), F.lit(".md")))).drop("__n")


def index_lines(notes: DataFrame) -> DataFrame:
    """(stem, line) of the index, sorted by stem without case by its reader."""
    stem = F.regexp_replace("filename", r"\.md$", "")
    return notes.select(stem.alias("stem"), F.concat(F.lit("- [["), stem, F.lit("|"), F.col("title"), F.lit("]]")).alias("line"), F.lower(stem).alias("sort_key"))


def log_line(at: Column) -> Column:
    """The log entry of a note (title, filename, source, created) that was written at a time."""
    stem = F.regexp_replace("filename", r"\.md$", "")
    done = F.when(F.col("created"), "created").otherwise("updated")
    return F.concat(F.lit("- "), at, F.lit(" - "), done, F.lit(" [["), stem, F.lit("|"), F.col("title"), F.lit("]] from "), F.col("source").cast("string"), F.lit("\n"))


def overview(notes: DataFrame) -> DataFrame:
    """One row: notes, distinct sources, and the last ten stems of the index order."""
    totals = notes.agg(F.count("*").alias("notes"), F.countDistinct("source").alias("sources"))
    last = index_lines(notes).orderBy(F.desc("sort_key"), F.desc("stem")).limit(RECENT)
    recent = last.agg(F.transform(F.array_sort(F.collect_list(F.struct("sort_key", "stem"))), lambda x: x["stem"]).alias("recent"))
    return totals.crossJoin(recent).select("notes", "sources", F.array_join("recent", ",").alias("recent"))


def placeholders(notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stub notes for wanted titles (title, backlink) that have no file: one each, linked from the first note that wants it."""
    missing = wanted.withColumn("filename", F.concat(safe_name(F.col("title")), F.lit(".md"))).join(notes.select("filename").distinct(), "filename", "left_anti")
    first = missing.groupBy("filename").agg(F.min_by("title", F.struct("backlink", "title")).alias("title"), F.min("backlink").alias("backlink"))
    body = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n> Placeholder, referenced by "), wiki_link(F.col("backlink")), F.lit("\n\n## Backlinks\n\n- "), wiki_link(F.col("backlink")), F.lit("\n"))
    return first.withColumn("markdown", body)


def backlinks(notes: DataFrame, stem: str, title: str) -> DataFrame:
    """Append a backlink to every other note that has no backlinks section."""
    add = F.lit(f"\n\n## Backlinks\n\n- [[{stem}|{title}]]\n")
    other = (F.col("filename") != f"{stem}.md") & ~F.col("markdown").contains("## Backlinks")
    return notes.withColumn("markdown", F.when(other, F.concat(F.regexp_replace("markdown", r"\s+$", ""), add)).otherwise(F.col("markdown")))


def front_matter(markdown: Column, key: str) -> Column:
    """A value of the front matter, unquoted; null if absent."""
    block = F.regexp_extract(markdown, r"(?s)(?:^|\n)---\n(.*?)\n---", 1)
    value = F.regexp_extract(block, rf"(?m)^{key}:\s*(.*)$", 1)
    plain = F.replace(F.replace(F.regexp_replace(value, '^"|"$', ""), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.nullif(plain, F.lit(""))
