"""Study notes: the sections of an analysed document as column expressions, and the note that holds them.

Sections without content are left out, but for those that every note has. Lists are numbered by their place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.notes import quoted, safe_name, wiki_link

#: The columns of an analysis that a note is made of; a missing one counts as empty.
ANALYSIS: dict[str, str] = {
    "title": "string", "source": "string", "source_type": "string", "short": "string", "detailed": "string", "reading_time_minutes": "int", "difficulty": "string",
    "keywords": "array<string>", "categories": "array<string>", "tables": "string", "concepts": "array<string>", "definitions": "array<struct<name:string,text:string>>",
    "entities": "array<string>", "topics": "array<string>", "related": "array<string>", "backlinks": "array<string>",
    "questions": "array<struct<question:string,answer:string>>", "cards": "array<struct<front:string,back:string>>",
    "choices": "array<struct<question:string,options:array<string>,correct:string,explanation:string>>",
    "short_answers": "array<struct<question:string,answer:string>>", "long_answers": "array<struct<question:string,answer:string>>",
    "revision": "array<string>", "tags": "array<string>", "metadata": "map<string,string>",
}


def _items(column: str, one: Callable[[Column, Column], Column], between: str = "\n") -> Column:
    """The items of a list in order, each made of the item and its number from 1; null for no items."""
    made = F.transform(column, lambda x, i: one(x, (i + 1).cast("string")))
    return F.when(F.size(column) > 0, F.array_join(made, between))


def _say(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts))


def bullets(column: str, link: bool = False) -> Column:
    return _items(column, lambda x, _: _say("- ", wiki_link(F.trim(x)) if link else F.trim(x)))


def questions(column: str = "questions") -> Column:
    """Q1 and A1, Q2 and A2, …"""
    return _items(column, lambda x, n: _say("**Q", n, ": ", F.trim(x["question"]), "**\nA", n, ": ", F.trim(x["answer"])), "\n\n")


def cards(column: str = "cards") -> Column:
    return _items(column, lambda x, n: _say("**Card ", n, " - Front:** ", F.trim(x["front"]), "\n**Back:** ", F.trim(x["back"])), "\n\n")


def answers(column: str) -> Column:
    return _items(column, lambda x, n: _say("**", n, ". ", F.trim(x["question"]), "**\n*Answer: ", F.trim(x["answer"]), "*"), "\n\n")


def choices(column: str = "choices") -> Column:
    """Numbered questions with lettered options; the right one is marked."""

    def one(x: Column, n: Column) -> Column:
        options = F.transform(x["options"], lambda o, j: _say("   ", F.char(j + 65), ". [", F.when(o == x["correct"], "X").otherwise(" "), "] ", o))
        note = F.when(F.coalesce(x["explanation"], F.lit("")) != "", _say("\n   *Explanation: ", F.trim(x["explanation"]), "*"))
        return _say("**", n, ". ", F.trim(x["question"]), "**\n", F.array_join(options, "\n"), note)

    return _items(column, one, "\n\n")


def definitions(column: str = "definitions") -> Column:
    return _items(column, lambda x, _: _say("- **", F.trim(x["name"]), "**: ", F.trim(x["text"])))


def metadata(column: str = "metadata") -> Column:
    """Entries by key."""
    pairs = F.array_sort(F.map_entries(column))
    return F.when(F.size(pairs) > 0, F.array_join(F.transform(pairs, lambda e: _say("- ", e["key"], ": ", e["value"])), "\n"))


def sections() -> list[tuple[str, Column, str | None]]:
    """(heading, body, what stands there without content; None: the section is left out) in order, without the summary."""
    return [
        ("Reading Time", _say("**", F.col("reading_time_minutes").cast("string"), " minutes**"), ""),
        ("Difficulty Level", _say("**", F.initcap("difficulty"), "**"), ""),
        ("Keywords", bullets("keywords"), None),
        ("Categories", bullets("categories"), None),
        ("Tables", F.col("tables"), None),
        ("Key Concepts", bullets("concepts", True), "- None found."),
        ("Definitions", definitions(), "- None found."),
        ("Important Entities", bullets("entities"), "- None found."),
        ("Related Topics", bullets("topics", True), "- None found."),
        ("Suggested Related Notes", bullets("related", True), None),
        ("Suggested Backlinks", bullets("backlinks", True), None),
        ("Frequently Asked Questions", questions(), None),
        ("Flashcards", cards(), None),
        ("Multiple Choice Questions", choices(), None),
        ("Short Answer Questions", answers("short_answers"), None),
        ("Long Answer Questions", answers("long_answers"), None),
        ("Revision Notes", bullets("revision"), None),
        ("Tags", _items("tags", lambda x, _: _say("#", x), " "), "- None."),
        ("Metadata", metadata(), "- None."),
        ("References", _say("- Source: ", F.col("source")), ""),
    ]


def study_notes(analyses: DataFrame) -> DataFrame:
    """(title, source, filename, markdown) of analyses with any of the ANALYSIS columns.

    The table of contents stands after the summary and names the sections that the note has.
    """
    absent = {c: F.lit(None).cast(kind) for c, kind in ANALYSIS.items() if c not in analyses.columns}
    rows = analyses.withColumns(absent).withColumn("title", F.coalesce(F.nullif(F.trim(F.regexp_replace("title", r"\s+", " ")), F.lit("")), F.lit("Untitled")))
    made = []
    for name, body, empty in sections():
        filled = F.when(F.trim(body) != "", body)
        made.append((name, filled if empty is None else F.coalesce(filled, F.lit(empty))))
    front = F.concat_ws("\n", F.lit("---"), _say("title: ", quoted(F.col("title"))), _say("source: ", quoted(F.coalesce("source", F.lit("")))), F.when(F.size("tags") > 0, _say("tags:\n", _items("tags", lambda x, _: _say("  - ", x)))), F.lit("---"))
    contents = F.concat_ws("\n", *(F.when(b.isNotNull(), F.lit(f"- [[#{n}|{n}]]")) for n, b in made))
    summary = F.concat_ws("\n\n", *(F.nullif(F.trim(c), F.lit("")) for c in ("short", "detailed")))
    parts = [F.when(b.isNotNull(), F.concat(F.lit(f"## {n}\n\n"), b)) for n, b in made]
    body = F.concat_ws("\n\n", front, _say("# ", F.col("title")), F.concat(F.lit("## Summary\n\n"), summary), F.concat(F.lit("## Table of Contents\n\n"), contents), *parts)
    return rows.select("title", "source", F.concat(safe_name(F.col("title")), F.lit(".md")).alias("filename"), F.concat(body, F.lit("\n")).alias("markdown"))
