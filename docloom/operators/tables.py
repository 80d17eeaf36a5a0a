"""Tables in texts: CSV extraction, Markdown rendering, code and notebook structure."""

from __future__ import annotations

import ast
import csv
import io
import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.tables import CODE_LINES
from docloom.operators.text import per_text

MAX_ROWS, MAX_COLUMNS, SAMPLE = 200, 30, 4096
TABLE = "array<struct<header:array<string>,rows:array<array<string>>>>"
CODE = "array<struct<kind:string,name:string,parent:string,args:array<string>,doc:string,start_line:int,end_line:int>>"


def parse_csv(text: str) -> tuple[list[str], list[list[str]]] | None:
    """(header, rows): the delimiter is guessed, blank rows go, the first row is the header."""
    if not text:
        return None
    try:
        dialect = csv.Sniffer().sniff(text[:SAMPLE], delimiters=",;\t")
    except csv.Error:
        dialect = csv.excel
    rows = []
    for row in csv.reader(io.StringIO(text), dialect):
        rows.append([c.strip() for c in row[:MAX_COLUMNS]])
        if len(rows) > MAX_ROWS:
            break
    if not rows:
        return None
    body = [r for r in rows[1:] if any(r)]
    return (rows[0], body) if any(rows[0]) or body else None


_csv_tables = per_text(lambda text: [t] if (t := parse_csv(text)) else [], TABLE)


def csv_table(text: Column) -> Column:
    """struct(header, rows) of CSV text; null where there is no table."""
    return F.get(_csv_tables(text), F.lit(0))



def escape_cell(cell: Column) -> Column:
    return F.replace(F.replace(F.coalesce(cell, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def markdown_table(header: Column, rows: Column) -> Column:
    """A Markdown table; short rows are filled up to the widest; nothing for an empty table."""
    width = F.greatest(F.size(header), F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0)))
    fill = lambda cells: markdown_row(F.concat(F.transform(cells, escape_cell), F.array_repeat(F.lit(""), width - F.size(cells))))
    lines = F.concat(F.array(fill(header), markdown_row(F.array_repeat(F.lit("---"), width))), F.transform(rows, fill))
    return F.when(width > 0, F.array_join(lines, "\n")).otherwise(F.lit(""))


def table_from_rows(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row, markdown: a small result rendered as a table."""
    cells = F.array(*(F.col(c).cast("string") for c in columns))
    packed = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), cells.alias("c")))), lambda x: x["c"]).alias("rows"))
    return packed.select(markdown_table(F.array(*map(F.lit, columns)), F.col("rows")).alias("markdown"))


def _python_items(tree: ast.AST) -> list[tuple]:
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [("import", a.name, None, [], None, node.lineno, node.end_lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append(("import", "." * node.level + (node.module or ""), None, [a.name for a in node.names], None, node.lineno, node.end_lineno))
    scopes = [(None, tree)]
    while scopes:
        parent, scope = scopes.pop()
        for node in getattr(scope, "body", []):
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "method" if parent else "function"
                out.append((kind, node.name, parent, [a.arg for a in node.args.args], ast.get_docstring(node), node.lineno, node.end_lineno))
            elif isinstance(node, ast.ClassDef):
                out.append(("class", node.name, parent, [ast.unparse(b) for b in node.bases], ast.get_docstring(node), node.lineno, node.end_lineno))
                scopes.append((node.name, node))
    return sorted(out, key=lambda x: (x[5], x[0], x[1]))


_SHAPES = [(kind, re.compile(shape)) for kind, shape in CODE_LINES]


def code_items(text: str, python: bool = True) -> list[tuple]:
    """Imports, functions, classes and methods with their lines; broken Python and other languages by line shapes."""
    if python:
        try:
            return _python_items(ast.parse(text))
        except (SyntaxError, ValueError):
            pass
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        for kind, shape in _SHAPES:
            if hit := shape.match(line.strip()):
                out.append((kind, hit[1], None, [], None, n, n))
                break
    return out


python_code = per_text(code_items, CODE)
other_code = per_text(lambda t: code_items(t, python=False), CODE)

NOTEBOOK = "struct<cells:array<struct<id:string,cell_type:string,source:array<string>,execution_count:int>>,metadata:struct<kernelspec:struct<name:string,language:string>>>"


def notebook_cells(docs: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """One row per cell of notebook JSON; text that is no notebook gives none."""
    parsed = docs.select(F.col(key), F.from_json(F.col(text), NOTEBOOK).alias("n"))
    cells = parsed.select(key, F.col("n.metadata.kernelspec.name").alias("kernel"), F.posexplode("n.cells").alias("cell", "c"))
    return cells.select(key, "kernel", "cell", "c.id", "c.cell_type", F.array_join("c.source", "").alias("source_text"), "c.execution_count")


def diagram_mermaid(labels: Column) -> Column:
    """A Mermaid flow chart of labels in order."""
    nodes = F.transform(labels, lambda x, i: F.concat(F.lit("    n"), i.cast("string"), F.lit('["'), F.replace(x, F.lit('"'), F.lit("'")), F.lit('"]')))
    return F.concat(F.lit("flowchart TD\n"), F.array_join(nodes, "\n"))


def drawio_labels(xml: Column) -> Column:
    values = F.filter(F.xpath(xml, F.lit("//mxCell/@value")), lambda x: F.trim(x) != "")
    return F.transform(values, lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", "")))


DRAWING = "struct<nodes:array<struct<id:string,label:string>>,edges:array<struct<source:string,target:string,label:string>>>"


def _drawing(xml: str) -> tuple[list[tuple[str, str]], list[tuple[str, str, str]]]:
    """Labelled nodes and edges of a diagram; of nodes of one id the last label counts, at the place of the first one."""
    try:
        cells = [c for c in ElementTree.fromstring(xml).iter("mxCell") if c.get("id")]
    except ElementTree.ParseError:
        return [], []
    name = lambda x: y if (y := re.sub("[^A-Za-z0-9_]", "_", x))[:1].isalpha() else f"n_{y}"
    label = lambda c: re.sub("<[^>]+>", "", c.get("value", "").strip()).strip().replace('"', "'")
    nodes: dict[str, str] = {}
    edges = []
    for c in cells:
        style = c.get("style", "")
        line = c.get("edge") in ("1", "true") or "edgeStyle" in style or "rounded=0" in style
        if line and c.get("source") and c.get("target"):
            edges.append((name(c.get("source")), name(c.get("target")), label(c)))
        elif label(c):
            nodes[name(c.get("id"))] = label(c)
    return list(nodes.items()), edges


def drawio_drawing(xml: Column) -> Column:
    """struct(nodes, edges) of draw.io XML; both empty for what is no XML."""

    def batch(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_drawing(t if isinstance(t, str) else "") for t in texts], columns=["nodes", "edges"])

    return F.pandas_udf(batch, DRAWING)(xml)


def flowchart(drawing: Column) -> Column:
    """A Mermaid flow chart of a drawing: nodes, then edges; empty without a node."""
    quoted = lambda n: F.concat(F.lit("    "), n["id"], F.lit('["'), n["label"], F.lit('"]'))
    nodes = F.transform(drawing["nodes"], lambda n: F.when(n["id"] == F.replace(n["label"], F.lit(" "), F.lit("_")), F.concat(F.lit("    "), n["id"])).otherwise(quoted(n)))
    arrow = lambda e: F.when(e["label"] != "", F.concat(F.lit(' -->|"'), e["label"], F.lit('"| '))).otherwise(F.lit(" --> "))
    edges = F.transform(drawing["edges"], lambda e: F.concat(F.lit("    "), e["source"], arrow(e), e["target"]))
    return F.when(F.size(drawing["nodes"]) == 0, "").otherwise(F.array_join(F.concat(F.array(F.lit("flowchart LR")), nodes, edges), "\n"))
