"""Tables of .xlsx workbooks: one a sheet, with the values of merged cells filled in. Standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from docloom.operators.tables import MAX_COLUMNS, MAX_ROWS

_ROWS = "source string, sheet int, title string, header array<string>, rows array<array<string>>, reason string"


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _texts(e: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in e.iter() if _tag(t) == "t")


def place(ref: str) -> tuple[int, int]:
    """(row, column) from 0 of a reference such as AB12."""
    letters, digits = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", ref).groups()
    column = 0
    for c in letters.upper():
        column = 26 * column + ord(c) - 64
    return int(digits) - 1, column - 1


def _value(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return _texts(cell)
    raw = next((v.text for v in cell if _tag(v) == "v"), None)
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    return str(raw == "1") if kind == "b" else raw


def _grid(sheet: ElementTree.Element, shared: list[str], most: int) -> list[list[str | None]]:
    """The sheet's first ``most`` rows as a full rectangle, merged ranges filled from their first cell."""
    cells: dict[tuple[int, int], str | None] = {}
    row = -1
    for r in (e for e in sheet.iter() if _tag(e) == "row"):
        row = int(r.get("r", row + 2)) - 1
        column = -1
        for c in (e for e in r if _tag(e) == "c"):
            column = place(c.get("r"))[1] if c.get("r") else column + 1
            if row < most:
                cells[row, column] = _value(c, shared)
    if not cells:
        return []
    height, width = (1 + max(p[i] for p in cells) for i in (0, 1))
    for merge in (e.get("ref", "") for e in sheet.iter() if _tag(e) == "mergeCell"):
        (top, left), (bottom, right) = (place(x) for x in (merge.split(":") * 2)[:2])
        for y in range(top, min(bottom, height - 1) + 1):
            for x in range(left, min(right, width - 1) + 1):
                if cells.get((y, x)) is None:
                    cells[y, x] = cells.get((top, left))
    return [[cells.get((y, x)) for x in range(width)] for y in range(height)]


def tables(data: bytes, header: bool = True, max_rows: int = MAX_ROWS, max_columns: int = MAX_COLUMNS) -> list[tuple[int, str, list[str], list[list[str]]]]:
    """(sheet from 1, title, header, rows) of each sheet with any value; blank rows go. The limits are the feature."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        parsed = lambda part: ElementTree.fromstring(z.read(part))
        shared = [_texts(x) for x in parsed("xl/sharedStrings.xml") if _tag(x) == "si"] if "xl/sharedStrings.xml" in names else []
        targets = {}
        if "xl/_rels/workbook.xml.rels" in names:
            targets = {e.get("Id"): "xl/" + e.get("Target", "").removeprefix("/xl/") for e in parsed("xl/_rels/workbook.xml.rels")}
        out = []
        for i, s in enumerate((e for e in parsed("xl/workbook.xml").iter() if _tag(e) == "sheet"), 1):
            link = next((v for k, v in s.attrib.items() if k.endswith("}id")), None)
            part = targets.get(link, f"xl/worksheets/sheet{i}.xml")
            if part not in names:
                continue
            grid = [r for r in _grid(parsed(part), shared, max_rows + 1) if any(v is not None and v.strip() for v in r)]
            lines = [[v or "" for v in r[:max_columns]] for r in grid]
            if lines:
                head, body = (lines[0], lines[1:]) if header else ([], lines)
                out.append((i, s.get("name", ""), head, body[:max_rows]))
    return out


def workbook_tables(files: DataFrame) -> DataFrame:
    """A row per sheet of scanned workbooks (path, content); an unreadable one is a row with its reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f in b.itertuples():
                try:
                    rows += [(f.path, *t, None) for t in tables(bytes(f.content))]
                except Exception as error:  # a broken file never fails a task
                    rows.append((f.path, None, None, None, None, type(error).__name__))
            yield pd.DataFrame(rows, columns=["source", "sheet", "title", "header", "rows", "reason"]).astype({"sheet": "Int32"})

    return files.select("path", "content").mapInPandas(run, _ROWS)
