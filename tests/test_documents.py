from __future__ import annotations

import io
import json
import zipfile
from datetime import datetime

import pytest

from docloom import cli, config
from docloom.operators import ocr
from docloom.sources import properties, workbook

WHEN = datetime(2024, 5, 1, 12)
FILES = "path string, modificationTime timestamp, length long, content binary"


def package(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


CORE = '<c xmlns:dc="d" xmlns:t="t"><dc:title> Plan </dc:title><dc:creator>Ada</dc:creator><t:created>2020-01-02T03:04:05Z</t:created><t:modified>none</t:modified></c>'
WORD = package(docProps__core=CORE, docProps__app='<p xmlns="e"><Pages>7</Pages></p>')
BOOK = json.dumps({"cells": [{}, {}], "metadata": {"kernelspec": {"display_name": "Py", "language": "python"}}}).encode()
SHEET = (
    '<w><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>b</t></is></c><c r="C1"/></row>'
    '<row r="3"><c r="A3"><v>1.5</v></c><c r="C3" t="b"><v>1</v></c></row><row r="4"><c r="B4"><v>9</v></c></row></sheetData>'
    '<mergeCells><mergeCell ref="B1:C1"/><mergeCell ref="A3:A9"/></mergeCells></w>'
)
XLSX = package(xl__workbook='<w><sheets><sheet name="S"/><sheet name="Gone"/></sheets></w>', xl__sharedStrings="<s><si><t>a</t></si></s>", xl__worksheets__sheet1=SHEET)


def test_properties(spark):
    rows = [("/x/a.docx", WORD), ("/x/bad.docx", b"no"), ("/x/n.ipynb", BOOK), ("/x/m.eml", b"Subject: Hi\nFrom: a@b\n\nt"), ("/x/s.mp3", b""), ("/x/t.txt", b"t"), ("/x/null.ipynb", None)]
    got = {r["source"]: r for r in properties.properties(spark.createDataFrame([(p, WHEN, 0, c) for p, c in rows], FILES)).collect()}
    a = got["/x/a.docx"]
    assert (a["title"], a["author"], a["page_count"], a["modified_at"], a["extractor"]) == ("Plan", "Ada", 7, WHEN, "docx")
    assert a["created_at"] is not None and got["/x/bad.docx"]["title"] == "bad"
    assert got["/x/n.ipynb"]["extra"] == {"cell_count": "2", "kernel": "Py", "language": "python"}
    assert got["/x/m.eml"]["title"] == "Hi" and got["/x/m.eml"]["extra"]["from"] == "a@b"
    assert got["/x/s.mp3"]["mime_type"] == "audio/mpeg"
    assert (got["/x/t.txt"]["extractor"], got["/x/t.txt"]["title"], got["/x/t.txt"]["extra"]) == ("<none>", None, {})
    assert got["/x/null.ipynb"]["title"] is None


def test_workbook(spark):
    want = (1, "S", ["a", "b", "b"], [["1.5", "", "True"], ["1.5", "9", ""]])
    assert workbook.tables(XLSX) == [want]
    assert workbook.tables(XLSX, header=False, max_columns=1) == [(1, "S", [], [["a"], ["1.5"], ["1.5"]])]
    assert workbook.place("$AB$12") == (11, 27)
    got = workbook.workbook_tables(spark.createDataFrame([("g", WHEN, 0, XLSX), ("b", WHEN, 0, b"x")], FILES)).collect()
    assert {(r["source"], r["sheet"], r["reason"]) for r in got} == {("g", 1, None), ("b", None, "BadZipFile")}


def test_ocr(spark):
    def describe(image: bytes) -> str:
        if image == b"broken":
            raise OSError("no model")
        return image.decode()

    service = ocr.OcrService(ocr.vision(describe), ocr.Engine("plain", frozenset({"image"}), lambda image: (image.decode(), 0.5)))
    assert service.select("image").name == "vision" and service.select("image", "plain").name == "plain"
    with pytest.raises(ocr.NoEngine):
        service.select("scanned_pdf", "plain")
    rows = [("a", 1, b""), ("a", 0, b"one"), ("a", 2, b"never"), ("b", 0, b"broken"), ("b", 1, b"x"), *(("c", i, b"p") for i in range(9))]
    pages = spark.createDataFrame(rows, "source string, page_no int, image binary")
    got = sorted((r["source"], r["page_no"], r["text"], r["confidence"]) for r in service.read(pages, "scanned_pdf").collect())
    assert got == [("a", 0, "one", None), ("a", 1, "", None), ("b", 0, "", None), *(("c", i, "p", None) for i in range(5))]
    plain = service.read(pages.where("source = 'c'"), "image", "plain").collect()
    assert len(plain) == 9 and {r["confidence"] for r in plain} == {0.5}
    heard = ocr.transcribe(spark.createDataFrame([("s", b"x"), ("n", None)], "source string, content binary"), lambda c: ["a", "b "]).collect()
    assert {tuple(r) for r in heard} == {("s", "a b"), ("n", "")}


def test_config(tmp_path, capsys):
    (tmp_path / "default.yaml").write_text("a: {b: 1, c: [1]}\nd: x\n")
    (tmp_path / "test.yaml").write_text("a: {b: 2}\n")
    got = config.load(str(tmp_path), "test", {"DOCLOOM_A__C": "[2, 3]", "DOCLOOM_BAD____X": "1", "OTHER": "1", "DOCLOOM_D": "null"})
    assert got == {"a": {"b": 2, "c": [2, 3]}, "d": None, "app": {"environment": "test"}}
    (tmp_path / "list.yaml").write_text("- 1\n")
    for name, bad in ((str(tmp_path), "list"), (str(tmp_path / "none"), None)):
        with pytest.raises(config.ConfigError):
            config.load(name, bad, {})
    cli.main(["config", str(tmp_path), "--environment", "test"])
    cli.main(["--store", str(tmp_path), "doctor"])
    out = capsys.readouterr().out
    assert '"environment": "test"' in out and "pyspark\tOK" in out
