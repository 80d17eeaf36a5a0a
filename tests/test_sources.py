from __future__ import annotations

import email.message
import io
import json
import sqlite3
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import columns as C
from docloom.sources import files, formats, store
from docloom.streaming.watch import replay, watch, windowed_stats


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda name, data: (tmp_path / "in" / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    put("note.md", "# Title\n\nSome   text.")
    put("empty.md", "  \n")
    put("bad.txt", b"\xff\xfe\xfa")
    put("table.csv", "a,b\n1,2\n")
    put("nb.ipynb", json.dumps({"cells": [{"cell_type": "markdown", "source": ["# N"]}, {"cell_type": "code", "source": "x = 1"}]}))
    put("refs.bib", "@article{k1,\n title = {T},\n year = {2020}\n}\n")
    put("d.drawio", '<m><mxCell value="A"/><mxCell value="&lt;b&gt;B&lt;/b&gt;"/></m>')
    put(".hidden.md", "# no")
    put("x.unknown", "?")
    with zipfile.ZipFile(tmp_path / "in" / "a.zip", "w") as z:
        z.writestr("b.txt", "hello")
        z.writestr("a.txt", "hi")
    db = sqlite3.connect(tmp_path / "in" / "t.sqlite")
    db.execute("create table people (name text, age int)")
    db.executemany("insert into people values (?, ?)", [("x", 1)] * 7)
    db.commit()
    db.close()
    m = email.message.EmailMessage()
    m["Subject"], m["From"], m["To"] = "Hello", "a@example.com", "b@example.com"
    m.set_content("body text")
    m.add_attachment(b"# Att\n\ninner", maintype="text", subtype="markdown", filename="att.md")
    put("mail.eml", m.as_bytes())
    return tmp_path


def test_ingest(spark, folder):
    good, bad = files.ingest(spark, f"file://{folder}/in")
    got = {r["filename"]: r for r in good.collect()}
    assert got["note.md"]["title"] == "Title" and got["note.md"]["text"] == "# Title\n\nSome text."
    assert got["nb.ipynb"]["text"] == "# N\n\n```python\nx = 1\n```"
    assert got["refs.bib"]["text"] == "Citation Key: k1\ntitle: T\nyear: 2020"
    assert "- A" in got["d.drawio"]["text"] and "- B" in got["d.drawio"]["text"]
    assert "Files: 2" in got["a.zip"]["text"] and got["a.zip"]["text"].index("a.txt") < got["a.zip"]["text"].index("b.txt")
    assert "Rows: 7" in got["t.sqlite"]["text"] and "Sample (5 of 7 rows):" in got["t.sqlite"]["text"]
    assert "body text" in got["mail.eml"]["text"]
    assert got["att.md"]["parent_id"].endswith("mail.eml") and got["att.md"]["title"] == "Att"
    assert {r["source"].rsplit("/", 1)[1] for r in bad.collect()} == {"empty.md", "bad.txt"}
    assert ".hidden.md" not in got and "x.unknown" not in got


def test_packages():
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:d>')
    assert formats.word(word.getvalue(), "a.docx")[0] == "One\nTwo"
    sheet = io.BytesIO()
    with zipfile.ZipFile(sheet, "w") as z:
        z.writestr("xl/workbook.xml", '<w xmlns="u"><sheets><sheet name="S"/></sheets></w>')
        z.writestr("xl/sharedStrings.xml", '<s xmlns="u"><si><t>name</t></si></s>')
        z.writestr("xl/worksheets/sheet1.xml", '<w xmlns="u"><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></w>')
    assert formats.spreadsheet(sheet.getvalue(), "a.xlsx")[0] == "Sheet: S\n| name | 7 |"
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("META-INF/container.xml", '<c><rootfile full-path="O/p.opf"/></c>')
        z.writestr("O/p.opf", '<p><title>Book</title><item id="i" href="x.html"/><itemref idref="i"/></p>')
        z.writestr("O/x.html", "<p>Hello <b>you</b></p>")
    assert formats.book(book.getvalue(), "a.epub")[:2] == ("Hello you", "Book")
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("f.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    assert "Format: TAR" in formats.archive(tar.getvalue(), "x.tar.gz")[0]
    for bad in (b"", b"zip?"):
        with pytest.raises(formats.Unreadable):
            formats.archive(bad, "x.zip")
    with pytest.raises(formats.Unreadable):
        formats.READERS["pdf"](b"%PDF-", "a.pdf")


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(C.tokens(F.lit("Hello, WORLD! my_var 2x"))) == ["hello", "world", "my_var", "2x"]
    assert value(C.language(F.lit("the cat is on the mat and it was not for you"))).language == "en"
    assert value(C.language(F.lit("der Hund ist nicht auf dem Tisch und die Katze auch nicht"))).language == "de"
    assert tuple(value(C.language(F.lit("こんにちは")))) == ("ja", 0.95)
    for blank in ("", "xyzabc 12345", "the " + "zzz " * 20):
        assert tuple(value(C.language(F.lit(blank)))) == ("en", 0.0)
    assert value(C.extension(F.lit("/a/b.TAR.Gz"))) == ".gz" and value(C.extension(F.lit(".env"))) == ""
    assert value(C.video_id(F.lit("https://youtu.be/abc?t=1"))) == "abc" and value(C.video_id(F.lit("https://www.youtube.com/watch?v=q"))) == "q"
    assert tuple(value(C.repository(F.lit("https://github.com/a/b.git")))) == ("a", "b")
    assert value(C.column_index(F.lit("AA3"))) == 26
    assert [value(C.sniff_mime(F.lit(x))) for x in (b"%PDF-1", b"{}", b"# hi", b"plain", b"", b"\x00\x01\x02\xff" * 9)] == ["application/pdf", "application/json", "text/markdown", "text/plain", "text/plain", "application/octet-stream"]
    assert value(C.pdf_datetime(F.lit("D:20200102030405"))).year == 2020 and value(C.pdf_datetime(F.lit("x"))) is None


def test_upsert_keeps_places(spark):
    schema = "id string, seq long, text string"
    old = spark.createDataFrame([("a", 0, "1"), ("b", 1, "2")], schema)
    new = spark.createDataFrame([("b", 0, "new"), ("c", 1, "3")], schema)
    assert sorted(tuple(r) for r in store.upsert_vectors(old, new).collect()) == [("a", 0, "1"), ("b", 1, "new"), ("c", 3, "3")]


def test_versions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert store.read_latest(spark, path) is None
    for v in (1, 2):
        store.write_version(spark.range(v), path, v)
    assert store.read_latest(spark, path).count() == 2


def test_watch_drops_known_content(spark, folder):
    out, check = f"file://{folder}/out", f"file://{folder}/check"
    watch(spark, f"file://{folder}/in", out, check).awaitTermination()
    (folder / "in" / "copy.md").write_text("# Title\n\nSome   text.")
    (folder / "in" / "new.md").write_text("# Other")
    watch(spark, f"file://{folder}/in", out, check).awaitTermination()
    done = spark.read.parquet(f"{out}/manifest/*")
    assert done.count() == done.select("sha256").distinct().count()
    names = {r[0] for r in done.select("original_filename").collect()}
    assert "new.md" in names and "copy.md" not in names and "note.md" in names
    stats = spark.read.parquet(f"{out}/stats/*")
    assert stats.agg(F.sum("skipped_duplicates")).first()[0] == 1


def test_replay_equals_batch(spark, tmp_path):
    events = spark.range(200).select(F.timestamp_seconds(F.col("id") * 100).alias("ts"), (F.col("id") % 3).cast("string").alias("kind"), F.col("id").cast("double").alias("value"))
    events.repartition(4).write.parquet(f"{tmp_path}/e")
    run = lambda df: windowed_stats(df, "ts", "1 hour", "1 day", "kind")
    got = replay(spark, f"{tmp_path}/e", events.schema.simpleString().replace("struct<", "").rstrip(">").replace(":", " "), run, "replayed", f"{tmp_path}/c")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, run(events).collect()))
