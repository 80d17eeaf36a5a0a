"""Rules of model clients, validated analyses, routed processors, diagrams."""

from __future__ import annotations

import json

import pytest

from docloom.operators import models as M
from docloom.operators import ocr, processors, registry
from docloom.operators import tables as T
from pyspark.sql import functions as F


def _served(*answers):
    """A server that gives these answers in turn, the waits it caused and its calls."""
    left, waits = list(answers), []

    def call():
        now = left.pop(0)
        if isinstance(now, BaseException):
            raise now
        return now

    return call, waits, left


@pytest.mark.parametrize(
    ("answers", "wanted", "waits"),
    [
        ([" yes \n"], "yes", []),
        ([M.ServiceError(500), M.ServiceError(503), "yes"], "yes", [0.5, 1.0]),
        ([M.ServiceError(500)] * 3, M.BadAnswer, [0.5, 1.0]),
        ([M.ServiceError(404), "yes"], M.NoSuchModel, []),
        ([M.ServiceError(400), "yes"], M.BadAnswer, []),
        ([TimeoutError(), "yes"], "yes", [0.5]),
        ([TimeoutError()] * 3, M.TimedOut, [0.5, 1.0]),
        ([ConnectionResetError()] * 3, M.Unreachable, [0.5, 1.0]),
        (["", "yes"], M.BadAnswer, []),
        ([7, "yes"], M.BadAnswer, []),
        ([KeyError("x"), "yes"], KeyError, []),
    ],
)
def test_client_rules(answers, wanted, waits):
    call, slept, _ = _served(*answers)
    if isinstance(wanted, str):
        assert M.call_service(call, 2, 0.5, slept.append) == wanted
    else:
        with pytest.raises(wanted):
            M.call_service(call, 2, 0.5, slept.append)
    assert slept == waits


def test_generate_json_rows(spark):
    docs = spark.createDataFrame([(1, "good"), (2, "prose"), (3, None), (4, "list")], "id long, p string")
    said = {"good": '{"a": 1}', "prose": "no json", "list": "[1"}
    got = {r["id"]: r for r in M.generate_json(docs, F.col("p"), said.__getitem__, "a long").collect()}
    assert got[1]["answer"]["a"] == 1 and got[1]["answer_error"] is None
    assert got[2]["answer"] is None and got[4]["answer"] is None and "schema" in got[2]["answer_error"] and "schema" in got[4]["answer_error"]
    assert got[3]["answer"] is None and got[3]["answer_error"] is None


def test_analysis_is_asked_for_again(spark):
    good = json.dumps({"title": "T", "summary": "s", "concepts": [{"name": "c", "importance": "high"}]})
    bad = json.dumps({"title": "T", "concepts": [{"name": "c", "importance": "huge"}]})

    def server(prompt):
        again = M.AGAIN in prompt
        if "late" in prompt:
            return good if again else "{}"
        if "never" in prompt:
            return bad
        if "gone" in prompt:
            raise M.ServiceError(404)
        return good

    docs = spark.createDataFrame([("first",), ("late",), ("never",), ("gone",), (None,)], "text string")
    got = {r["text"]: r for r in M.analyse(docs, server, backoff=0.0).collect()}
    assert got["first"]["attempts"] == 1 and got["first"]["analysis"]["concepts"][0]["importance"] == "high"
    assert got["late"]["attempts"] == 2 and got["late"]["analysis"]["title"] == "T"
    assert got["never"]["attempts"] == 3 and got["never"]["analysis_error"] == "unknown importance" and got["never"]["analysis"] is None
    assert got["gone"]["attempts"] == 1 and got["gone"]["analysis_error"].startswith("NoSuchModel")
    assert got[None]["analysis"]["title"] == "T"


DOCS = "source string, kind string, source_type string, filename string, title string, text string, content binary"


def test_processors(spark, monkeypatch):
    drawing = b'<r><mxCell id="a" value="A"/><mxCell id="b" value="B"/><mxCell id="e" edge="1" source="a" target="b"/></r>'
    rows = [
        ("1", "code", "x", "m.py", None, "print()", None),
        ("2", "text", "mine", "", "", None, None),
        ("3", "image", "x", "i.png", "Pic", "old", b"px"),
        ("4", "image", "x", "j.png", None, "kept", None),
        ("5", "audio", "x", "a.wav", None, "", b"snd"),
        ("6", "diagram", "x", "d.drawio", None, "- A", drawing),
        ("7", "diagram", "x", "e.drawio", None, "raw", b"\xff<not xml"),
        ("8", None, None, None, None, "plain", None),
        ("9", "scanned_pdf", "x", "s.pdf", None, "", None),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    pages = spark.createDataFrame([("3", 1, b"two"), ("3", 0, b"one"), ("other", 0, b"no")], "source string, page_no int, image binary")
    service = ocr.OcrService(ocr.vision(lambda image: image.decode()))
    monkeypatch.setitem(registry.processors.items, "AudioProcessor", processors.hearing(lambda data: [data.decode(), "ok"]))
    got = {r["source"]: r for r in processors.process(docs, {"VisionProcessor": processors.reading(service, pages, "image")}).collect()}
    assert len(got) == len(rows)
    assert (got["1"]["source_type"], got["1"]["confidence"], got["1"]["markdown"]) == ("code", 0.92, "# m.py\n\nprint()")
    assert (got["2"]["source_type"], got["2"]["title"], got["2"]["content"]) == ("mine", "2", "")
    assert (got["3"]["content"], got["3"]["confidence"], got["3"]["model_used"]) == ("one\n\ntwo", 0.85, True)
    assert got["4"]["content"] == "kept" and got["5"]["content"] == "snd ok"
    assert got["6"]["content"] == "flowchart LR\n    A\n    B\n    A --> B".replace("    A\n", '    a["A"]\n').replace("    B\n", '    b["B"]\n').replace("A --> B", "a --> b")
    assert got["6"]["markdown"].startswith("# d.drawio\n\n```mermaid\nflowchart") and got["7"]["content"] == "raw"
    assert got["8"]["processor"] == "TextProcessor" and got["8"]["confidence"] == 0.95
    assert (got["9"]["confidence"], got["9"]["model_used"]) == (0.5, False)
    off = {r["source"]: r["content"] for r in processors.process(docs, diagrams=False).collect()}
    assert off["6"] == "- A"
    with pytest.raises(KeyError):
        processors.process(docs, {"NoProcessor": lambda d: d})
    assert processors.process(docs.limit(0)).count() == 0


def test_flowchart_of_odd_cells(spark):
    cases = {
        "": "",
        "<r/>": "",
        "<r><mxCell/><mxCell id='x'/></r>": "",
        "<r><mxCell id='1-2' value='a'/><mxCell id='1-2' value='b'/></r>": 'flowchart LR\n    n_1_2["b"]',
        "<r><mxCell id='My_Box' value='My Box'/><mxCell id='e' edge='1' source='q' value='open end'/></r>": 'flowchart LR\n    My_Box\n    e["open end"]',
    }
    df = spark.createDataFrame([(x,) for x in cases] + [(None,)], "xml string")
    got = {r["xml"]: r["m"] for r in df.select("xml", T.flowchart(T.drawio_drawing(F.col("xml"))).alias("m")).collect()}
    assert {k: v for k, v in got.items() if k is not None} == cases and got[None] == ""
