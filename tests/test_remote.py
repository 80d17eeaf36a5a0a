"""Remote documents with fake services: tables, streams, the data source, broken answers, waits."""

from __future__ import annotations

import base64
import json
import sys
import time

import pytest
from pyspark import cloudpickle

from docloom.operators.models import ServiceError
from docloom.sources import remote

# Workers do not have this module: what it defines is sent to them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAGES = {
    "a/good": {"content": base64.b64encode(b"# Good\n\ntext").decode(), "name": "R.md", "path": "docs/R.md"},
    "a/none": {},
    "a/latin": {"content": base64.b64encode(b"\xff\xfe\xfa").decode()},
    "a/empty": {"content": base64.b64encode(b" \n").decode()},
}


def repositories(address):
    name = address.removeprefix("https://api.github.com/repos/").removesuffix("/readme")
    if name == "a/prose":
        return "hello"
    if name == "a/list":
        return "[]"
    if name == "a/slow":
        raise TimeoutError
    if name == "a/broken":
        raise RuntimeError("bug")
    if name not in PAGES:
        raise ServiceError(404, "not found")
    return json.dumps(PAGES[name] if address.endswith("/readme") else {"full_name": "A/" + name[2:], "owner": {"login": "ann"}, "updated_at": "2024-05-06T07:08:09Z"})


def transcripts(video):
    return json.dumps({"snippets": [{"text": "one"}, {"no": 1}, {"text": video}] if video != "void" else [], "language": "English"})


REASONS = {
    "https://github.com/a/none": "the README has no content",
    "https://github.com/a/latin": "the README is no UTF-8 text",
    "https://github.com/a/empty": "the README is empty",
    "https://github.com/a/prose": "the answer is no JSON",
    "https://github.com/a/list": "the answer is no object",
    "https://github.com/a/slow": "no answer in time",
    "https://github.com/a/broken": "RuntimeError",
    "https://github.com/a/absent": "not found",
    "https://youtu.be/void": "the transcript is empty",
    "https://example.org/x": "no reader for this URL",
    "": "no reader for this URL",
    None: "no reader for this URL",
}
URLS = ["https://github.com/a/good", "https://www.youtube.com/watch?v=xyz", *REASONS]


def _check(rows):
    got = {r["source"]: r for r in rows}
    assert len(rows) == len(got) == len(URLS)
    assert {u: got[u]["reason"] for u in REASONS} == REASONS
    good, video = got[URLS[0]], got[URLS[1]]
    assert (good["source_type"], good["filename"], good["text"], good["title"], good["reason"]) == ("github_readme", "R.md", "# Good\n\ntext", "A/good", None)
    assert json.loads(good["extra"])["author"] == "ann" and good["modified_at"].isoformat() == "2024-05-06T07:08:09"
    assert (video["text"], video["filename"], json.loads(video["extra"])["snippets"]) == ("one\n\nxyz", "xyz.transcript.md", 3)
    assert all(got[u]["text"] is None for u in REASONS)


def test_table_of_urls(spark):
    urls = spark.createDataFrame([(u, 1) for u in [*URLS, *URLS]], "url string, reason int")
    _check(remote.read_remote(urls, repositories, transcripts, backoff=0.0).collect())
    assert remote.read_remote(urls.limit(0), repositories, transcripts).count() == 0
    none = {r["reason"] for r in remote.read_remote(urls, backoff=0.0).collect()}
    assert none == {"no fetcher for this kind", "no reader for this URL"}


def test_data_source(spark):
    spark.dataSource.register(remote.remote_format("docloom_remote", repositories, transcripts))
    read = spark.read.format("docloom_remote").option("backoff", "0").option("tasks", "3")
    loaded = read.option("urls", json.dumps([*URLS, URLS[0]])).load()
    assert loaded.rdd.getNumPartitions() == 3
    _check(loaded.collect())
    assert read.option("urls", "[]").load().count() == 0


def test_stream_of_urls(spark, tmp_path):
    spark.createDataFrame([(u,) for u in URLS], "url string").write.parquet(str(tmp_path / "urls"))
    stream = remote.read_remote(spark.readStream.schema("url string").parquet(str(tmp_path / "urls")), repositories, transcripts, backoff=0.0)
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    _check(spark.read.parquet(str(tmp_path / "out")).collect())


@pytest.mark.parametrize("rate", [20.0])
def test_calls_wait_for_their_turn(rate):
    reader = remote._Reader(None, transcripts, 1 / rate, 0, 0.0)
    begin = time.monotonic()
    for i in range(5):
        reader.read(f"https://youtu.be/{i}", "video", str(i))
    assert time.monotonic() - begin >= 4 / rate
