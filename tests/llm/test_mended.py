"""Near-dedup on derived tables; archived digests, encodings and members of WARC files; recall of the toxicity scores."""

from __future__ import annotations

import gzip
import random
import time
import zlib

from pyspark.sql import functions as F

from docloom.llm import simhash_golay, toxicity_nnpu, warc
from docloom.llm.plumbing import table


def _long(seed):
    return " ".join(random.Random(seed).choices("river mill stone corn flood year bridge lamp road wind".split(), k=60))


def test_near_dedup_on_exploded_joined_and_united_tables(spark, tmp_path):
    """Rows that come of one row of a file are told apart."""
    one, two, three = _long(1), _long(2), _long(3)
    spark.createDataFrame([(1, [one, two, one]), (2, [two, three])], "doc_id long, texts array<string>").coalesce(1).write.parquet(f"{tmp_path}/t")
    read = spark.read.parquet(f"{tmp_path}/t")
    exploded = read.select("doc_id", F.explode("texts").alias("text"))
    names = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc_id long, source string")
    for docs in (exploded, exploded.unionByName(exploded), exploded.join(names, "doc_id"), exploded.sample(True, 3.0, 7)):
        kept = sorted(r["text"] for r in simhash_golay.drop_near_duplicates(docs).select("text").collect())
        assert kept == sorted({r["text"] for r in docs.collect()})
    plain = read.select("doc_id", F.col("texts")[0].alias("text"))
    assert simhash_golay.drop_near_duplicates(plain, scanned=True).count() == 2


def _record(kind, headers, block):
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    return warc.serialize(lines, block)


def test_warc_keeps_declared_digests_and_digests_archived_bytes(spark, tmp_path):
    page = "<html><title>Caf\xe9</title><p>na\xefve</p></html>".encode("latin-1")
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n"
    squeezed, chunked = gzip.compress(page), b"5\r\n" + page[:5] + b"\r\n" + b"%x\r\n" % len(page[5:]) + page[5:] + b"\r\n0\r\n\r\n"
    raw_deflate = zlib.compressobj(9, zlib.DEFLATED, -15)
    flat = raw_deflate.compress(page) + raw_deflate.flush()
    records = [
        _record("response", [("WARC-Record-ID", "<a>"), ("WARC-Payload-Digest", "sha1:DECLARED"), ("WARC-Block-Digest", "sha1:BLOCK")], head + b"\r\n" + page),
        _record("response", [("WARC-Record-ID", "<b>")], head + b"\r\n" + page),
        _record("response", [("WARC-Record-ID", "<c>")], head + b"Content-Encoding: gzip\r\n\r\n" + squeezed),
        _record("response", [("WARC-Record-ID", "<d>")], head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked),
        _record("response", [("WARC-Record-ID", "<e>")], head + b"Content-Encoding: deflate\r\n\r\n" + flat),
        _record("response", [("WARC-Record-ID", "<f>")], b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG\r\n\x1a\n\0\0"),
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    read = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    archived = warc.digest(page)
    assert read["<a>"]["payload_digest"] == "sha1:DECLARED" and read["<a>"]["declared_digests"] == ["WARC-Payload-Digest: sha1:DECLARED", "WARC-Block-Digest: sha1:BLOCK"]
    assert read["<b>"]["payload_digest"] == archived and read["<c>"]["payload_digest"] == warc.digest(squeezed)
    assert {read[i]["payload"] for i in ("<a>", "<b>", "<c>", "<d>", "<e>")} == {page.decode("latin-1")} and read["<f>"]["payload"] is None
    made = warc.file_derivatives(spark, str(tmp_path)).collect()
    of = lambda i, kind: next(r for r in made if r["refers_to"] == i and r["record_type"] == kind)
    for i in read:
        meta, text = of(i, "metadata"), of(i, "conversion")
        assert meta["source_payload_digest"] == text["source_payload_digest"] == read[i]["payload_digest"]
        assert meta["concurrent_to"] == text["record_id"] and meta["source_headers"] == read[i]["headers"]
        assert text["block_digest"] == warc.digest(text["content"].encode())
    assert of("<c>", "conversion")["content"] == "Caf\xe9\nna\xefve" and of("<f>", "conversion")["content"] == ""


def test_many_members_and_open_markup_take_linear_time():
    member = gzip.compress(random.Random(1).randbytes(1500))
    began = time.perf_counter()
    assert sum(1 for _ in warc.members(member * 60_000)) == 60_000
    for n in (100_000,):
        for part in ("<script>", "<a", "<!--", "</style>", "<title>"):
            warc.plain_text(part * n + "</script" + "x" * n)
    assert time.perf_counter() - began < 20
    assert [*warc.members(member * 2 + b"\0" * 70_000 + member + member[:-9])] == [gzip.decompress(member)] * 3
    assert warc.plain_text("<p>a</p><script><b>x</b><p>y</p></script") == "a\nx\ny\n</script"
    assert warc.plain_text("<p>a</p><script>x</script><p>y</p><script>z") == "a\ny\nz"


def test_toxicity_recall_of_held_out_rows(spark):
    """At least nine tenths of the held-out toxic documents of the larger table are found, and false alarms stay few."""
    folder = "/root/testdata/sf0.1"
    found = toxicity_nnpu.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    held = found.where("held_out").join(table(spark, folder, "labels"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in held}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.05 * (n[0, 0] + n.get((0, 1), 0))
