"""WARC derivatives: metadata and plain-text conversion records of responses.

A response (record id, target, date, HTTP header lines, payload) gives one
``metadata`` record (what was found in it: title, language, links, sizes) and one
``conversion`` record (its plain text). Both name the response in WARC-Refers-To,
repeat its target and date, keep its HTTP header lines and carry its payload digest;
the metadata record also names the conversion as concurrent. Block digests are SHA-1
in base 32, as archives write them.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.plumbing import map_batches, record

VERSION = "WARC/1.1"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace
#: Elements whose content is no text, and elements that begin a new line.
HIDDEN = frozenset("script style noscript template".split())
LINES = frozenset(
    "p div section article header footer nav aside ul ol li table tr h1 h2 h3 h4 h5 h6 blockquote pre title body head html figure form main br hr".split()
)
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9]*)")
_LANG = re.compile(r"""(?i)\slang\s*=\s*["']?([a-zA-Z-]+)""")
_HREF = re.compile(r"""(?i)\shref\s*=\s*["']([^"']*)["']""")
_BLANKS = re.compile(r"[^\S\n]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    """A name-based record id: the same parts give the same id."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, chr(0).join(parts))}>"


@dataclass
class Page:
    text: str
    title: str | None
    language: str | None
    links: list[str]


def read_page(markup: str) -> Page:
    """Visible text, title, language and links in one pass from left to right; the time grows with the length, whatever the markup.

    Scripts, styles, templates and comments go, with what they hold, if they are closed; tags go, block tags break
    lines; entities are resolved; a ``<`` that begins no tag stays, as does a tag that is never closed.
    """
    low, out, links = markup.lower(), [], {}
    if len(low) != len(markup):  # some capitals have two small characters
        low = markup.translate(_LOWER)
    title = language = None
    last: dict[str, tuple[int, int]] = {}  # of each search: where it began, what it found

    def ahead(what: str, at: int, why: str = "") -> int:
        began, found = last.get(why + what, (at + 1, -1))
        if began <= at and (found < 0 or at <= found):
            return found
        found = low.find(what, at)
        last[why + what] = (at, found)
        return found

    at = 0
    while (lt := low.find("<", at)) >= 0:
        out.append(markup[at:lt])
        if low.startswith("<!--", lt) and (end := ahead("-->", lt + 4)) >= 0:
            out.append(" ")
            at = end + 3
            continue
        name = _NAME.match(low, lt + 1)
        kind = name[1] if name else ""
        if not (kind or low.startswith(("</", "<!doctype"), lt)) or (gt := ahead(">", lt + 1)) < 0:
            out.append("<")
            at = lt + 1
            continue
        closing, at = low[lt + 1] == "/", gt + 1
        if kind in HIDDEN and not closing and (end := ahead(f"</{kind}", at)) >= 0 and (gt := ahead(">", end, kind)) >= 0:
            out.append(" ")
            at = gt + 1
            continue
        if kind == "title" and title is None and not closing and (end := ahead("</title", at)) >= 0:
            title = " ".join(html.unescape(markup[at:end]).split())
        elif not closing and kind in ("html", "a"):
            tag = markup[lt:gt]
            if kind == "html" and language is None and (found := _LANG.search(tag)):
                language = found[1].lower()
            elif kind == "a" and (found := _HREF.search(tag)):
                links[html.unescape(found[1])] = None
        out.append("\n" if kind in LINES else " " if low.startswith("<!doctype", lt) else "")
    out.append(markup[at:])
    lines = (_BLANKS.sub(" ", line).strip() for line in html.unescape("".join(out)).split("\n"))
    return Page("\n".join(line for line in lines if line), title, language, list(links))


def plain_text(markup: str) -> str:
    return read_page(markup).text


def metadata_fields(page: Page) -> list[tuple[str, str]]:
    """What a metadata record says, in order; links once each, in first-seen order."""
    fields = [("title", page.title)] if page.title is not None else []
    fields += [("language", page.language)] if page.language else []
    fields += [("text-characters", str(len(page.text))), ("text-lines", str(page.text.count("\n") + 1 if page.text else 0))]
    return fields + [("outlink", x) for x in page.links]


def serialize(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A whole record as it stands in a WARC file."""
    return f"{VERSION}\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record of an uncompressed WARC file; a cut last record ends the file."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = []
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            headers.append((key.strip(), value.strip()))
        size = int(next((v for k, v in headers if k.lower() == "content-length" and v.isdigit()), "0"))
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            return
        yield headers, block
        at = end + 4 + size


def split_http(block: bytes) -> tuple[list[str], bytes]:
    """(status and header lines, payload) of an HTTP response block."""
    head, found, payload = block.partition(b"\r\n\r\n")
    return (head.decode("latin-1").split("\r\n"), payload) if found and head.startswith(b"HTTP/") else ([], block)


#: Bytes of a gzip file that are handed to the decompressor at once.
CHUNK = 1 << 16


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one after another; a file that isn't gzip is one member; a damaged or cut one ends the file.

    Pieces of the file are handed on, and only the rest of a piece is kept: time grows with the bytes, whatever the number of members.
    """
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at, rest, view = 0, b"", memoryview(data)
    while True:
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            if not rest:
                rest, at = bytes(view[at : at + CHUNK]), at + CHUNK
                if not rest:
                    return
            try:
                parts.append(unzip.decompress(rest))
            except zlib.error:
                return
            rest = unzip.unused_data
        yield b"".join(parts)
        while not (rest := rest.lstrip(b"\0")):
            rest, at = bytes(view[at : at + CHUNK]), at + CHUNK
            if not rest:
                return


def _header(lines: list[str], name: str) -> str:
    """Value of an HTTP header line, in small letters; empty where there is none."""
    return next((v.strip().lower() for k, _, v in (line.partition(":") for line in lines[1:]) if k.strip().lower() == name), "")


def unchunked(payload: bytes) -> bytes:
    """A chunked body put together; what is no chunk ends it."""
    out, at = [], 0
    while (end := payload.find(b"\r\n", at)) >= 0:
        size = payload[at:end].split(b";")[0].strip()
        if not re.fullmatch(b"[0-9a-fA-F]{1,15}", size) or not int(size, 16):
            break
        out.append(payload[end + 2 : end + 2 + int(size, 16)])
        at = end + 4 + int(size, 16)
    return b"".join(out)


def body_of(lines: list[str], payload: bytes) -> bytes:
    """The body of a response without its transfer and content encodings; as it is where they are unknown or broken."""
    if "chunked" in _header(lines, "transfer-encoding"):
        payload = unchunked(payload) or payload
    encoding = _header(lines, "content-encoding")
    for kind, bits in (("gzip", 47), ("deflate", 47), ("deflate", -15)):
        if kind in encoding:
            try:
                return zlib.decompressobj(bits).decompress(payload)
            except zlib.error:
                continue
    return payload


def textual(lines: list[str]) -> bool:
    """Whether a response's content type is one of texts; where none is declared it counts as text."""
    kind = _header(lines, "content-type").split(";")[0].strip()
    return not kind or kind.startswith("text/") or kind.endswith(("+xml", "+json")) or kind in ("application/xml", "application/json", "application/javascript")


def _charset(lines: list[str], payload: bytes) -> str:
    declared = [re.search(r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", line) for line in lines if line.lower().startswith("content-type:")]
    declared.append(re.search(r"""(?i)<meta[^<>]{0,200}charset\s*=\s*["']?([\w.:-]+)""", payload[:4096].decode("latin-1")))
    for found in declared:
        if found:
            try:
                return codecs.lookup(found[1]).name
            except LookupError:
                continue
    return "utf-8"


_RECORDS = pa.schema(
    [("file", pa.string()), ("place", pa.int64())] + [(k, pa.string()) for k in ("record_type", "record_id", "target_uri", "warc_date")] + [("headers", pa.list_(pa.string())), ("payload", pa.string()), ("payload_digest", pa.string()), ("declared_digests", pa.list_(pa.string()))]
)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under a path, plain or gzip (a member or several): file, place, record_type, record_id, target_uri, warc_date, headers, payload, payload_digest, declared_digests.

    A response's headers are its HTTP lines. Its payload is freed of chunks and compression and decoded by the charset of
    its lines, the page's own, or UTF-8; it is null where the content type is none of texts. Other records (warcinfo,
    request, …) have no such lines and their block as payload. ``payload_digest`` is the declared WARC-Payload-Digest, or
    else that of the archived payload bytes as they stand in the file; ``declared_digests`` are the record's own digest
    lines. Files are read whole, one a task at a
    time: keep them below 2 GB. Defined results: a damaged or cut record ends its file; an empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{warc,warc.gz}").load(path)

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            place = 0
            for member in members(content.as_buffer().to_pybytes()):
                rows = []
                for headers, block in parse_records(member):
                    known = {k.lower(): v for k, v in headers}
                    kind = known.get("warc-type")
                    lines, payload = split_http(block) if kind == "response" else ([], block)
                    told = [f"{k}: {v}" for k, v in headers if k.lower() in ("warc-payload-digest", "warc-block-digest")]
                    plain = body_of(lines, payload)
                    body = plain.decode(_charset(lines, plain), "replace") if textual(lines) else None
                    about = (known.get("warc-record-id"), known.get("warc-target-uri"), known.get("warc-date"))
                    rows.append((name, place, kind, *about, lines, body, known.get("warc-payload-digest") or digest(payload), told))
                    place += 1
                if rows:
                    yield record(_RECORDS, *(list(c) for c in zip(*rows, strict=True)))

    ddl = "file string, place long, record_type string, record_id string, target_uri string, warc_date string, headers array<string>, payload string, payload_digest string, declared_digests array<string>"
    return map_batches(files.select("path", "content"), one, ddl)


def file_derivatives(spark: SparkSession, path: str) -> DataFrame:
    """The derivatives of all responses in the WARC files under a path, with the file that each comes from."""
    return derivatives(read_warc(spark, path).where("record_type = 'response'"), "file")


_COLUMNS = "record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_payload_digest string, source_headers array<string>, content string"
_ARROW = pa.schema(
    [(k, pa.string()) for k in ("record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "warc_date", "content_type")]
    + [("content_length", pa.int64()), ("block_digest", pa.string()), ("source_payload_digest", pa.string()), ("source_headers", pa.list_(pa.string())), ("content", pa.string())]
)


def derive(response_id: str, target: str, date: str, lines: list[str], payload: str, source: str | None = None) -> list[tuple]:
    """The metadata and the conversion record of one response; source: the digest of its archived bytes, if they are not the payload's UTF-8."""
    source = source or digest(payload.encode())
    page = read_page(payload)
    text = page.text
    meta = "".join(f"{k}: {v}\r\n" for k, v in metadata_fields(page))
    # A response without id is told apart by what it says.
    known = [response_id] if response_id else ["", target or "", date or "", source]
    ids = {kind: record_id(kind, *known) for kind in ("metadata", "conversion")}
    out = []
    for kind, body, form in (("metadata", meta, "application/warc-fields"), ("conversion", text, "text/plain; charset=UTF-8")):
        block = body.encode()
        out.append((kind, ids[kind], response_id, ids["conversion"] if kind == "metadata" else None, target, date, form, len(block), digest(block), source, lines, body))
    return out


def derivatives(responses: DataFrame, keep: str) -> DataFrame:
    """Two records per response (record_id, target_uri, warc_date, headers, payload), with the column ``keep``.

    A column payload_digest holds the digests of the archived payloads; without it, or where it is null, the digest is
    that of the payload in UTF-8.

    Defined results: a null payload is empty (empty text, no outlinks); a null target
    stays null; repeated responses give their records again, with the same ids; the ids
    of a response without id come from its target, date and payload; an empty table gives
    no rows; extra columns are ignored.
    """
    kind = responses.schema[keep].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, owner = [], []
        for i, (rid, target, date, lines, payload, source) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
            made = derive(rid or "", target, date, lines or [], payload or "", source)
            rows += made
            owner += [i] * len(made)
        kept = batch.column(0).take(pa.array(owner, pa.int64()))
        arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)]
        yield pa.RecordBatch.from_arrays([kept, *arrays], names=[keep, *_ARROW.names])

    source = F.col("payload_digest") if "payload_digest" in responses.columns else F.lit(None).cast("string")
    return map_batches(responses.select(keep, "record_id", "target_uri", "warc_date", "headers", "payload", source.alias("payload_digest")), one, f"`{keep}` {kind}, {_COLUMNS}")


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages as response records: a name-based id of page and URL, and the HTTP header lines of a stored page."""
    key = F.concat_ws("\0", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")))
    h = F.sha1(key)
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")
    lines = F.array(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), size))
    return pages.select("page_id", _urn(h).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), lines.alias("headers"), F.col("html").alias("payload"))


def _urn(h: Column) -> Column:
    """A version-5 style UUID from hex digits."""
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def warc_files(derived: DataFrame) -> DataFrame:
    """record_id, record: each derivative as the bytes of a WARC file's record.

    Defined results: headers without a value are left out; null content is an empty block; repeated records are written
    each; an empty table gives no rows.
    """

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for r in batch.to_pylist():
            headers = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["warc_date"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Refers-To", r["refers_to"])]
            headers += [("WARC-Concurrent-To", r["concurrent_to"]), ("WARC-Block-Digest", r["block_digest"]), ("X-Source-Payload-Digest", r["source_payload_digest"])]
            headers += [("X-Source-Header", line) for line in r["source_headers"] or []]
            headers += [("Content-Type", r["content_type"]), ("Content-Length", str(r["content_length"]))]
            out.append(serialize([(k, v) for k, v in headers if v is not None], (r["content"] or "").encode()))
        yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array(out, pa.binary())], names=["record_id", "record"])

    return map_batches(derived, one, "record_id string, record binary")
