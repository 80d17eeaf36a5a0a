"""Readers of single files: bytes in, one parsed document out. Standard library only.

Each reader returns (text, title, extra) or raises ``Unreadable`` with a reason. They
run inside Arrow batches over ``binaryFile`` rows (see ``docloom.sources.files``).
"""

from __future__ import annotations

import email
import email.policy
import io
import json
import os
import re
import sqlite3
import tarfile
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from docloom.functions.markdown import clean_text


class Unreadable(ValueError):
    """The file cannot become a document; the message is the quarantine reason."""


Parsed = tuple[str, str | None, dict]


def _decode(data: bytes, name: str) -> str:
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError as error:
        raise Unreadable(f"{name} is not valid UTF-8") from error


def _stem(name: str) -> str:
    return os.path.splitext(name)[0]


def _no_tags(markup: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", markup)).strip()


def _filled(text: str, name: str) -> str:
    if not text:
        raise Unreadable(f"{name} has no text")
    return text


def markdown(data: bytes, name: str) -> Parsed:
    text = _filled(clean_text(_decode(data, name)), name)
    head = next((line.strip()[2:].strip() for line in text.splitlines() if line.strip().startswith("# ")), "")
    return text, head or _stem(name), {}


def plain(data: bytes, name: str) -> Parsed:
    return _filled(clean_text(_decode(data, name)), name), _stem(name), {}


def raw(data: bytes, name: str) -> Parsed:
    """Tables and code: the text as it stands, empty allowed."""
    return _decode(data, name), _stem(name), {}


def config(data: bytes, name: str) -> Parsed:
    return clean_text(_decode(data, name)), _stem(name), {}


def notebook(data: bytes, name: str) -> Parsed:
    try:
        cells = json.loads(data)["cells"]
    except (ValueError, KeyError, TypeError) as error:
        raise Unreadable(f"{name} is no notebook") from error
    parts = []
    for cell in cells:
        source = cell.get("source") or ""
        source = "".join(source) if isinstance(source, list) else source
        if source.strip():
            parts.append(f"```python\n{source}\n```" if cell.get("cell_type") == "code" else source)
    return clean_text("\n\n".join(parts)), _stem(name), {"cells": len(cells)}


def database(data: bytes, name: str, sample: int = 5) -> Parsed:
    """Schema, row count and first rows of each table of an SQLite file."""
    link = sqlite3.connect(":memory:")
    try:
        link.deserialize(data)
        ask = lambda sql: link.execute(sql).fetchall()
        tables = [r[0] for r in ask("select name from sqlite_master where type = 'table' order by name")]
        out = [f"Database: {name}", f"Tables: {', '.join(tables)}", ""]
        for t in tables:
            quoted = '"' + t.replace('"', '""') + '"'
            columns = [(r[1], r[2]) for r in ask(f"pragma table_info({quoted})")]
            rows = ask(f"select count(*) from {quoted}")[0][0]
            out += [f"Table: {t}", "Schema:", *(f"  {c} ({k})" for c, k in columns), f"Rows: {rows}"]
            if rows:
                out += [f"Sample ({min(sample, rows)} of {rows} rows):", " | ".join(c for c, _ in columns)]
                out += [" | ".join(map(str, r)) for r in ask(f"select * from {quoted} limit {int(sample)}")]
            out.append("")
    except sqlite3.Error as error:
        raise Unreadable(f"{name} is no readable database") from error
    finally:
        link.close()
    return clean_text("\n".join(out)), _stem(name), {"table_count": len(tables), "tables": tables}


def _xml_parts(data: bytes, name: str, pattern: str) -> list[tuple[str, ElementTree.Element]]:
    """Parsed XML members of a zip file, in number order."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            members = sorted((m for m in z.namelist() if re.fullmatch(pattern, m)), key=lambda m: [int(x) for x in re.findall(r"\d+", m)] or [0])
            return [(m, ElementTree.fromstring(z.read(m))) for m in members]
    except (zipfile.BadZipFile, ElementTree.ParseError) as error:
        raise Unreadable(f"{name} is no readable package") from error


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _paragraphs(root: ElementTree.Element) -> list[str]:
    texts = ("".join(t.text or "" for t in p.iter() if _local(t) == "t") for p in root.iter() if _local(p) == "p")
    return [t for t in texts if t.strip()]


def _plain_paragraphs(root: ElementTree.Element) -> list[str]:
    texts = ("".join(p.itertext()) for p in root.iter() if _local(p) == "p")
    return [t for t in texts if t.strip()]


def word(data: bytes, name: str) -> Parsed:
    found = _xml_parts(data, name, r"word/document\.xml|content\.xml")
    lines = [line for _, root in found for line in _paragraphs(root) or _plain_paragraphs(root)]
    return _filled(clean_text("\n".join(lines)), name), _stem(name), {}


def slides(data: bytes, name: str) -> Parsed:
    found = _xml_parts(data, name, r"ppt/slides/slide\d+\.xml")
    return _filled(clean_text("\n".join(line for _, root in found for line in _paragraphs(root))), name), _stem(name), {"slides": len(found)}


def spreadsheet(data: bytes, name: str) -> Parsed:
    shared = [_joined(x) for _, root in _xml_parts(data, name, r"xl/sharedStrings\.xml") for x in root if _local(x) == "si"]
    names = [s.get("name", "") for _, root in _xml_parts(data, name, r"xl/workbook\.xml") for s in root.iter() if _local(s) == "sheet"]
    out = []
    for i, (_, root) in enumerate(_xml_parts(data, name, r"xl/worksheets/sheet\d+\.xml")):
        out.append(f"Sheet: {names[i] if i < len(names) else i + 1}")
        for row in (r for r in root.iter() if _local(r) == "row"):
            cells = []
            for c in (c for c in row if _local(c) == "c"):
                value = next((v.text or "" for v in c.iter() if _local(v) == "v"), "")
                value = shared[int(value)] if c.get("t") == "s" and value else _joined(c) if c.get("t") == "inlineStr" else value
                cells.append(value)
            if any(cells):
                out.append(" | ".join(cells))
    return clean_text("\n".join(out)), _stem(name), {"sheets": len(names)}


def _joined(e: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in e.iter() if _local(t) == "t")


def book(data: bytes, name: str) -> Parsed:
    """EPUB: the spine's documents in order, tags stripped."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("META-INF/container.xml"))
            package = next(e.get("full-path") for e in root.iter() if _local(e) == "rootfile")
            opf = ElementTree.fromstring(z.read(package))
            places = {e.get("id"): e.get("href") for e in opf.iter() if _local(e) == "item"}
            order = [places[e.get("idref")] for e in opf.iter() if _local(e) == "itemref" and e.get("idref") in places]
            base = os.path.dirname(package)
            texts = [_no_tags(z.read(os.path.normpath(os.path.join(base, p))).decode("utf-8", "replace")) for p in order]
            title = next((e.text for e in opf.iter() if _local(e) == "title" and e.text), None)
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as error:
        raise Unreadable(f"{name} is no readable book") from error
    return _filled(clean_text("\n\n".join(texts)), name), title or _stem(name), {"items": len(texts)}


def message(data: bytes, name: str) -> Parsed:
    """E-mail: header lines, then plain parts (markup only while there is none); attachments as names and bytes."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    parts, attachments = [], []
    for part in m.walk():
        if part.is_multipart():
            continue
        if part.get_content_disposition() == "attachment":
            attachments.append((os.path.basename(part.get_filename() or "attachment"), part.get_payload(decode=True) or b""))
            continue
        kind = part.get_content_type()
        if kind == "text/plain" or (kind == "text/html" and not parts):
            content = part.get_content()
            parts.append(_no_tags(content) if kind == "text/html" else content)
    head = [f"{k}: {m.get(k.lower(), '')}" for k in ("Subject", "From", "To", "Date")]
    return clean_text("\n".join(head) + "\n\n" + "\n\n".join(parts)), str(m.get("subject", "")) or _stem(name), {"attachments": attachments}


def archive(data: bytes, name: str) -> Parsed:
    """Sorted listing with sizes; other archive kinds: name and size."""
    suffix = os.path.splitext(name)[1].lower()
    if suffix not in (".zip", ".tar", ".gz"):
        return f"Archive: {name}\nFormat: {suffix[1:].upper()}\nSize: {len(data):,} bytes", _stem(name), {"format": suffix[1:]}
    try:
        if suffix == ".zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                entries = [(e.filename, e.file_size, not e.is_dir()) for e in z.infolist()]
        else:
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
                entries = [(e.name, e.size, e.isfile()) for e in t.getmembers()]
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError) as error:
        raise Unreadable(f"{name} is no valid archive") from error
    lines = [f"Archive: {name}", f"Format: {'ZIP' if suffix == '.zip' else 'TAR'}", f"Files: {len(entries)}", f"Uncompressed Size: {sum(s for _, s, _ in entries):,} bytes", "", "Contents:"]
    lines += [f"  {f'{size:,}' if file else '<DIR>':>10}  {path}" for path, size, file in sorted(entries)]
    return clean_text("\n".join(lines)), _stem(name), {"format": suffix[1:], "files": len(entries)}


def research(data: bytes, name: str) -> Parsed:
    """Citation entries as `field: value` lines; the text itself where none parses."""
    text, entries = _decode(data, name), []
    if name.lower().endswith(".bib"):
        for key, body in re.findall(r"(?s)@\w+\{([^,]+),(.*?)\n\}", text):
            fields = re.findall(r"(\w+)\s*=\s*\{([^}]*)\}", body)
            entries.append("\n".join([f"Citation Key: {key.strip()}", *(f"{k}: {v}" for k, v in fields)]))
    else:
        for block in re.split(r"(?m)^ER  -.*$", text):
            pairs = [line.partition(" - ") for line in block.splitlines() if " - " in line]
            if pairs:
                entries.append("\n".join(f"{k.strip()}: {v.strip()}" for k, _, v in pairs))
    return clean_text("\n\n".join(entries) or text), _stem(name), {"entries": len(entries)}


def diagram(data: bytes, name: str) -> Parsed:
    text = data.decode("utf-8", "replace")
    labels = []
    if name.lower().endswith(".drawio"):
        try:
            labels = [re.sub(r"<[^>]+>", "", c.get("value", "")).strip() for c in ElementTree.fromstring(text).iter("mxCell")]
        except ElementTree.ParseError:
            labels = []
    labels = [x for x in labels if x]
    body = "\n".join(["Diagram: draw.io", "", *(f"  - {x}" for x in labels)]) if labels else text
    return clean_text(body), _stem(name), {"labels": len(labels)}


def media(data: bytes, name: str) -> Parsed:
    """Images, audio, video: no text, only what the bytes tell."""
    extra: dict = {"size_bytes": len(data)}
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        extra |= {"width": int.from_bytes(data[16:20], "big"), "height": int.from_bytes(data[20:24], "big"), "format": "PNG"}
    elif data[:6] in (b"GIF87a", b"GIF89a"):
        extra |= {"width": int.from_bytes(data[6:8], "little"), "height": int.from_bytes(data[8:10], "little"), "format": "GIF"}
    elif data[:4] == b"RIFF" and data[8:12] == b"WAVE" and len(data) >= 44:
        rate = int.from_bytes(data[28:32], "little")
        extra |= {"format": "WAV", "seconds": round((len(data) - 44) / rate, 3) if rate else None}
    return "", _stem(name), extra


def optional(module: str, read: Callable[[bytes, str], Parsed]) -> Callable[[bytes, str], Parsed]:
    """A reader that needs a library which may be missing; then its files go to quarantine."""

    def reader(data: bytes, name: str) -> Parsed:
        try:
            __import__(module)
        except ImportError as error:
            raise Unreadable(f"{name} needs the optional library {module}") from error
        return read(data, name)

    return reader


def _pdf(data: bytes, name: str) -> Parsed:
    import pypdf

    pages = [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages]
    return clean_text("\n\n".join(pages)), _stem(name), {"page_count": len(pages)}


READERS: dict[str, Callable[[bytes, str], Parsed]] = {
    "markdown": markdown, "text": plain, "tex": plain, "web": plain, "csv": raw, "code": raw, "config": config, "notebook": notebook, "database": database,
    "spreadsheet": spreadsheet, "docx": word, "pptx": slides, "epub": book, "email": message, "archive": archive, "research": research, "diagram": diagram,
    "image": media, "audio": media, "video": media, "pdf": optional("pypdf", _pdf),
}


def register(kind: str, reader: Callable[[bytes, str], Parsed]) -> None:
    """Add or replace the reader of a kind."""
    READERS[kind] = reader

