"""Scalar functions as native Spark column expressions: no Python on the executors."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.tables import (
    CONFIDENCE_BY_KIND,
    DEFAULT_CONFIDENCE,
    DEFAULT_LANGUAGE,
    DEFAULT_PROCESSOR,
    KIND_BY_EXTENSION,
    KIND_BY_SOURCE_TYPE,
    LANGUAGE_BY_EXTENSION,
    PROCESSOR_BY_KIND,
    READER_BY_EXTENSION,
    READER_BY_NAME,
    STOP_WORDS,
)
from docloom.functions.words import stop_word_hits

LANGUAGE_CHARS = 10_000
LANGUAGE_THRESHOLD = 0.5


def _lookup(table: dict[str, object], key: Column) -> Column:
    """Value of a small constant table; null where the key is absent."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.create_map(*pairs)[key]


def tokens(text: Column) -> Column:
    """Lower-case ASCII word tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def collapse(text: Column) -> Column:
    """Runs of Unicode white space become one blank; ends are trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def snippet(text: Column, size: int = 200) -> Column:
    return F.substring(collapse(text), 1, size)


def strip_html(markup: Column) -> Column:
    """Tags become blanks, white space is collapsed; script and style bodies stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]+>", " "), r"\s+", " "))


def slug(label: Column) -> Column:
    return F.replace(F.lower(F.trim(label)), F.lit(" "), F.lit("_"))


def entity_id(kind: Column, label: Column) -> Column:
    return F.concat(kind, F.lit("::"), slug(label))


def relationship_id(source: Column, kind: Column, target: Column) -> Column:
    return F.concat_ws("::", source, kind, target)


def tag(label: Column) -> Column:
    """Lower case, blanks to hyphens, leading marks dropped, other marks to hyphens."""
    plain = F.regexp_replace(F.replace(F.lower(F.trim(label)), F.lit(" "), F.lit("-")), "^#+", "")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9_-]+", "-"), "^-+|-+$", "")


def distinct_in_order(items: Column) -> Column:
    """First occurrence of each non-blank trimmed item."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))


def extension(filename: Column) -> Column:
    """Lower-case suffix with its dot; none for a name that only begins with a dot."""
    return F.lower(F.regexp_extract(F.element_at(F.split(filename, "[/\\\\]"), -1), r"^.+(\.[^.]+)$", 1))


def kind(ext: Column, source_type: Column) -> Column:
    """Document kind: special source types first, then the extension, then the source type."""
    by_type = F.when(source_type.isin("scanned_pdf", "handwritten"), source_type)
    return F.coalesce(by_type, _lookup(KIND_BY_EXTENSION, ext), _lookup(KIND_BY_SOURCE_TYPE, source_type), F.lit("unknown"))


def reader(filename: Column, source_type: Column) -> Column:
    """Which reader a file goes to: by its name, by its extension, else by its kind."""
    name, ext = F.element_at(F.split(filename, "[/\\\\]"), -1), extension(filename)
    return F.coalesce(_lookup(READER_BY_NAME, name), _lookup(READER_BY_EXTENSION, ext), kind(ext, source_type))


def code_language(filename: Column) -> Column:
    """Programming language by a file's extension; generic for any other."""
    return F.coalesce(_lookup(LANGUAGE_BY_EXTENSION, extension(filename)), F.lit(DEFAULT_LANGUAGE))


def heading_level(level: Column) -> Column:
    """A heading level inside 1 to 6."""
    return F.least(F.greatest(level, F.lit(1)), F.lit(6))


def kind_confidence(kind_: Column) -> Column:
    return F.coalesce(_lookup(CONFIDENCE_BY_KIND, kind_), F.lit(DEFAULT_CONFIDENCE))


def processor(kind_: Column) -> Column:
    return F.coalesce(_lookup({k: p for k, (p, _) in PROCESSOR_BY_KIND.items()}, kind_), F.lit(DEFAULT_PROCESSOR[0]))


def model(kind_: Column) -> Column:
    return F.coalesce(_lookup({k: m for k, (_, m) in PROCESSOR_BY_KIND.items()}, kind_), F.lit(DEFAULT_PROCESSOR[1]))


def _languages(texts: pa.Array) -> pa.Array:
    head = pc.utf8_slice_codeunits(pc.fill_null(texts, ""), 0, LANGUAGE_CHARS)
    n, hits = stop_word_hits(head, list(STOP_WORDS.values()))
    best = hits.argmax(axis=1)  # the first of equal ones
    share = hits[np.arange(len(n)), best] / np.maximum(n, 1)
    sure = share >= LANGUAGE_THRESHOLD
    kana = np.asarray(pc.match_substring_regex(head, "[\u3040-\u30ff]").to_numpy(zero_copy_only=False), bool)
    names = np.where(kana, "ja", np.where(sure, np.array(list(STOP_WORDS))[best], "en"))
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(kana, 0.95, np.where(sure, share, 0.0)))], names=["language", "confidence"])


def language(text: Column) -> Column:
    """struct(language, confidence) by stop words of the first 10,000 characters; kana decides for Japanese.

    One vectorised pass over each Arrow batch.
    """

    def detect(texts: pa.Array) -> pa.Array:
        return _languages(texts)

    detect.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(detect, "language string, confidence double")(text)


def sniff_mime(content: Column) -> Column:
    """MIME type from the first 512 bytes of a binary column."""
    head = F.substring(content, 1, 512)
    code = F.hex(head)
    text = F.decode(head, "ISO-8859-1")
    begins = lambda *marks: reduce(lambda a, b: a | b, [code.startswith(m) for m in marks])
    inner = F.substring(code, 17, 8)
    plain = F.regexp_replace(text, "[\\t\\n\\r\\x20-\\x7e]", "")
    body = F.regexp_replace(text, r"^\s+", "")
    first_lines = F.slice(F.split(text, "\r\n|\n|\r"), 1, 3)
    markdown = ~text.contains("\x00") & (F.exists(first_lines, lambda x: x.startswith("# ")) | body.startswith("---"))
    return (
        F.when(begins("255044462D"), "application/pdf")
        .when(begins("504B0304", "504B0506", "504B0708"), "application/zip")
        .when(begins("89504E470D0A1A0A"), "image/png")
        .when(begins("FFD8FF"), "image/jpeg")
        .when(begins("474946383761", "474946383961"), "image/gif")
        .when(begins("52494646") & (inner == "57454250"), "image/webp")
        .when(begins("52494646") & (inner == "57415645"), "audio/wav")
        .when(begins("4F676753"), "audio/ogg")
        .when(begins("494433", "FFFB", "FFF3"), "audio/mpeg")
        .when(begins("3C3F786D6C"), "application/xml")
        .when(body.startswith("<!DOCTYPE html") | body.startswith("<html"), "text/html")
        .when(body.startswith("{") | body.startswith("["), "application/json")
        .when(markdown, "text/markdown")
        .when((F.length(text) == 0) | (1 - F.length(plain) / F.length(text) >= 0.9), "text/plain")
        .otherwise("application/octet-stream")
    )


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in f64; other dimensions or a zero vector give exactly 0."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / F.nullif(scale, F.lit(0.0))).otherwise(F.lit(0.0))


def pdf_datetime(value: Column) -> Column:
    """D:YYYYMMDDhhmmss as a UTC timestamp; null if it is none."""
    return F.try_to_timestamp(F.substring(F.regexp_replace(value, "^D:", ""), 1, 14), F.lit("yyyyMMddHHmmss"))


def iso_datetime(value: Column) -> Column:
    return F.try_to_timestamp(value)


def column_index(ref: Column) -> Column:
    """Spreadsheet letters to a zero-based column: A1 → 0, AA3 → 26."""
    letters = F.split(F.upper(F.regexp_extract(ref, "^([A-Za-z]+)", 1)), "")
    return F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64) - 1


def video_id(url: Column) -> Column:
    """Identifier of a video URL: /watch?v=, a short host, or embed/shorts/live/v paths; null if none."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    short = F.when(host == "youtu.be", F.regexp_extract(path, "^/([^/]+)", 1))
    query = F.when(path == "/watch", F.try_parse_url(url, F.lit("QUERY"), F.lit("v")))
    inner = F.regexp_extract(path, "^/(?:embed|shorts|live|v)/([^/]+)", 1)
    known = host.isin("youtu.be", "youtube.com", "www.youtube.com", "m.youtube.com")
    return F.when(known, F.coalesce(F.nullif(short, F.lit("")), query, F.nullif(inner, F.lit(""))))


def repository(url: Column) -> Column:
    """struct(owner, name) of a repository URL; null if it is none."""
    path = F.regexp_extract_all(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("[^/]+"), F.lit(0))
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    return F.when(host.isin("github.com", "www.github.com") & (F.size(path) >= 2), F.struct(path[0].alias("owner"), F.regexp_replace(path[1], r"\.git$", "").alias("name")))


def matches(fields: dict[str, Column], metadata: Column | None, filters: dict[str, object]) -> Column:
    """AND over filters: a known field or the metadata entry equals the value; types are never coerced to text."""
    tests = [F.lit(True)]
    for key, value in filters.items():
        options = []
        if key in fields:
            options.append(fields[key].isNull() if value is None else fields[key] == F.lit(value))
        elif value is None:
            options.append(F.lit(True))
        if metadata is not None and isinstance(value, str):
            options.append(metadata[key] == value)
        tests.append(F.coalesce(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), options), F.lit(False)) if options else F.lit(False))
    return reduce(lambda a, b: a & b, tests)
