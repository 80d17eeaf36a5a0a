"""Token-ID output in patched frame-of-reference blocks.

A *segment* is one file image: ids of consecutive documents, cut into blocks of
``BLOCK`` ids. A block keeps its minimum, packs the differences at the width that
``PERCENTILE`` of them fit in, and lists the rest as exceptions (position, value).
The block index holds the byte start of each block, so any block can be read alone.

Segment layout, little-endian: magic 8 bytes; u64 documents, u64 ids, u64 blocks,
u64 byte length of the blocks; blocks; index (u64 start, u32 minimum, u16 ids,
u16 exceptions, u8 width, each as one array); documents (i64 id, u8 id-is-null,
u64 ids, each as one array).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import bpe
from docloom.llm.plumbing import lean, map_batches, prepare, record, stage
from docloom.llm.textcore import buffers

MAGIC = b"DLPFOR1\0"
BLOCK = 1024
PERCENTILE = 97
END_ID = 2
_HEAD = struct.Struct("<8sQQQQ")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, ids) → (blocks, bytes) with ``width`` bits an id."""
    if width in (8, 16, 32):
        return np.ascontiguousarray(values.astype(f"<u{width // 8}")).view(np.uint8).reshape(len(values), -1)
    bits = (values[:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(raw: np.ndarray, width: int, ids: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.ascontiguousarray(raw).view(f"<u{width // 8}").astype(np.uint32)[:, :ids]
    bits = np.unpackbits(raw, axis=1, bitorder="little", count=ids * width).reshape(len(raw), ids, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)


def encode_blocks(ids: np.ndarray) -> tuple[bytes, dict[str, np.ndarray]]:
    """Pack ids; returns the blocks' bytes and their index."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    count = np.full(blocks, BLOCK, np.int64)
    if blocks:
        count[-1] = n - BLOCK * (blocks - 1)
    minimum, width, exceptions = np.zeros(blocks, np.uint32), np.ones(blocks, np.uint8), np.zeros(blocks, np.int64)
    body: list[bytes] = [b""] * blocks
    full = n // BLOCK
    for first, last, size in ((0, full, BLOCK), (full, blocks, n - full * BLOCK)):
        if first == last:
            continue
        part = ids[first * BLOCK : first * BLOCK + (last - first) * size].reshape(-1, size)
        low = part.min(axis=1)
        diff = part - low[:, None]
        at = min(size - 1, size * PERCENTILE // 100)
        top = np.partition(diff, at, axis=1)[:, at]
        bits = np.maximum(1, np.ceil(np.log2(top.astype(np.float64) + 1))).astype(np.uint8)
        minimum[first:last], width[first:last] = low, bits
        for w in np.unique(bits):
            rows = np.flatnonzero(bits == w)
            chosen = diff[rows]
            over = chosen >> np.uint32(w) > 0 if w < 32 else np.zeros(chosen.shape, bool)
            packed = _pack(np.where(over, 0, chosen), int(w))
            many = over.sum(axis=1)
            exceptions[first + rows] = many
            for k, r in enumerate(rows):
                body[first + r] = packed[k].tobytes()
                if many[k]:
                    where = np.flatnonzero(over[k])
                    body[first + r] += where.astype("<u2").tobytes() + chosen[k][where].astype("<u4").tobytes()
    lengths = np.fromiter(map(len, body), np.int64, blocks)
    return b"".join(body), {"start": np.cumsum(lengths) - lengths, "minimum": minimum, "count": count, "exceptions": exceptions, "width": width}


_INDEX = (("start", "<u8"), ("minimum", "<u4"), ("count", "<u2"), ("exceptions", "<u2"), ("width", "<u1"))
_DOCS = (("doc_id", "<i8"), ("null", "<u1"), ("ids", "<u8"))


def write_segment(ids: np.ndarray, counts: np.ndarray, doc_ids: pa.Array) -> bytes:
    body, index = encode_blocks(ids)
    known = np.asarray(doc_ids.is_null())
    docs = {"doc_id": np.asarray(doc_ids.fill_null(0)), "null": known, "ids": counts}
    return b"".join(
        [_HEAD.pack(MAGIC, len(counts), len(ids), len(index["start"]), len(body)), body]
        + [index[k].astype(t).tobytes() for k, t in _INDEX]
        + [np.asarray(docs[k]).astype(t).tobytes() for k, t in _DOCS]
    )


def _tables(raw: memoryview) -> tuple[memoryview, dict, dict]:
    magic, docs, _, blocks, length = _HEAD.unpack_from(raw, 0)
    if magic != MAGIC:
        raise ValueError("not a segment of this format")
    at, out = _HEAD.size + length, ({}, {})
    for names, n, into in ((_INDEX, blocks, out[0]), (_DOCS, docs, out[1])):
        for k, t in names:
            into[k] = np.frombuffer(raw, t, n, at)
            at += n * np.dtype(t).itemsize
    return raw[_HEAD.size : _HEAD.size + length], *out


def read_block(body: memoryview, index: dict, b: int) -> np.ndarray:
    """The ids of one block, through its index entry alone."""
    n, w, at = int(index["count"][b]), int(index["width"][b]), int(index["start"][b])
    size = (n * w + 7) // 8
    ids = _unpack(np.frombuffer(body, np.uint8, size, at)[None, :], w, n)[0]
    if m := int(index["exceptions"][b]):
        where = np.frombuffer(body, "<u2", m, at + size)
        ids = ids.copy()
        ids[where] = np.frombuffer(body, "<u4", m, at + size + 2 * m)
    return ids + index["minimum"][b]


def read_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(ids, ids per document, document ids)."""
    body, index, docs = _tables(memoryview(raw))
    ids = [read_block(body, index, b) for b in range(len(index["start"]))]
    return (
        np.concatenate(ids) if ids else np.zeros(0, np.uint32),
        docs["ids"].astype(np.int64),
        pa.array(docs["doc_id"].astype(np.int64), pa.int64(), mask=docs["null"].astype(bool)),
    )


_SEGMENTS = pa.schema([("part", pa.int64()), ("segment", pa.int64()), ("content", pa.binary())])
_READ = pa.schema([("part", pa.int64()), ("segment", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def token_segments(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Segments (part, segment, content) of all documents in ascending doc_id order (null ids first, equal ids by a hash of the text)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, segment = bpe.column_bpe(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, ids, counts in coder.texts(*buffers(batch.column(1))):
                ids, counts = bpe.with_end(ids, counts, end_id)
                content = write_segment(ids, counts, batch.column(0).slice(i, j - i))
                yield record(_SEGMENTS, [part], [segment], [content])
                segment += 1

    text = F.coalesce("text", F.lit(""))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    # The hash and the row part many rows of one id, or without, into several ranges.
    order = ("doc_id", "h", "row")
    return ordered.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(lean(run, tokenizer), "part long, segment long, content binary")


def read_segments(segments: DataFrame) -> DataFrame:
    """One row per stored document, from the stored bytes: doc_id, start, n_tokens, ids_crc32."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, segment, content in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2), strict=True):
            ids, counts, doc_ids = read_segment(content.as_buffer())
            at = np.concatenate([[0], np.cumsum(counts)])
            crc = [bpe.crc32(ids[at[i] : at[i + 1]]) for i in range(len(counts))]
            n = len(counts)
            yield record(_READ, np.full(n, part), np.full(n, segment), np.arange(n), doc_ids, counts, crc)

    rows = map_batches(segments, one, "part long, segment long, place long, doc_id long, n_tokens long, ids_crc32 long")
    own = Window.partitionBy("part").orderBy("segment", "place").rowsBetween(Window.unboundedPreceding, -1)
    rows = stage(rows, "token-rows")
    # Ranges are numbered in order; one row a range.
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = parts.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return (
        rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
        .join(base, "part")
        .select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_output(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode, write and read back every document.

    Defined results: a null text is empty (only the end id); an empty table gives
    no rows; repeated rows are stored each; extra columns are ignored.
    """
    return read_segments(stage(token_segments(docs, tokenizer or bpe.tokenizer_path(), end_id), "token-segments"))
