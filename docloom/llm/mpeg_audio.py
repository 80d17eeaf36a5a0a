"""MPEG audio columns: write, parse, resynchronise, verify, seek.

``parse`` reads any stream: ID3v2 tags in front (unsynchronised ones and extended
headers too), an ID3v1 tag where frames have ended, frame headers found by
synchronisation (a header counts if the next one follows where it says, or the stream
ends there), a Xing/Info or VBRI table in the first frame, CRC-16 of protected frames
of all three layers, exact duration in samples and the byte place of each frame.
What lies inside a frame is never taken for a tag or a header.

``carry`` stores bytes losslessly in the main-data part of protected variable-bitrate
frames, as many bytes per frame as its bitrate leaves; the payload's length stands in
a user text frame of the ID3v2 tag, and a Xing table in the first frame holds frame
and byte counts and 100 seek points. Decoders treat the frames as audio; the content
is data, not sound.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.plumbing import map_batches, record, stage

UNIT = 64
PAYLOAD_TAG = b"payload_bytes"
#: Bitrates in kbit/s by index for MPEG-1 and MPEG-2/2.5, layers I to III.
RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Sampling rates in Hz by the header's version bits and index.
SAMPLING = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


#: Layer II allocation widths in bits, as (bits, subbands) runs: MPEG-1 tables a to d, and that of MPEG-2.
ALLOCATION = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "low": ((4, 4), (3, 7), (2, 19)),
}


@dataclass(frozen=True)
class Header:
    version: int  # 1: MPEG-1, 2: MPEG-2 and MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    hz: int
    mono: bool
    joint: int  # first subband that both channels share; 32: none
    samples: int
    size: int
    side: int


@lru_cache(4096)
def header(word: int) -> Header | None:
    """Decode 32 header bits; None if they are no valid (or a free-format) header."""
    kind, layer, rate, sampling = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or kind == 1 or layer == 4 or rate in (0, 15) or sampling == 3:
        return None
    version, pad, mono = 1 if kind == 3 else 2, word >> 9 & 1, word >> 6 & 3 == 3
    kbps, hz = RATES[version, layer][rate], SAMPLING[kind][sampling]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    size = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    side = 0 if layer < 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    joint = 4 * (word >> 4 & 3) + 4 if word >> 6 & 3 == 1 else 32
    return Header(version, layer, not word >> 16 & 1, kbps, hz, mono, joint, samples, size, side)


@lru_cache(1)
def _crc_table() -> tuple[int, ...]:
    out = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
        out.append(value)
    return tuple(out)


def crc16(data: bytes, bits: int = 0, value: int = 0xFFFF) -> int:
    """CRC-16 of MPEG audio (polynomial 0x8005, start 0xFFFF) of whole bytes and the first ``bits`` bits of one more."""
    table = _crc_table()
    for byte in data[:-1] if bits else data:
        value = (value << 8 & 0xFF00) ^ table[value >> 8 ^ byte]
    for k in range(bits):
        top = value >> 15 ^ data[-1] >> (7 - k) & 1
        value = (value << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return value


def _allocation(h: Header) -> list[int]:
    """Layer II: width of the allocation field of each subband."""
    each = h.kbps if h.mono else h.kbps // 2
    if h.version == 2:
        name = "low"
    elif each in (32, 48):
        name = "d" if h.hz == 32000 else "c"
    else:
        name = "a" if h.hz == 48000 or each <= 80 else "b"
    return [bits for bits, many in ALLOCATION[name] for _ in range(many)]


def covered_bits(h: Header, body: bytes) -> int:
    """Bits after the CRC that it covers: side information (III), allocation (I), allocation and scale-factor selection (II)."""
    channels = 1 if h.mono else 2
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (32 if h.mono else 32 + min(h.joint, 32))
    value, width, at, chosen = int.from_bytes(body, "big"), 8 * len(body), 0, 0
    for band, bits in enumerate(_allocation(h)):
        own = channels if band < h.joint else 1
        for _ in range(own):
            used = value >> max(0, width - at - bits) & ((1 << bits) - 1)
            chosen += 2 * (channels if own == 1 else 1) if used else 0
            at += bits
    return at + chosen


def crc_fails(data: bytes, at: int, h: Header) -> bool:
    """Whether the protected frame at ``at`` doesn't have the checksum that it carries."""
    body = data[at + 6 : at + min(h.size, 6 + 64)]
    bits = min(covered_bits(h, body), 8 * len(body))
    own = data[at + 2 : at + 4] + body[: -(-bits // 8)]
    return crc16(own, bits % 8) != int.from_bytes(data[at + 4 : at + 6], "big")


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    frames: list[tuple[int, Header]] = field(default_factory=list)
    skipped: int = 0
    crc_checked: int = 0
    crc_failed: int = 0
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    seek: list[int] = field(default_factory=list)
    samples: int = 0
    hz: int = 0


def _synchsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _text(raw: bytes) -> str:
    kind, body = raw[:1], raw[1:]
    return body.decode({b"\0": "latin-1", b"\1": "utf-16", b"\2": "utf-16-be"}.get(kind, "utf-8"), "replace")


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Read the tag in front; returns where it ends."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    major, flags, end = data[3], data[5], min(len(data), 10 + _synchsafe(data[6:10]))
    raw = data[10:end]
    if flags & 0x80:  # unsynchronised: a zero byte stands after each 0xFF
        raw = raw.replace(b"\xff\0", b"\xff")
    at = 0
    if flags & 0x40 and len(raw) >= 4:  # an extended header: its size counts itself from version 4 on
        at = _synchsafe(raw[:4]) if major >= 4 else 4 + int.from_bytes(raw[:4], "big")
    while at + 10 <= len(raw) and raw[at : at + 4].strip(b"\0"):
        size = _synchsafe(raw[at + 4 : at + 8]) if major >= 4 else int.from_bytes(raw[at + 4 : at + 8], "big")
        name, body = raw[at : at + 4].decode("latin-1"), raw[at + 10 : at + 10 + size]
        if name == "TXXX":
            key, _, value = _text(body).partition("\0")
            tags[f"TXXX:{key}"] = value.rstrip("\0")
        elif name[0] == "T":
            tags[name] = _text(body).rstrip("\0")
        at += 10 + size
    return min(len(data), end + 10) if flags & 0x10 and major >= 4 else end  # a footer


def _table(data: bytes, at: int, h: Header, out: Stream) -> None:
    """A Xing, Info or VBRI table in the first frame."""
    x = at + 4 + 2 * h.protected + h.side
    if data[x : x + 4] in (b"Xing", b"Info") or (h.protected and data[(x := x - 2) : x + 4] in (b"Xing", b"Info")):
        flags, p = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8
        out.table = data[x : x + 4].decode()
        if flags & 1:
            out.table_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 2:
            out.table_bytes, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 4:
            out.seek = list(data[p : p + 100])
    elif data[at + 36 : at + 40] == b"VBRI" and len(data) >= at + 62:
        out.table = "VBRI"
        out.table_bytes, out.table_frames = struct.unpack(">II", data[at + 46 : at + 54])
        many, scale, width, each = struct.unpack(">HHHH", data[at + 54 : at + 62])
        total = 0
        for k in range(many):
            raw = data[at + 62 + k * width : at + 62 + (k + 1) * width]
            total += int.from_bytes(raw, "big") * scale
            out.seek.append(total)


def _id3v1(data: bytes, at: int, tags: dict[str, str]) -> None:
    for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
        if value := data[at + a : at + b].rstrip(b"\0 ").decode("latin-1"):
            tags[f"v1:{key}"] = value


def parse(data: bytes) -> Stream:
    """Read a whole stream; bytes that belong to no frame or tag are counted in ``skipped``.

    An ID3v1 tag counts where a frame ends (or where no frame is being read) 128 bytes before the stream's end, so
    that the same letters inside a frame mean nothing.
    """
    out = Stream()
    at, stop = _id3v2(data, out.tags), len(data)
    tag = stop - 128 if data[-128:-125] == b"TAG" else -1
    locked = False
    while at < stop:
        if at == tag:
            _id3v1(data, at, out.tags)
            stop = at
            break
        h = header(int.from_bytes(data[at : at + 4], "big")) if at + 4 <= stop else None
        after = at + h.size if h else 0
        if h and after <= stop and (locked or after in (stop, tag) or header(int.from_bytes(data[after : after + 4], "big"))):
            if not out.frames:
                _table(data, at, h, out)
                out.hz = h.hz
            if h.protected:
                out.crc_checked += 1
                out.crc_failed += crc_fails(data, at, h)
            out.frames.append((at, h))
            at, locked = after, True
            continue
        locked = False
        following = data.find(b"\xff", at + 1, stop)
        following = stop if following < 0 else following
        if at < tag < following:
            following = tag
        out.skipped += following - at
        at = following
    out.samples = sum(h.samples for _, h in out.frames[1 if out.table else 0 :])
    return out


@lru_cache(1)
def _carriers() -> list[tuple[int, bytes, int]]:
    """(payload bytes, header + CRC + side information, frame size) of each bitrate of MPEG-1 Layer III, 32 kHz, mono, protected."""
    out = []
    for rate in range(1, 15):
        head = (0x7FF << 21 | 3 << 19 | 1 << 17 | 0 << 16 | rate << 12 | 2 << 10 | 3 << 6).to_bytes(4, "big")
        h = header(int.from_bytes(head, "big"))
        side = bytes(h.side)
        front = head + crc16(head[2:] + side).to_bytes(2, "big") + side
        out.append((h.size - len(front), front, h.size))
    return out


def carry(payload: bytes) -> bytes:
    """A stream that holds the payload."""
    frame = lambda name, body: name + len(body).to_bytes(4, "big") + b"\0\0" + body
    body = frame(b"TXXX", b"\0" + PAYLOAD_TAG + b"\0" + str(len(payload)).encode())
    n = len(body)
    tag = b"ID3\x03\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + body
    carriers, parts, places, at, size = _carriers(), [], [], 0, 0
    room, front, whole = carriers[-1]
    while at < len(payload):
        left = len(payload) - at
        if left < room:
            room, front, whole = next(c for c in carriers if c[0] >= left)
        parts += [front, payload[at : at + room], bytes(max(0, room - left))]
        places.append(size)
        size += whole
        at += room
    first_room, first_front, first_size = next(c for c in carriers if c[0] >= 116)
    total = first_size + size
    seek = bytes(min(255, 256 * (first_size + places[min(len(places) - 1, k * len(places) // 100)]) // total) for k in range(100)) if places else bytes(100)
    xing = b"Xing" + struct.pack(">III", 7, len(places), total) + seek
    return b"".join([tag, first_front, xing, bytes(first_room - len(xing)), *parts])


def carried(data: bytes, stream: Stream) -> bytes:
    """The payload of a stream that ``carry`` made."""
    frames = stream.frames[1:] if stream.table else stream.frames
    return b"".join(data[at + 6 + h.side : at + h.size] for at, h in frames)[: int(stream.tags[f"TXXX:{PAYLOAD_TAG.decode()}"])]


def feature(stream: Stream) -> str:
    """What the stored bytes say: exact duration, bitrates, checks and the frames' places."""
    places = np.array([at for at, _ in stream.frames], "<u8").tobytes()
    rates = sorted({h.kbps for _, h in stream.frames})
    return (
        f"frames={len(stream.frames)};samples={stream.samples};hz={stream.hz};kbps={','.join(map(str, rates))};table={stream.table}:{stream.table_frames}:{stream.table_bytes}"
        f";crc={stream.crc_checked - stream.crc_failed}/{stream.crc_checked};skipped={stream.skipped};seek_crc32={zlib.crc32(places)}"
    )


_PARSED = pa.schema(
    [(k, pa.int64()) for k in ("frames", "samples", "hz", "skipped", "crc_checked", "crc_failed")]
    + [("table", pa.string()), ("tags", pa.map_(pa.string(), pa.string())), ("offsets", pa.list_(pa.int64()))]
)


def parse_column(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """key, and for each stream: frames, samples, hz, skipped, crc_checked, crc_failed, table, tags, frame offsets.

    Defined results: null or foreign bytes have no frames; repeated and equal streams give equal values; an empty table
    gives no rows; other columns are ignored.
    """
    kind = media.schema[key].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [parse(x or b"") for x in batch.column(1).to_pylist()]
        columns = [[len(s.frames) for s in found], *([getattr(s, k) for s in found] for k in ("samples", "hz", "skipped", "crc_checked", "crc_failed", "table"))]
        columns += [[list(s.tags.items()) for s in found], [[at for at, _ in s.frames] for s in found]]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, _PARSED, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[key, *_PARSED.names])

    ddl = f"`{key}` {kind}, frames long, samples long, hz long, skipped long, crc_checked long, crc_failed long, table string, tags map<string,string>, offsets array<long>"
    return map_batches(media.select(key, column), one, ddl)


_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, filled with zero bytes to a positive multiple of 64, as a stream."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        sizes = [len(t or b"") for t in texts]
        media = [carry((t or b"").ljust(max(UNIT, -(-n // UNIT) * UNIT), b"\0")) for t, n in zip(texts, sizes, strict=True)]
        yield record(_MEDIA, batch.column(0), sizes, media)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), one, "doc_id long, n_bytes long, media binary")


def media_column(docs: DataFrame) -> DataFrame:
    """Store each text as a media column, read the stored bytes back and describe them.

    Defined results: a null or empty text gives a payload of 64 zero bytes; repeated
    rows and equal texts give equal values; an empty table gives no rows; extra columns are ignored.
    """

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for data in batch.column(2).to_pylist():
            stream = parse(data)
            payload = carried(data, stream)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(stream)))
        yield record(_OUT, batch.column(0), batch.column(1), *(list(c) for c in zip(*rows, strict=True)))

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(stage(store_texts(docs), "media"), one, ddl)
