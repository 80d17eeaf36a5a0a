"""Vectorised text primitives shared by the corpus operators.

Every function works on one *column slice*: the concatenated UTF-8 bytes of some
texts plus their byte offsets. Nothing here loops over characters or words in
Python; the cost per byte is a handful of NumPy passes. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once. Working arrays take about 60 bytes per byte of text.
SLICE_BYTES = 2 << 20

_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    kind = np.int64 if big else np.int32
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(
    data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES, cut: Callable[[np.ndarray], np.ndarray] | None = None
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of rows of about ``limit`` bytes: (first row, end row, bytes, offsets).

    With ``cut`` (bytes → places where a text may be cut), a longer text comes in parts: several results in a row
    that name this row alone. A text with no such place comes whole.
    """
    n, i = len(offsets) - 1, 0
    while i < n:
        if cut is not None and offsets[i + 1] - offsets[i] > limit:
            yield from ((i, i + 1, data[a:b], np.array([0, b - a])) for a, b in parts_of(data, int(offsets[i]), int(offsets[i + 1]), limit, cut))
            i += 1
            continue
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def parts_of(data: np.ndarray, start: int, stop: int, limit: int, cut: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Bounds of the parts of one text: about ``limit`` bytes each, longer where no cut is allowed."""
    while stop - start > limit:
        look, end = start + 1, start + limit
        places = cut(data[look:end])
        while not len(places) and end < stop:  # look on, with a few bytes seen again
            look, end = end - 4, min(stop, end + limit)
            places = cut(data[look:end])
        if not len(places):
            break
        end = look + int(places[-1] if look == start + 1 else places[0])
        yield start, end
        start = end
    yield start, stop


_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_NO_WORD = np.ones(256, bool)
_NO_WORD[48:58] = _NO_WORD[128:] = False
_NO_WORD[_ALPHA] = False


def between_words(data: np.ndarray) -> np.ndarray:
    """Places of ASCII bytes that are no letter and no digit: no word reaches over them."""
    return np.flatnonzero(_NO_WORD[data])


def between_plain_words(data: np.ndarray) -> np.ndarray:
    """Places of blanks between two ASCII letters."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    return np.flatnonzero((data[1:-1] == 32) & _ALPHA[data[:-2]] & _ALPHA[data[2:]]) + 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _ASCII_LOWER[data]


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross a text's edge: (starts, ends, runs before each text)."""
    n = len(member)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins = member.copy()
    begins[1:] &= ~member[:-1] | cut[1:n]
    ends = member.copy()
    ends[:-1] &= ~member[1:] | cut[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]] along axis 0; empty segments give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.result_type(values.dtype, np.int64) if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def encode_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Dictionary-code the byte spans: (code per span, distinct spans as a binary array)."""
    if len(starts) == 0:
        return np.zeros(0, np.int64), pa.array([], pa.binary())
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    if len(data) == offsets[-1] and starts[0] == 0:  # the spans are the whole buffer
        packed = np.ascontiguousarray(data)
    else:
        step = np.ones(int(offsets[-1]), np.int32)
        step[0] = starts[0]
        step[offsets[1:-1]] = starts[1:] - ends[:-1] + 1
        packed = data[np.cumsum(step)]
    spans = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), so that low and high bits are equally usable."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
