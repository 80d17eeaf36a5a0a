"""Byte-level BPE ids of whole columns, equal to the tokenizers library's own.

The library pre-splits a text into pieces (letters, digits, other marks, white
space, English contractions) and merges inside each piece alone. So a piece has
the same ids wherever it stands. Here NumPy finds the pieces of a whole column,
Arrow dictionary-codes them, and the library's model merges each distinct piece once
per worker, many in one call; ids are then gathered. Texts with the special token's
string, or with characters whose class differs between Unicode versions, go to the
library whole.
"""

from __future__ import annotations

import codecs
import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, repeat
from operator import attrgetter
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa

from docloom.llm.plumbing import KEPT
from docloom.llm.textcore import between_plain_words, encode_spans, segment_sum, slices

if TYPE_CHECKING:
    from tokenizers import Tokenizer

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
_OTHER, _LETTER, _NUMBER, _SPACE, _UNSURE = range(5)
#: Unicode White_Space.
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, _UNSURE, np.uint8)
    kinds = {"L": _LETTER, "N": _NUMBER}
    old = unicodedata.ucd_3_2_0
    for c in range(0x20000):
        ch = chr(c)
        now, then = unicodedata.category(ch), old.category(ch)
        if then != "Cn" and kinds.get(now[0]) == kinds.get(then[0]):
            table[c] = kinds.get(now[0], _OTHER)
    table[_WHITE] = _SPACE
    return table


def _byte_classes(data: np.ndarray) -> np.ndarray:
    return by_character(data, _classes())


def by_character(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[code point] of the character that each byte belongs to."""
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b0 = data[lead].astype(np.int32)
        at = np.zeros((3, len(lead)), np.int32)
        for k in range(3):
            at[k] = data[np.minimum(lead + k + 1, len(data) - 1)] & 0x3F
        two, four = b0 < 0xE0, b0 >= 0xF0
        point = np.where(two, (b0 & 0x1F) << 6 | at[0], np.where(four, (b0 & 7) << 18 | at[0] << 12 | at[1] << 6 | at[2], (b0 & 15) << 12 | at[0] << 6 | at[1]))
        cls = table[np.minimum(point, len(table) - 1)]
        out[lead] = cls
        out[lead + 1] = cls
        out[lead[~two] + 2] = cls[~two]
        out[lead[four] + 3] = cls[four]
    return out


def pieces(data: np.ndarray, offsets: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pre-split pieces, and for each text the number of pieces before it."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = np.empty(n + 1, bool)
    begin[0] = begin[n] = True
    np.not_equal(cls[1:], cls[:-1], out=begin[1:n])
    begin |= edge
    # White space before a mark, inside a text: its last blank joins what follows; another last white character stands alone.
    after = np.flatnonzero(begin[1:n] & (cls[:-1] == _SPACE) & (cls[1:] != _SPACE) & ~edge[1:n]) + 1
    blank = data[after - 1] == 32
    begin[after[blank] - 1] = True
    begin[after[blank]] = False
    other = after[~blank]
    last = other - 1
    while len(rest := np.flatnonzero((data[last] & 0xC0) == 0x80)):
        last[rest] -= 1
    begin[last] = True
    # Contractions: an apostrophe that begins a piece.
    for p in np.flatnonzero((data == 39) & begin[:n]):
        stop = int(offsets[np.searchsorted(offsets, p, "right")]) if p < n else n
        tail = data[p + 1 : min(p + 3, stop)].tobytes()
        size = 1 if tail[:1] in (b"s", b"t", b"m", b"d") else 2 if tail in (b"re", b"ve", b"ll") else 0
        if size:
            begin[p + 1] = False
            begin[p + 1 + size] = True
    starts = np.flatnonzero(begin[:n])
    return starts, np.searchsorted(starts, offsets)


#: No UTF-8 text has this byte.
_GAP = 255
_IDS = attrgetter("id")


def _byte_letters(tokenizer: Tokenizer) -> str | None:
    """The letter that byte-level vocabularies write for each byte, if joining pieces by the letter of ``_GAP`` leaves their merges alone.

    None: the tokenizer is set up otherwise, or some entry of its vocabulary holds that letter.
    """
    from tokenizers import models, pre_tokenizers

    model, split = tokenizer.model, tokenizer.pre_tokenizer
    if not isinstance(model, models.BPE) or not isinstance(split, pre_tokenizers.ByteLevel) or split.add_prefix_space:
        return None
    others = (model.dropout, model.unk_token, model.continuing_subword_prefix, model.end_of_word_suffix, model.ignore_merges, tokenizer.normalizer, tokenizer.truncation, tokenizer.padding)
    if any(others):
        return None
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(seen)))}
    words = tokenizer.get_vocab(with_added_tokens=False)
    if not all(c in words for c in letter.values()) or any(letter[_GAP] in w for w in words if w != letter[_GAP]):
        return None
    return "".join(letter[b] for b in range(256))


class ColumnBpe:
    """Encodes column slices; keeps the ids of at most ``capacity`` distinct pieces, those met in most slices when it is full."""

    def __init__(self, path: str, capacity: int = 450_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.capacity = capacity
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters(self.tokenizer)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.met = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _make_room(self) -> None:
        """Forget the pieces met in fewest slices, so that at most half of the capacity is left; halve what the others were met."""
        n = len(self.known)
        at_least = np.cumsum(np.bincount(self.met[:n])[::-1])[::-1]
        least = np.count_nonzero(at_least > self.capacity // 2)
        keep = np.flatnonzero(self.met[:n] >= least)
        ids, count, met = self._gather(keep), self.count[keep], self.met[keep] // 2
        self.known = dict(zip(compress(self.known, self.met[:n] >= least), range(len(keep)), strict=True))
        self.flat[: len(ids)] = ids
        self.at[: len(keep)], self.count[: len(keep)], self.met[: len(keep)] = np.cumsum(count) - count, count, met
        self.used = len(ids)

    def _merge(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, number of ids per piece), by the library."""
        if self.letters is None:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(chain.from_iterable(ids), np.uint32, int(count.sum())), count
        model, gap, parts = self.tokenizer.model, bytes([_GAP]), []
        for i in range(0, len(new), 256):
            tokens = model.tokenize(codecs.charmap_decode(gap.join(new[i : i + 256]) + gap, "strict", self.letters)[0])
            parts.append(np.fromiter(map(_IDS, tokens), np.uint32, len(tokens)))
        ids = np.concatenate(parts)
        inside = ids != model.token_to_id(self.letters[_GAP])
        return ids[inside], np.diff(np.flatnonzero(~inside), prepend=-1) - 1

    def _learn(self, new: list[bytes]) -> None:
        first = len(self.known)
        ids, count = self._merge(new)
        while len(self.at) < first + len(new):
            self.at, self.count, self.met = (np.concatenate([x, x]) for x in (self.at, self.count, self.met))
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, self.flat])
        stop = first + len(new)
        self.count[first:stop] = count
        self.at[first:stop] = self.used + np.cumsum(count) - count
        self.met[first:stop] = 0
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known.update(zip(new, range(first, stop)))

    def _slots(self, distinct: list[bytes]) -> np.ndarray:
        def find() -> tuple[np.ndarray, np.ndarray]:
            slots = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
            return slots, np.flatnonzero(slots < 0)

        slots, new = find()
        if len(self.known) + len(new) > self.capacity and len(new):
            self._make_room()
            slots, new = find()
            if len(self.known) + len(new) > self.capacity:
                # Start over with this slice's pieces, however many they are.
                self._reset()
                new = np.arange(len(distinct))
        if len(new):
            first = len(self.known)
            self._learn([distinct[i] for i in new.tolist()])
            slots[new] = np.arange(first, first + len(new))
        self.met[slots] += 1
        return slots

    def _gather(self, slot: np.ndarray) -> np.ndarray:
        """The ids of the pieces in these slots, one after another."""
        lengths = self.count[slot]
        total = int(lengths.sum())
        small = np.int32 if max(total, self.used) < 2**31 else np.int64
        at = np.repeat((self.at[slot] - (np.cumsum(lengths) - lengths)).astype(small), lengths)
        at += np.arange(total, dtype=small)
        return self.flat[at]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids per text)."""
        cls = _byte_classes(data)
        odd = set(np.searchsorted(offsets, np.flatnonzero(cls == _UNSURE), "right") - 1)
        if any(s in (raw := data.tobytes()) for s in self.special):
            odd |= {i for i in range(len(offsets) - 1) if any(s in raw[offsets[i] : offsets[i + 1]] for s in self.special)}
        starts, before = pieces(data, offsets, cls)
        ends = np.append(starts[1:], len(data))
        if odd:
            keep = np.ones(len(starts), bool)
            for i in odd:
                keep[before[i] : before[i + 1]] = False
            starts, ends = starts[keep], ends[keep]
            before = np.concatenate([[0], np.cumsum(keep)])[before]
        codes, distinct = encode_spans(data, starts, ends)
        slot = self._slots(distinct.to_numpy(zero_copy_only=False).tolist())[codes]
        counts = segment_sum(self.count[slot], before)
        ids = self._gather(slot)
        if odd:
            parts, at = [], np.concatenate([[0], np.cumsum(counts)])
            counts = counts.copy()
            for i in range(len(counts)):
                if i in odd:
                    own = np.array(self.tokenizer.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
                    parts.append(own)
                    counts[i] = len(own)
                else:
                    parts.append(ids[at[i] : at[i + 1]])
            ids = np.concatenate(parts) if parts else ids
        return ids, counts


    def texts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, ids per text) of a column; a long text is encoded in parts, cut between plain words, and comes whole."""
        held: list[np.ndarray] = []
        seen = 0
        for i, j, chunk, at in slices(data, offsets, cut=between_plain_words):
            ids, counts = self.encode(chunk, at)
            if j - i == 1 and len(chunk) < offsets[j] - offsets[i]:
                held.append(ids)
                seen += len(chunk)
                if seen < offsets[j] - offsets[i]:
                    continue
                ids = np.concatenate(held)
                counts, held, seen = np.array([len(ids)]), [], 0
            yield i, j, ids, counts


def column_bpe(path: str) -> ColumnBpe:
    """One encoder per worker process and vocabulary; passes that do not tokenise drop it."""
    if path not in KEPT:
        KEPT[path] = ColumnBpe(path)
    return KEPT[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to each text's ids."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def arrow_strings(texts: list[str | None]) -> pa.Array:
    return pa.array(texts, pa.string())
