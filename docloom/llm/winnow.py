"""Benchmark decontamination by winnowing.

Words are hashed; of each ``WINDOW`` consecutive k-gram hashes the smallest is kept
(the rightmost of equal ones). Each span of ``GRAM + WINDOW - 1`` = 13 words has such
a minimum, and equal spans have the same one at the same place. So every shared span
has a fingerprint that both texts keep. Fingerprints of the documents are joined with
those of the items, and each meeting place is extended to the 13-word spans whose
minimum it is; those that an item has are hits, and overlapping hits make the maximal
shared span. Each span of a document is looked at once, and the items' side holds each
distinct span once with the set of its items: however often words repeat, the work
grows with the words and not with pairs of places. Items of fewer words are one
window: all word runs of that very length are kept (winnowing with a window of one).

The item side is compiled to sorted arrays and sent to the executors where it is at
most ``ITEM_BYTES`` of text (checked). Beyond that, fingerprints and spans, never
texts, are shuffled and joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.plumbing import filter_batches, map_batches, record, salted, stage
from docloom.llm.textcore import between_words, buffers, encode_spans, lower_ascii, mix64, runs, segment_sum, slices

SPAN = 13
GRAM = 5
WINDOW = SPAN - GRAM + 1
ITEM_BYTES = 8 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash per word, words before each text)."""
    low = lower_ascii(data)
    starts, ends, before = runs(_WORD[low], offsets)
    codes, distinct = encode_spans(low, starts, ends)
    h = xxhash.xxh64_intdigest
    known = np.fromiter((h(w, 7) for w in distinct.to_pylist()), np.uint64, len(distinct))
    return known[codes] if len(codes) else np.zeros(0, np.uint64), before


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words (those that cross texts are the caller's to drop)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, size):
        out *= _BASE
        out += words[k : n + k]
    return mix64(out)


def minima(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the smallest k-gram of each 13-word span, rightmost of equal ones; hash of each k-gram)."""
    grams = gram_hashes(words, GRAM)
    n = max(0, len(grams) - WINDOW + 1)
    place, least = np.arange(n), grams[:n].copy()
    for k in range(1, WINDOW):
        now = grams[k : n + k]
        better = np.flatnonzero(now <= least)
        place[better], least[better] = better + k, now[better]
    return place, grams


def inside(before: np.ndarray, n: int, size: int) -> np.ndarray:
    """Starts of the runs of ``size`` words that stay inside one text; n: words of all texts."""
    fits = np.zeros(n + 1, np.int64)
    count = before[1:] - before[:-1]
    full = np.flatnonzero(count >= size)
    np.add.at(fits, before[full], 1)
    np.add.at(fits, before[full] + count[full] - size + 1, -1)
    return np.flatnonzero(np.cumsum(fits)[:n] > 0)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key; -1: absent."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


class Items:
    """The compiled item side: of each window size the distinct windows, in order of their hashes, and each one's set of items."""

    def __init__(self, ids: list, texts: list):
        pairs = [(i, t) for i, t in zip(ids, texts, strict=True) if i is not None]
        names = np.array([str(i) for i, _ in pairs], object)
        self.names, item = np.unique(names, return_inverse=True) if len(names) else (names, np.zeros(0, np.int64))
        self.words, before = _all_word_hashes(pa.array([t for _, t in pairs], pa.string()))
        size = before[1:] - before[:-1]
        self.hashes: dict[int, np.ndarray] = {}
        self.sample: dict[int, np.ndarray] = {}  # a place of each window
        self.set_of: dict[int, np.ndarray] = {}
        sets: dict[bytes, int] = {}
        for n in sorted({min(SPAN, int(k)) for k in size if k}):
            own = np.flatnonzero(size >= SPAN if n == SPAN else size == n)
            kept = np.zeros(len(size), bool)
            kept[own] = True
            starts = inside(before, len(self.words), n)
            text = np.searchsorted(before, starts, "right") - 1
            starts, text = starts[kept[text]], text[kept[text]]
            self.hashes[n], first, window = np.unique(gram_hashes(self.words, n)[starts], return_index=True, return_inverse=True)
            self.sample[n] = starts[first]
            once = np.unique(window * len(self.names) + item[text])
            bounds = np.searchsorted(once, np.arange(len(first) + 1) * len(self.names))
            members = (once % len(self.names)).astype(np.int64)
            self.set_of[n] = np.array([sets.setdefault(members[a:b].tobytes(), len(sets)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.int64)
        self.sets = [np.frombuffer(x, np.int64) for x in sets]
        place, grams = minima(self.words)
        self.kept = np.unique(grams[place[inside(before, len(self.words), SPAN)]])

    def named(self, sets: np.ndarray) -> list[str]:
        """Ids of the items of some sets."""
        return self.names[np.unique(np.concatenate([self.sets[k] for k in sets]))].tolist() if len(sets) else []


#: Words worked on at once: bounds the arrays, however long a text is.
WORDS_AT_ONCE = 400_000


def hits(words: np.ndarray, before: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, item set) of each window of the texts that is an item's window."""
    out = [(np.zeros(0, np.int64),) * 3]
    for low in range(0, len(words), WORDS_AT_ONCE):
        own = words[low : low + WORDS_AT_ONCE + SPAN - 1]  # windows that begin in this block
        edges = np.clip(before - low, 0, len(own))
        for n, known in items.hashes.items():
            start = inside(edges, len(own), n)
            start = start[start < WORDS_AT_ONCE]
            if n == SPAN:
                place, grams = minima(own)
                # Join of the kept fingerprints, each once; then the spans around those that meet.
                kept = np.unique(place[start])
                met = np.zeros(len(grams), bool)
                met[kept[_find(items.kept, grams[kept]) >= 0]] = True
                start = start[met[place[start]]]
            at = _find(known, gram_hashes(own, n)[start])
            start, at = start[at >= 0], at[at >= 0]
            same = np.ones(len(start), bool)
            for k in range(n):
                same &= own[start + k] == items.words[items.sample[n][at] + k]
            start, at = start[same], at[same]
            out.append((start + low, np.full(len(start), n), items.set_of[n][at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def covered(n: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step)[:n] > 0


def items_digest(ids: list) -> str:
    return hashlib.sha256(",".join(sorted({str(i) for i in ids})).encode()).hexdigest()


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
_DDL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def judge(texts: pa.Array, items: Items) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """(words, hit words, ids of the items with windows in it) of each text."""
    data, offsets = buffers(texts)
    n_words, n_hit, named = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [[] for _ in range(len(texts))]
    for i, j, words, before in _word_slices(data, offsets):
        first, size, sets = hits(words, before, items)
        n_words[i:j] = before[1:] - before[:-1]
        n_hit[i:j] = segment_sum(covered(len(words), first, first + size), before)
        once = np.unique((np.searchsorted(before, first, "right") - 1) * max(1, len(items.sets)) + sets)
        text = once // max(1, len(items.sets))
        for k in np.unique(text).tolist():
            named[i + k] = items.named(once[text == k] % len(items.sets))
    return n_words, n_hit, named


def _word_slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, words before each text); a long text is hashed in parts and comes whole."""
    row, held = -1, []
    for i, j, chunk, at in slices(data, offsets, cut=between_words):
        words, before = word_hashes(chunk, at)
        if j - i > 1 or len(chunk) == offsets[j] - offsets[i]:
            yield i, j, words, before
            continue
        if i != row:
            row, held, seen = i, [], 0
        held.append(words)
        seen += len(chunk)
        if seen == offsets[j] - offsets[i]:
            whole = np.concatenate(held)
            yield i, j, whole, np.array([0, len(whole)])


def _all_word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts, bounds, total = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for _, _, words, before in _word_slices(*buffers(texts)):
        parts.append(words)
        bounds.append(before[1:] + total)
        total += len(words)
    return np.concatenate(parts), np.concatenate(bounds)


def contaminated(n_words: np.ndarray, n_hit: np.ndarray) -> np.ndarray:
    return (n_hit > 0) & (20 * n_hit >= n_words)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
_DDL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _judge(docs: DataFrame, source: Items) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(source)

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n_words, n_hit, named = judge(batch.column(1), shared.value)
        yield record(_OUT, batch.column(0), n_words, n_hit, [len(x) for x in named], [items_digest(x) for x in named], contaminated(n_words, n_hit))

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), one, _DDL)


#: size: words of a window; gram: the fingerprint that stands for it; a, b: two hashes of the window itself.
_SPANS = pa.schema([("row", pa.string()), ("size", pa.int32()), ("gram", pa.int64()), ("starts", pa.list_(pa.int64())), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])
_SPANS_DDL = "row string, size int, gram long, starts array<long>, a array<long>, b array<long>"


def _span_rows(rows: DataFrame, sizes: list[int], own_size: bool) -> DataFrame:
    """A row for each kept fingerprint of each text: the windows (places and hashes) whose minimum it is.

    own_size: a text gives windows of its own size only (items); else of all ``sizes``.
    """

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = buffers(batch.column(1))
        for i, _, words, before in _word_slices(data, offsets):
            count = before[1:] - before[:-1]
            for low in range(0, len(words), WORDS_AT_ONCE):
                block = words[low : low + WORDS_AT_ONCE + SPAN - 1]
                edges = np.clip(before - low, 0, len(block))
                for n in sizes:
                    start = inside(edges, len(block), n)
                    text = np.searchsorted(before, start + low, "right") - 1
                    keep = start < WORDS_AT_ONCE
                    if own_size:
                        keep &= np.minimum(count[text], SPAN) == n
                    start, text = start[keep], text[keep]
                    if not len(start):
                        continue
                    a, b = gram_hashes(block, n)[start], gram_hashes(mix64(block ^ _BASE), n)[start]
                    if n == SPAN:
                        place, grams = minima(block)
                        at, gram = place[start], grams[place[start]]
                    else:
                        at, gram = start, a
                    fresh = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
                    bounds = pa.array(np.append(fresh, len(start)), pa.int32())
                    lists = [pa.ListArray.from_arrays(bounds, pa.array(x.view(np.int64), pa.int64())) for x in (start + low - before[text], a, b)]
                    owner = batch.column(0).take(pa.array(i + text[fresh]))
                    yield record(_SPANS, owner, np.full(len(fresh), n, np.int32), gram[fresh].view(np.int64), *lists)

    return map_batches(rows, one, _SPANS_DDL)


def _judge_by_join(keyed: DataFrame, items: DataFrame) -> DataFrame:
    """row and the same result of staged documents (row, doc_id, text); both sides' fingerprints and spans are shuffled and joined."""
    own = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("row"), "text")

    def sizes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        _, before = _all_word_hashes(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(before[1:] - before[:-1], SPAN))], names=["n"])

    # At most 13 sizes reach the driver.
    known = sorted(r["n"] for r in map_batches(own.select("text"), sizes, "n long").where("n > 0").distinct().collect())
    window = ["size", "a", "b"]
    unpack = F.explode(F.arrays_zip("starts", "a", "b")).alias("w")
    theirs = _span_rows(own, known, True).select("row", "size", "gram", unpack).select(F.col("row").alias("item"), "size", "gram", "w.a", "w.b")
    theirs = stage(theirs.distinct(), "decon-items")
    # A window's set of items is named by sums over the items; one window of each set stands for its items.
    sums = [F.count("*").alias("k"), F.sum(F.xxhash64("item").cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64("item", F.lit(1)).cast("decimal(38,0)")).alias("y")]
    sets = theirs.groupBy(*window).agg(*sums).withColumn("set", F.sha2(F.concat_ws(",", "k", "x", "y"), 256)).select(*window, "set")
    sets = stage(sets, "decon-sets")
    members = sets.groupBy("set").agg(F.min(F.struct(*window)).alias("w")).select("set", *(F.col(f"w.{c}").alias(c) for c in window))
    members = members.join(theirs.select(*window, "item").distinct(), window).select("set", "item")
    ours = _span_rows(keyed.select("row", "text"), known, False)
    met = salted(ours, theirs.select("size", "gram").distinct(), ["size", "gram"], "left_semi")
    spans = met.select("row", "size", unpack).select("row", "size", F.col("w.starts").alias("start"), "w.a", "w.b")
    found = stage(salted(spans, sets, window).select("row", "start", "size", "set"), "decon-hits")
    named = salted(found.select("row", "set").distinct(), members, ["set"]).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    places = found.groupBy("row").agg(F.collect_set(F.struct("start", "size")).alias("hits"))

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts = [np.zeros(0, np.int64)]
        for _, _, _, before in _word_slices(*buffers(batch.column(2))):
            parts.append(before[1:] - before[:-1])
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.concatenate(parts))], names=["row", "doc_id", "n_words"])

    sized = map_batches(keyed.select("row", "doc_id", "text"), count, "row string, doc_id long, n_words long")
    rows = sized.join(places, "row", "left").join(named, "row", "left")

    def total(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n_words, n_hit = batch.column(2).to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, np.int64)
        for k, found_ in enumerate(batch.column(3)):
            if found_.is_valid:
                start, size = (x.to_numpy() for x in found_.values.flatten())
                n_hit[k] = covered(int(n_words[k]), start, start + size).sum()
        ids = [x or [] for x in batch.column(4).to_pylist()]
        result = record(_OUT, batch.column(1), n_words, n_hit, [len(x) for x in ids], [items_digest(x) for x in ids], contaminated(n_words, n_hit))
        yield pa.RecordBatch.from_arrays([batch.column(0), *result.columns], names=["row", *_OUT.names])

    return map_batches(rows.select("row", "doc_id", "n_words", "hits", "items"), total, f"row string, {_DDL}")


def _small_items(benchmark: DataFrame, item_bytes: int) -> Items | None:
    """The compiled items; None if they have more bytes than may be sent."""
    size = benchmark.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16), F.lit(0)).alias("n")).first()["n"]
    if size > item_bytes:
        return None
    rows = benchmark.select("item_id", "text").collect()
    return Items([r["item_id"] for r in rows], [r["text"] for r in rows])


def decontaminate(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document.

    Defined results: a null or wordless text has no words and no hits; items without
    id or words are ignored; rows with equal item_id are one item; repeated documents
    are judged each; either table may be empty; extra columns are ignored.
    """
    items = _small_items(benchmark, item_bytes)
    if items is not None:
        return _judge(docs, items)
    keyed = stage(docs.select(F.expr("uuid()").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "decon-docs")
    return _judge_by_join(keyed, benchmark).drop("row")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Documents that are not contaminated; rows pass through unless the items are too large to send.

    Defined results: null, empty and wordless texts stay; each row is judged by its own text, whatever its id (null and
    repeated ones too) and however large the items are; without items all rows stay; extra columns pass through.
    """
    items = _small_items(benchmark, item_bytes)
    if items is None:
        row = "row" + "_" * max(map(len, docs.columns))  # no column of the table has this name
        keyed = stage(docs.withColumn(row, F.expr("uuid()")), "decon-rows")
        judged = _judge_by_join(keyed.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
        return keyed.join(judged.where("contaminated").select(F.col("row").alias(row)), row, "left_anti").select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def keep(texts: pa.Array) -> np.ndarray:
        n_words, n_hit, _ = judge(texts, shared.value)
        return ~contaminated(n_words, n_hit)

    return filter_batches(docs, "text", keep)
