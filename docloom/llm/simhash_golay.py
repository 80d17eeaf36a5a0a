"""SimHash near-duplicates with Golay-code fuzzy hashing.

Fingerprints link at ``DISTANCE`` = 3 or fewer differing bits. The 64 bits are cut
into three segments of 22, 21 and 21 bits, each read as a (shortened) word of the
perfect binary Golay code [23, 12, 7]: a word lies within 3 bits of exactly one
codeword, whose 12-bit index is its *home*; the homes of the word and of its one-bit
neighbours are its *near* indices (one to six). Words one bit apart have each other's
home among their near indices.

Of 3 errors over three segments, two segments always have at most one error each
(pigeonhole). So for each pair of segments (a, b) a fingerprint is filed under
near(a) × home(b) and home(a) × near(b): linked fingerprints share a key of some
pair. A key has 24 bits, so distinct fingerprints rarely meet by chance. Each key's
members are compared exactly; a member set gives a spanning forest, never all pairs.
Keys with more than ``BLOCK`` members are cut into blocks, and pairs of blocks are
compared in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docloom.llm.graph import connected_components, join_low, local_components
from docloom.llm.plumbing import lean, map_batches, prepare, record, row_keys, stage
from docloom.llm.textcore import buffers, lower_ascii, runs, slices

SHINGLE = 3
SEED = 42
DISTANCE = 3
BLOCK = 2048
SEGMENTS = (22, 21, 21)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LANES = np.uint64(0x0101010101010101)


def _majority(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Bits set in over half of hashes[before[i]:before[i+1]], for each i."""
    n = len(before) - 1
    out = np.zeros(n, np.uint64)
    size = before[1:] - before[:-1]
    full = np.flatnonzero(size)
    if not len(full):
        return out
    # Byte lanes count at most 255 rows, so sums run over pieces of that many.
    many = -(-size[full] // 255)
    first = np.repeat(before[full] - 255 * (np.cumsum(many) - many), many) + 255 * np.arange(many.sum())
    owner = np.concatenate([[0], np.cumsum(many)[:-1]])
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, first)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), owner, axis=0)
        for lane in range(8):
            out[full] |= (2 * sums[:, lane] > size[full]).astype(np.uint64) << np.uint64(8 * lane + bit)
    return out


#: Shingles hashed at once: bounds the working arrays, however long a text is.
SHINGLES_AT_ONCE = 300_000


def _hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """XXH64 of the words first[i] … last[i], space-joined; the words are the byte spans of ``low``."""
    a, b = int(first[0]), int(last[-1]) + 1
    starts, ends, first, last = starts[a:b], ends[a:b], first - a, last - a
    # One blank between words: only then is a shingle a stretch of bytes.
    lengths = ends - starts
    packed = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
    to = np.cumsum(lengths + 1) - lengths - 1
    begin = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum()))
    packed[at + np.repeat(to - begin, lengths)] = low[at + np.repeat(starts - begin, lengths)]
    raw, h = packed.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((h(raw[s:e], SEED) for s, e in zip(to[first].tolist(), (to[last] + lengths[last]).tolist(), strict=True)), np.uint64, len(first))


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text; no words: zero."""
    low = lower_ascii(data)
    starts, ends, before = runs(~_SPACE[low], offsets)
    words = before[1:] - before[:-1]
    shingles = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    begin = np.cumsum(shingles) - shingles
    first = np.arange(int(shingles.sum())) + np.repeat(before[:-1] - begin, shingles)
    last = first + np.repeat(np.minimum(words, shingle), shingles) - 1
    parts = [_hashes(low, starts, ends, first[i : i + SHINGLES_AT_ONCE], last[i : i + SHINGLES_AT_ONCE]) for i in range(0, len(first), SHINGLES_AT_ONCE)]
    return _majority(np.concatenate([np.zeros(0, np.uint64), *parts]), np.append(begin, shingles.sum()))


_FINGER = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def document_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = buffers(batch.column(1))
        fps = [fingerprints(chunk, at, shingle) for _, _, chunk, at in slices(data, offsets)]
        yield record(_FINGER, batch.column(0), np.concatenate(fps).view(np.int64))

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), one, "doc_id long, fp long")


@lru_cache(1)
def golay_home() -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    poly = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, twelve bits wide

    def rest(word: int) -> int:
        for k in range(22, 10, -1):
            if word >> k & 1:
                word ^= poly << (k - 11)
        return word

    one = [rest(1 << k) for k in range(23)]
    error = np.zeros(2048, np.int64)
    for a in range(23):
        error[one[a]] = 1 << a
        for b in range(a):
            error[one[a] ^ one[b]] = 1 << a | 1 << b
            for c in range(b):
                error[one[a] ^ one[b] ^ one[c]] = 1 << a | 1 << b | 1 << c
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for k in range(12):
        low[np.arange(1 << 12) >> k & 1 == 1] ^= one[k]
    for k in range(11):
        high[np.arange(1 << 11) >> k & 1 == 1] ^= one[12 + k]
    home, tail = np.empty((1 << 11, 1 << 12), np.uint16), np.arange(1 << 12)
    for head, own in enumerate(high):  # row by row: all words at once would need 200 MB
        home[head] = ((head << 12 | tail) ^ error[own ^ low]) >> 11
    return home.ravel()


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each key that each fingerprint is filed under."""
    home, bits = golay_home(), fps.view(np.uint64)
    own, near, shift = [], [], 0
    for width in SEGMENTS:
        word = (bits >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)
        shift += width
        own.append(home[word].astype(np.int64))
        wide = np.stack([home[word], *(home[word ^ (1 << k)] for k in range(width))], axis=1)
        wide.sort(axis=1)
        fresh = np.ones(wide.shape, bool)
        fresh[:, 1:] = wide[:, 1:] != wide[:, :-1]
        near.append((np.nonzero(fresh)[0], wide[fresh].astype(np.int64)))
    rows, keys = [], []
    for p, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        r, k = near[a]
        rows.append(r)
        keys.append(p << 24 | k << 12 | own[b][r])
        r, k = near[b]
        other = k != own[b][r]  # home × home is there already
        rows.append(r[other])
        keys.append(p << 24 | own[a][r[other]] << 12 | k[other])
    return np.concatenate(rows), np.concatenate(keys)


def key_table(fps: DataFrame) -> DataFrame:
    """(key, fp) rows of a table of distinct fingerprints."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        rows, keys = fuzzy_keys(np.ascontiguousarray(fp))
        yield record(schema, keys, fp[rows])

    return map_batches(fps.select("fp"), one, "key long, fp long")


def _forest(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (node, root) of the links inside each run of equal ``group``."""
    n, bits = len(fp), fp.view(np.uint64)
    end = np.searchsorted(group, group, "right")
    alive = np.arange(n)
    us, vs, held, step = [], [], 0, 0
    while True:
        step += 1
        alive = alive[alive + step < end[alive]]
        if not len(alive):
            break
        hit = alive[np.bitwise_count(bits[alive] ^ bits[alive + step]) <= distance]
        us.append(hit)
        vs.append(hit + step)
        held += len(hit)
        if held > 2_000_000:
            label = local_components(n, np.concatenate(us), np.concatenate(vs))
            us = [np.flatnonzero(label != np.arange(n))]
            vs, held = [label[us[0]]], len(us[0])
    label = local_components(n, np.concatenate(us or [alive]), np.concatenate(vs or [alive]))
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that join all fingerprints linked within a key; each key gives a forest."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    keys = key_table(fps)
    large = keys.groupBy("key").count().where(F.col("count") > 2 * block).select("key", F.ceil(F.col("count") / block).cast("long").alias("blocks"))
    placed = keys.join(large, "key", "left").withColumn("own", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("fp"), "blocks")))
    other = F.explode_outer(F.when(F.col("blocks").isNotNull(), F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("key", "fp", "own", other.alias("other")).select(
        "key", "fp", F.coalesce(F.least("own", "other"), F.lit(0)).alias("a"), F.coalesce(F.greatest("own", "other"), F.lit(0)).alias("b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(rows: list[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
            key, fp, a, b = (np.concatenate([r.column(i).to_numpy(zero_copy_only=False) for r in rows]) for i in range(4))
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            group = np.cumsum(fresh)
            cut = len(key) if last else int(np.searchsorted(group, group[-1]))
            if cut:
                u, v = _forest(group[:cut], fp[:cut], distance)
                if len(u):
                    yield record(schema, u, v)
            held[:] = [] if cut == len(key) else [pa.RecordBatch.from_arrays([pa.array(x[cut:]) for x in (key, fp, a, b)], names=["key", "fp", "a", "b"])]

        for batch in batches:
            held.append(batch)
            if sum(len(r) for r in held) >= 100_000:
                yield from work(held, False)
        if sum(len(r) for r in held):
            yield from work(held, True)

    prepare(fps.sparkSession)
    return placed.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(lean(run), "u long, v long").distinct()


def _rooted(low: DataFrame, distance: int, block: int) -> DataFrame:
    """Add root, the component's smallest fingerprint, to a staged table of distinct fingerprints (fp, low)."""
    roots = connected_components(links(low, distance, block), "simhash-links")
    return low.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest reachable doc_id).

    Defined results: null and empty texts have fingerprint zero and link like any
    other; repeated rows are returned each; null ids stay and never are a component's
    id unless all its ids are null; an empty table gives no rows; extra columns are ignored.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError("the keys find links of at most 3 differing bits")
    rows = stage(document_fingerprints(docs, shingle), "fingerprints")
    low = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "fingerprint-set")
    rooted = stage(_rooted(low.select("fp", "low"), distance, block), "rooted")
    total = rooted.count()
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    named = join_low(rooted.select("fp", "root"), least, "root", total).select("fp", "component_id").join(low.select("fp", "n"), "fp")
    return join_low(rows, named, "fp", rows.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, scanned: bool = False) -> DataFrame:
    """Keep one row of each component: that of its smallest id, null ids last; of rows with that id, the first one.

    Rows are told apart by a key that is staged with them. ``scanned``: the caller knows that docs is a scan of files with
    nothing but filters and chosen columns on it, one row for each row of a file; then file and row are the key, and
    nothing is staged. Defined results: repeated and null ids neither save nor cost a text; null and empty
    texts are one another's copies; an empty table gives no rows; extra columns pass through.
    """
    pad = "_" * max(map(len, docs.columns))  # no column of the table has these names
    keyed = row_keys(docs) if scanned else None
    if keyed is None:
        keyed = stage(docs.withColumn(f"row{pad}", F.monotonically_increasing_id()), "near-dedup-rows")
    key = [c for c in keyed.columns if c not in docs.columns]
    narrow = keyed.select(*key, F.col("doc_id").cast("long").alias("doc_id"), "text")
    fields = [narrow.schema[c] for c in (*key, "doc_id")]
    schema = StructType([*fields, StructField("fp", LongType())])

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = [fingerprints(chunk, offsets) for _, _, chunk, offsets in slices(*buffers(batch.column(len(fields))))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(fps).view(np.int64))], names=schema.names)

    rows = stage(map_batches(narrow, one, schema), "fingerprinted")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), *key)
    low = stage(rows.groupBy("fp").agg(F.min(order).alias("low"), F.count("*").alias("n")), "fingerprint-set")
    rooted = _rooted(low.select("fp", "low"), DISTANCE, BLOCK)
    first = rooted.groupBy("root").agg(F.min("low").alias("low")).select(*(F.col("low")[k].alias(k) for k in key))
    # Those that go are fewer than those that stay.
    return keyed.join(rows.select(*key).join(first, key, "left_anti"), key, "left_anti").select(*docs.columns)
