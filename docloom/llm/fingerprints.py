"""Document fingerprints by winnowing, with DataFrame functions only.

A text's k-grams are its runs of ``GRAM`` code points. Their Karp-Rabin hashes are
rolled together: the hash of 2, 4 and 8 code points follows from two hashes of half as
many. Of each ``WINDOW`` consecutive hashes the smallest is kept, the rightmost of
equal ones, with its place; a text of fewer hashes is one window, a text of fewer than
``GRAM`` code points is one gram. Two texts that share ``GRAM + WINDOW - 1`` code points
in a row keep the same hash at the same place of that run.

A kept gram is one long: hash · 2³² + (2³¹ - 1 - place), so that the smallest of some
longs is the smallest hash and, of equal ones, the rightmost. Texts are worked on in
blocks, so the arrays of a pass stay small however long a text is; a text's kept grams
take about one long for each 8 code points.

Neighbours in the order of the ids come from ranges of ids, each a window of its own.
The first row of each range is sent to the range that ends before it as well, so that
no window needs another one and texts are shuffled once.

Odd input: a null text is empty and keeps nothing; two empty fingerprints are alike (1).
A null id comes after all others. Rows of one id follow each other by a hash of their
text, then by their text. An empty table gives an empty result. The columns are read by
name; others are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM, WINDOW = 8, 16
SPAN = GRAM + WINDOW - 1
#: A prime below 2³¹ and a base: products of two remainders fit a long.
PRIME, BASE = 2**31 - 1, 1_000_003
LAST = 2**31 - 1
#: Code points of a text that are worked on at once.
BLOCK = 16_384
#: Rows of a range of ids, about; ranges at most, their edges are one array.
RANGE_ROWS, MOST_RANGES = 64, 1 << 18
#: Ranges of a task at most, on average: hashing their texts is work, whatever their bytes.
TASK_RANGES = 32
#: Edited texts of at most so many code points are fingerprinted as a whole.
DIRECT = 4 * SPAN


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _shifted(values: Column, by: int, join: Callable[[Column, Column], Column]) -> Column:
    """join(values[i], values[i + by]) for each i; beyond the end values[i + by] is null."""
    return F.zip_with(values, F.slice(values, F.lit(by + 1), F.size(values)), join)


def _rolled(codes: Column) -> Column:
    """Hash of each run of GRAM codes, null where the text ends: of two runs of half the length, the first one times a power of the base and the second."""

    def double(values: Column, length: int) -> Column:
        if length == GRAM:
            return values
        power = pow(BASE, length, PRIME)
        return bind(_shifted(values, length, lambda a, b: (a * F.lit(power) + b) % F.lit(PRIME)), lambda x: double(x, 2 * length))

    return double(codes, 1)


def _minima(keys: Column) -> Column:
    """The smallest of each WINDOW keys in a row, by windows of 2, 4, 8 …; the last GRAM - 1 keys are null."""

    def double(values: Column, length: int) -> Column:
        if length == WINDOW:
            return F.slice(values, F.lit(1), F.size(values) - (SPAN - 1))
        return bind(_shifted(values, length, lambda a, b: F.least(a, b)), lambda x: double(x, 2 * length))

    return double(keys, 1)


def _block(text: Column, start: Column) -> Column:
    """Minima of the windows of a part of a text that begins at ``start``: code points, hashes, keys with places, minima."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    whole = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda h, x: (h * F.lit(BASE) + x) % F.lit(PRIME))
    hashes = bind(codes, lambda c: F.when(F.size(c) < GRAM, F.array(whole(c))).otherwise(_rolled(c)))
    first = (F.lit(LAST) - start).cast("long")
    places = lambda hs: F.sequence(first, first - F.size(hs) + 1, F.lit(-1).cast("long"))
    keys = bind(hashes, lambda hs: F.zip_with(hs, places(hs), lambda h, p: F.shiftleft(h, 32).bitwiseOR(p)))
    return bind(keys, lambda ks: F.when(F.size(ks) < SPAN, F.array(F.array_min(ks))).otherwise(_minima(ks)))


def kept(text: Column) -> Column:
    """The kept grams of a text (array of longs) in the order of their places."""

    def parts(t: Column, size: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(size - SPAN, F.lit(0)), F.lit(BLOCK))
        return F.flatten(F.transform(starts, lambda s: F.array_distinct(_block(F.substring(t, s + 1, F.lit(BLOCK + SPAN - 1)), s))))

    found = bind(F.char_length(text), lambda size: F.when(size <= BLOCK, _block(text, F.lit(0))).otherwise(parts(text, size)))
    return F.when(F.char_length(text) > 0, F.array_distinct(found)).otherwise(F.array().cast("array<bigint>"))


def place(key: Column) -> Column:
    return F.lit(LAST) - key.bitwiseAND(F.lit(LAST)).cast("int")


def hash_of(key: Column) -> Column:
    return F.shiftright(key, 32)


def hashes_of(keys: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(keys, hash_of))


def likeness(a: Column, b: Column) -> Column:
    """Share of the distinct hashes of two fingerprints that both have (Jaccard); two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b)
    return F.when(either == 0, 1.0).otherwise(bind(both, lambda n: n / (either - n)))


def as_text(keys: Column) -> Column:
    """A fingerprint as text: for each kept gram, in hex, (places since the last one) · 2³¹ + hash, joined by commas."""

    before = F.concat(F.array(F.lit(LAST).cast("long")), F.slice(keys, F.lit(1), F.size(keys) - 1))
    entry = lambda k, last: F.hex(F.shiftleft((place(k) - place(last)).cast("long"), 31).bitwiseOR(hash_of(k)))
    return F.when(F.size(keys) == 0, "").otherwise(F.array_join(F.zip_with(keys, before, entry), ","))


def joined(first: Column, first_keys: Column, cut: Column, second: Column, second_keys: Column, taken: Column) -> Column:
    """Kept grams of first[:cut] + second[:taken] from those of both texts: only the windows at the seam and at the end are computed."""
    text = F.concat(F.substring(first, F.lit(1), cut), F.substring(second, F.lit(1), taken))
    moved = lambda keys, by: F.transform(keys, lambda k: k - by)  # noqa: E731 (a later place is a smaller key)
    at = lambda keys, low, high: F.filter(keys, lambda k: place(k).between(low, high))

    def seam(t: Column, size: Column) -> Column:
        inner = at(first_keys, F.lit(0), cut - SPAN)
        low, high = cut - SPAN - WINDOW + 2, F.least(size, cut + 2 * WINDOW + GRAM - 3)
        middle = at(moved(kept(F.substring(t, low + 1, high - low)), low), cut - SPAN + 1, cut + WINDOW - 2)
        outer = moved(at(second_keys, F.lit(WINDOW - 1), taken - SPAN), cut)
        begin = F.greatest(size - SPAN + 1, cut + WINDOW - 1)
        end = at(moved(kept(F.substring(t, begin - WINDOW + 2, F.lit(2 * SPAN))), begin - WINDOW + 1), begin, size)
        return F.concat(inner, middle, outer, F.when(taken >= SPAN, end).otherwise(F.array().cast("array<bigint>")))

    return bind(text, lambda t: bind(F.char_length(t), lambda size: F.when(size <= DIRECT, kept(t)).otherwise(seam(t, size))))


def _edges(docs: DataFrame, key: Column) -> list[int]:
    """Ids at which ranges end, ascending; the last one is the largest id."""
    facts = docs.agg(F.count(key).alias("n"), F.max(key).alias("last")).first()
    if not facts["n"]:
        return []
    ranges = min(MOST_RANGES, -(-facts["n"] // RANGE_ROWS))
    shares = [i / ranges for i in range(1, ranges)]
    inner = docs.agg(F.percentile_approx(key, shares, max(10_000, 4 * ranges)).alias("e")).first()["e"] if shares else []
    return sorted({*inner, facts["last"]})


def with_next(docs: DataFrame, add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, text, columns of ``add``, and next_ each of them of the next row by descending id; after the last one comes the first).

    ``add`` puts columns to rows with text once they are where they are compared.
    """
    number = F.col("doc_id").cast("long")
    edges = _edges(docs, F.coalesce(number, F.lit(-(2**63))))
    step = max(1, int(len(edges) ** 0.5))
    spark = docs.sparkSession
    known = spark.createDataFrame([(edges[::step], [edges[i : i + step] for i in range(0, len(edges), step)], len(edges))], "tops array<long>, lists array<array<long>>, ranges int")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(number, F.lit(-(2**63))).alias("key"))
    below = lambda list_: F.size(F.filter(list_, lambda e: e < F.col("key")))
    top = F.greatest(below(F.col("tops")) - 1, F.lit(0))
    ranged = rows.crossJoin(F.broadcast(known)).withColumn("top", top).withColumn("list", F.get("lists", F.col("top")))
    ranged = ranged.withColumn("range", F.col("top") * step + below(F.col("list")))
    # The last id of a range is the next one of the lowest id of the range above it.
    ends = F.array_contains("list", F.col("key")) | F.array_contains("tops", F.col("key"))
    copy = F.struct(F.lit(True).alias("copy"), F.pmod(F.col("range") + 1, F.col("ranges")).alias("range"))
    own = F.struct(F.lit(False).alias("copy"), F.col("range"))
    dealt = ranged.select("doc_id", "text", "key", F.explode(F.when(ends, F.array(own, copy)).otherwise(F.array(own))).alias("to")).select("doc_id", "text", "key", "to.*")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(edges) // TASK_RANGES)
    made = add(dealt.repartition(parts, "range"))
    held = [c for c in made.columns if c not in ("doc_id", "key", "copy", "range")]
    order = Window.partitionBy("range").orderBy("copy", F.desc("key"), F.col("doc_id").isNull(), F.xxhash64("text"), "text")
    return made.withColumns({f"next_{c}": F.lead(c).over(order) for c in held}).where("not copy").drop("key", "copy", "range")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text, kept: its kept grams) of every row, without a shuffle."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("kept", kept(F.col("text")))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_chars, kept, edited, edited_kept, near_edited, near_next) of every row.

    ``edited``: the text whose last third (rounded down) is replaced by the beginning of the next row's text.
    """
    pairs = with_next(docs, lambda rows: rows.withColumn("kept", kept(F.col("text"))).withColumn("hashes", hashes_of(F.col("kept"))))
    pairs = pairs.withColumn("n_chars", F.char_length("text")).withColumn("third", F.floor(F.col("n_chars") / 3).cast("int"))
    pairs = pairs.withColumn("cut", F.col("n_chars") - F.col("third")).withColumn("taken", F.least(F.col("third"), F.char_length("next_text")))
    keys = joined(F.col("text"), F.col("kept"), F.col("cut"), F.col("next_text"), F.col("next_kept"), F.col("taken"))
    edited = F.concat(F.expr("substring(text, 1, cut)"), F.expr("substring(next_text, 1, taken)"))
    near_next = likeness(F.col("hashes"), F.col("next_hashes"))
    pairs = pairs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"), "kept", "hashes", edited.alias("edited"), keys.alias("edited_kept"), near_next.alias("near_next"))
    pairs = pairs.withColumn("edited_hashes", hashes_of(F.col("edited_kept")))
    return pairs.withColumn("near_edited", likeness(F.col("hashes"), F.col("edited_hashes"))).drop("hashes", "edited_hashes")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    found = edited_fingerprints(docs)
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), as_text(F.col("kept")).alias("fingerprint"),
        as_text(F.col("edited_kept")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
