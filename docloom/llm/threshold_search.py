"""Ranked lexical search by Fagin's threshold algorithm.

One pass over the texts writes a forward index: each document's number of words, and
the places and counts of the query terms that it holds. The statistics N, L and df are
sums over it. Then each task takes its documents in shards. A shard's postings are
sorted into one list a term, the highest impact first. For an item, the lists of its
terms are read in turns, a few postings of each at a time; every document that comes
up for the first time is looked up in the forward index and scored as a whole. A
document that has not come up is worth at most the sum of the impacts at which the
lists stand: as soon as this threshold is strictly below the k-th score, the shard is
done for the item. A task carries its k best from shard to shard, so later shards stop
earlier. The tasks' best meet in one more selection. All results are exact: nothing is
cut but what the threshold rules out, and documents of equal score stay in.

The items' terms are gathered in blocks of about ``BLOCK_TERMS`` pairs of item and term
(an item stays whole), and each block meets all documents.

Odd input: a null text has no terms, as an empty one. Rows of one item_id are one item
with the terms of all of them; a null item_id is an item like another. Each row of the
documents is a document, so repeated rows rank each; null doc_ids come after others of
equal score, equal ones in any order. Empty tables give an empty result. Columns are
read by name, others are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.llm.plumbing import discard, lean, map_batches, prepare, record, stage
from docloom.llm.textcore import between_words, buffers, encode_spans, lower_ascii, runs, slices

TOP = 10
#: Pairs of item and term of a block of items, about.
BLOCK_TERMS = 1_000_000
#: Postings of a shard, about.
SHARD_POSTINGS = 2_000_000
#: Postings of each list that the first turn reads; each turn reads as many again as there were.
FIRST_TURN = 16
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[97:123] = _TERM[128:] = True


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of each word, words before each text, the distinct words)."""
    low = lower_ascii(data)
    starts, ends, before = runs(_TERM[low], offsets)
    codes, distinct = encode_spans(low, starts, ends)
    return codes, before, distinct


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""
    kind = to_arrow_type(items.schema["item_id"].dataType)
    out = pa.schema([("item_id", kind), ("term", pa.binary())])

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = buffers(batch.column(1))
        for i, _, part, edges in slices(data, offsets, cut=between_words):
            codes, before, distinct = _terms(part, edges)
            row = i + np.searchsorted(before, np.arange(len(codes)), "right") - 1
            pair = np.unique(row * max(1, len(distinct)) + codes)
            yield record(out, batch.column(0).take(pa.array(pair // max(1, len(distinct)))), distinct.take(pa.array(pair % max(1, len(distinct)))))

    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, term binary"
    return map_batches(items.select("item_id", F.col("text").cast("string").alias("text")), one, schema).distinct()


def forward_index(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, words, terms, counts): each document's words, and the places in ``terms`` (sorted) and counts of those that it holds."""
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    out = pa.schema([("doc_id", kind), ("words", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def held(part: np.ndarray, edges: np.ndarray, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text; text, term and count of each pair)."""
        codes, before, distinct = _terms(part, edges)
        place = pc.index_in(distinct, known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        own = place[codes] if len(codes) else np.zeros(0, np.int64)
        row = np.searchsorted(before, np.arange(len(codes)), "right") - 1
        pair, count = np.unique(row[own >= 0] * max(1, len(known)) + own[own >= 0], return_counts=True)
        return np.diff(before), pair // max(1, len(known)), pair % max(1, len(known)), count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.binary())
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = buffers(batch.column(1))
            n = batch.num_rows
            words, pairs, counts = np.zeros(n, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j, part, edges in slices(data, offsets, cut=between_words):
                size, row, term, count = held(part, edges, known)
                words[i:j] += size
                pairs.append((row + i) * max(1, len(known)) + term)
                counts.append(count)
            # Parts of one text may hold the same term.
            pair, at = np.unique(np.concatenate(pairs), return_inverse=True)
            count = np.bincount(at, np.concatenate(counts), len(pair)).astype(np.int64)
            bounds = np.searchsorted(pair, np.arange(n + 1) * max(1, len(known))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(v)) for v in ((pair % max(1, len(known))).astype(np.int32), count)]
            yield record(out, batch.column(0), words, *lists)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, words long, terms array<int>, counts array<long>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), schema)


class Shard:
    """Postings of some documents: the forward index, and one list a term with the highest impact first."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray, m: np.ndarray):
        self.bounds, self.terms = bounds, terms
        doc = np.repeat(np.arange(len(words)), np.diff(bounds))
        self.impact = weight[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m[doc]))
        order = np.lexsort((-self.impact, terms))
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.list_at = np.searchsorted(terms[order], np.arange(len(weight) + 1))

    def look_up(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Whole scores of some documents from the forward index; wanted: whether each term is the item's."""
        size = self.bounds[docs + 1] - self.bounds[docs]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.bounds[docs] - (ends - size), size)
        total = np.concatenate([[0], np.cumsum(self.impact[at] * wanted[self.terms[at]])])
        return total[ends] - total[ends - size]

    def search(self, item: np.ndarray, wanted: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): all that can be among the k best with a score of ``least`` or more, and no more than came up."""
        low, high = self.list_at[item], self.list_at[item + 1]
        seen = np.zeros(len(self.bounds) - 1, bool)
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, turn = 0, FIRST_TURN
        while True:
            begin, end = np.minimum(low + depth, high), np.minimum(low + depth + turn, high)
            size = end - begin
            at = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
            new = np.unique(self.list_doc[at])
            new = new[~seen[new]]
            seen[new] = True
            score = self.look_up(new, wanted)
            found, scores = np.concatenate([found, new]), np.concatenate([scores, score])
            bar = least
            if len(scores) >= k:
                bar = max(bar, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            keep = scores >= max(bar, 1)
            found, scores = found[keep], scores[keep]
            depth, turn = depth + turn, depth + turn
            open_ = low + depth < high
            # What a list still holds is worth no more than its next posting.
            threshold = int(self.list_impact[(low + depth)[open_]].sum())
            if not open_.any() or threshold < bar:
                return found, scores


def _best(names: pa.Array, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id, nulls last."""
    order = pc.sort_indices(pa.table({"s": pa.array(scores), "id": names}), [("s", "descending"), ("id", "ascending")], null_placement="at_end")
    return order.to_numpy()[:k]


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of the highest score above 0; equal scores by ascending id."""
    terms = stage(item_terms(items), "search-terms")
    blocks = -(-terms.count() // block_terms)
    found = []
    for number in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number)
        found.append(_search_block(docs, own.toArrow(), items.schema["item_id"].dataType.simpleString(), k))
    discard(terms)
    if found:
        return reduce(DataFrame.unionByName, found)
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((items, "item_id"), (docs, "doc_id"))]
    return items.sparkSession.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")


def _search_block(docs: DataFrame, pairs: pa.Table, item_kind: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    known = pc.unique(pairs["term"]).sort()
    ids = pc.unique(pairs["item_id"])
    at = pc.index_in(pairs["item_id"], ids).combine_chunks().to_numpy()
    term = pc.index_in(pairs["term"], known).combine_chunks().to_numpy()
    order = np.lexsort((term, at))
    split = np.searchsorted(at[order], np.arange(len(ids) + 1))
    lists = [term[order][a:b].astype(np.int64) for a, b in zip(split[:-1], split[1:], strict=True)]

    index = stage(forward_index(docs, known.to_pylist()), "search-forward")
    facts = index.agg(F.count_if(F.col("words") > 0).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    n, words = facts["n"], facts["words"]
    df = np.zeros(len(known), np.int64)
    held = index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()
    df[held["t"].to_numpy()] = held["df"].to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    shared = spark.sparkContext.broadcast((ids, lists, weight))
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    out = pa.schema([("item", pa.int64()), ("doc_id", kind), ("score", pa.int64())])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        some, size = [], 0
        for batch in batches:
            some.append(batch)
            size += len(batch.column(2).flatten()) + batch.num_rows
            if size >= SHARD_POSTINGS:
                yield pa.Table.from_batches(some)
                some, size = [], 0
        if some:
            yield pa.Table.from_batches(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, lists, weight = shared.value
        best = [(pa.array([], kind), np.zeros(0, np.int64))] * len(lists)
        wanted = np.zeros(len(weight), bool)
        for shard in shards(batches):
            shard = shard.combine_chunks()
            names, n_words, terms, counts = (shard.column(c).combine_chunks() for c in range(4))
            size = n_words.to_numpy()
            bounds = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())])
            part = Shard(size, bounds, terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy(), weight, 10 + (90 * size * n) // max(1, words))
            for i, own in enumerate(lists):
                mine, scores = best[i]
                least = int(scores[-1]) if len(scores) >= k else 0
                wanted[own] = True
                docs_, more = part.search(own, wanted, least, k)
                wanted[own] = False
                if len(docs_):
                    all_names = pa.concat_arrays([mine, pc.cast(names.take(pa.array(docs_)), kind)])
                    all_scores = np.concatenate([scores, more])
                    first = _best(all_names, all_scores, k)
                    best[i] = all_names.take(pa.array(first)), all_scores[first]
        for i, (mine, scores) in enumerate(best):
            if len(scores):
                yield record(out, np.full(len(scores), i), mine, scores)

    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    near = index.mapInArrow(lean(run), f"item long, doc_id {doc_kind}, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = stage(near.withColumn("rank", rank).where(F.col("rank") <= k), "search-top")
    discard(index)
    names = spark.createDataFrame(list(enumerate(ids.to_pylist())), f"item long, item_id {item_kind}")
    return top.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
