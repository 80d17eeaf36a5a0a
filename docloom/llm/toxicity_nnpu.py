"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text is unlabelled, whatever
its label says. A linear classifier over the distinct words and word stems of a text is trained in
NumPy on the non-negative risk estimator

    prior · R_p(+1) + max(0, R_u(-1) - prior · R_p(-1)),

with logistic loss and an L1 proximal step: when the second term falls below zero,
its gradient is reversed, so the classifier cannot overfit by calling positives
negative. The class prior is the share of toxic labels among the learned labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from docloom.llm.langid_crf import words_of
from docloom.llm.plumbing import filter_batches, fit_in_task, hashed_sample, id_crc, map_batches, record, sample_hash
from docloom.llm.textcore import between_words, buffers, segment_sum, slices

#: Bounds of the training sample.
POSITIVES, UNLABELLED = 2000, 4000
ROUNDS, L1, DEFAULT_PRIOR, MIN_POSITIVES = 200, 7e-4, 0.1, 4
#: Only features at least this many times as frequent among positives as among unlabelled texts can have a weight.
ENRICHED = 1.5
#: Letters of the stems that count as features beside the word itself: inflected forms share them.
STEMS = (3, 4, 5, 6, 7)
THRESHOLD = 0.5


def _hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature hashes of the words one after another, bounds): each word and its stems."""
    keys = [k for w in words for k in (w, *(w[:n] + "*" for n in STEMS if n < len(w)))]
    size = np.fromiter((1 + sum(n < len(w) for n in STEMS) for w in words), np.int64, len(words))
    return np.fromiter((xxh64_intdigest(k.encode("utf-8", "surrogatepass")) >> 1 for k in keys), np.int64, len(keys)), np.concatenate([[0], np.cumsum(size)])


def _pairs(codes: np.ndarray, before: np.ndarray, feature: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct text × width + feature, for texts of words (codes) and words of features; features below 0 are left out."""
    text = np.repeat(np.arange(len(before) - 1), before[1:] - before[:-1])
    words = len(bounds) - 1
    once = np.unique(text * max(1, words) + codes)
    text, code = once // max(1, words), once % max(1, words)
    size = bounds[code + 1] - bounds[code]
    at = np.arange(size.sum()) + np.repeat(bounds[code] - (np.cumsum(size) - size), size)
    chosen, text = feature[at], np.repeat(text, size)
    return np.unique((text * width + chosen)[chosen >= 0])


def word_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's distinct features, bounds)."""
    codes, words, before = words_of(data, offsets)
    h, bounds = _hashed(words)
    known, merged = np.unique(h, return_inverse=True)
    width = max(1, len(known))
    pairs = _pairs(codes, before, merged, bounds, width)
    return known[pairs % width] if len(pairs) else known[:0], np.searchsorted(pairs, np.arange(len(offsets)) * width)


@dataclass
class Classifier:
    """Weights of the words that have one, by their 63-bit hashes in order."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def found(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sorted distinct text × words + place among the words with a weight."""
        codes, words, before = words_of(data, offsets)
        k = len(self.words)
        if not k or not len(codes):
            return np.zeros(0, np.int64)
        h, bounds = _hashed(words)
        at = np.minimum(np.searchsorted(self.words, h), k - 1)
        at[self.words[at] != h] = -1
        return _pairs(codes, before, at, bounds, k)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The score of each text; parts of a long text count a word once together."""
        n, k = len(texts), max(1, len(self.words))
        pairs = [np.zeros(0, np.int64)]
        for i, _, chunk, at in slices(*buffers(texts), cut=between_words):
            pairs.append(self.found(chunk, at) + i * k)
        once = np.unique(np.concatenate(pairs))
        z = self.bias + (np.bincount(once // k, self.weights[once % k], n) if len(once) else np.zeros(n))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _stack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(r) for r in rows], np.int64)
    return (np.concatenate(rows) if rows else np.zeros(0, np.int64)).astype(np.int64), np.concatenate([[0], np.cumsum(size)])


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Classifier:
    """Accelerated proximal gradient on the non-negative risk."""
    bias = float(np.log(prior / (1 - prior))) if 0 < prior < 1 else -2.0
    if not positive or not unlabelled:
        return Classifier(np.zeros(0, np.int64), np.zeros(0), bias)
    p, pb = _stack(positive)
    # A word needs some confirmed documents to have a weight at all.
    seen, many = np.unique(p, return_counts=True)
    u, ub = _stack(unlabelled)
    kinds, others = np.unique(u, return_counts=True)
    at = np.minimum(np.searchsorted(kinds, seen), len(kinds) - 1) if len(kinds) else np.zeros(len(seen), np.int64)
    among = np.where(kinds[at] == seen, others[at], 0) if len(kinds) else np.zeros(len(seen))
    used = seen[(many >= min(MIN_POSITIVES, len(positive))) & (many * len(unlabelled) > ENRICHED * among * len(positive))]
    if not len(used):
        return Classifier(np.zeros(0, np.int64), np.zeros(0), bias)

    def cut(x: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(used, x), len(used) - 1)
        keep = used[at] == x
        return at[keep], np.concatenate([[0], np.cumsum(keep)])[b]

    (px, pb), (ux, ub) = cut(p, pb), cut(u, ub)
    p_row, u_row = np.repeat(np.arange(len(pb) - 1), np.diff(pb)), np.repeat(np.arange(len(ub) - 1), np.diff(ub))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    w, b, n = np.zeros(len(used)), bias, len(used)
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for r in range(1, ROUNDS + 1):
        zp, zu = segment_sum(w[px], pb) + b, segment_sum(w[ux], ub) + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        sign = 1.0 if negative >= 0 else -1.0
        # d/dz of prior·log(1+e^-z) on positives, and of ±(log(1+e^z) on unlabelled − prior·log(1+e^z) on positives)
        dp = prior / len(zp) * ((-sigmoid(-zp) if sign > 0 else 0.0) - sign * sigmoid(zp))
        du = sign * sigmoid(zu) / len(zu)
        g = np.bincount(px, dp[p_row], n) + np.bincount(ux, du[u_row], n)
        gb = dp.sum() + du.sum()
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        mb, vb = mb + 0.1 * (gb - mb), vb + 0.01 * (gb * gb - vb)
        step = 0.1 / (np.sqrt(v / (1 - 0.99**r)) + 1e-6)
        w -= step * m / (1 - 0.9**r)
        w = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
        b -= 0.1 * mb / (1 - 0.9**r) / (np.sqrt(vb / (1 - 0.99**r)) + 1e-6)
    return Classifier(used[w != 0], w[w != 0], float(b))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifier:
    """Fit on bounded samples of documents whose id is not held out (crc32 of the id mod 5 is not 0)."""
    learned = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (id_crc() % 5 != 0))
    share = learned.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("p")).first()["p"]
    prior = min(0.9, max(1e-4, share)) if share is not None else DEFAULT_PRIOR
    texts = docs.where(F.col("text").isNotNull() & (id_crc() % 5 != 0)).select("doc_id", "text")
    # At most `positives` ids are sent.
    ids = hashed_sample(learned.where("toxic = 1").select("doc_id").distinct(), positives, F.col("doc_id"), "toxic")
    schema = pa.schema([("toxic", pa.bool_()), ("h", pa.int64()), ("words", pa.list_(pa.int64()))])

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
        for i, j, chunk, at in slices(*buffers(batch.column(2)), cut=between_words):
            words, bounds = word_sets(chunk, at)
            for k in range(i, j):
                sets[k].append(words[bounds[k - i] : bounds[k - i + 1]])
        yield record(schema, batch.column(0), batch.column(1), [np.unique(np.concatenate(s)) for s in sets])

    def fit_sample(rows: pa.Table) -> Classifier:
        toxic = np.asarray(rows["toxic"].combine_chunks().to_numpy(zero_copy_only=False), bool)
        sets = rows["words"].combine_chunks().to_numpy(zero_copy_only=False) if rows.num_rows else []
        # In an order of their own, so that the result is the same whatever the order of arrival.
        key = lambda x: (len(x), x.tobytes())
        return fit(*(sorted((np.asarray(x, np.int64) for x, y in zip(sets, toxic, strict=True) if y == side), key=key) for side in (True, False)), prior)

    def chosen(rows: DataFrame, toxic: bool, many: int, salt: str) -> DataFrame:
        rank, last = sample_hash(rows, many, F.struct("doc_id", "text"), salt)
        return rows.select(F.lit(toxic).alias("toxic"), rank.alias("h"), "text").where(F.col("h") <= F.lit(last))

    both = chosen(texts.join(F.broadcast(ids), "doc_id", "left_semi"), True, positives, "toxic").unionByName(chosen(texts, False, unlabelled, "unlabelled"))
    # Words are gathered where the rows are read; of copies one row goes on.
    sets = map_batches(both, one, "toxic boolean, h long, words array<long>").groupBy("toxic", "h").agg(F.first("words").alias("words"))
    return fit_in_task(sets.select("toxic", "words"), fit_sample)


def judge(model: Classifier, texts: pa.Array) -> np.ndarray:
    return model.scores(texts)


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of whole texts.

    Defined results: a null or empty text has the classifier's base score; without any
    toxic label every text has the prior; repeated rows are scored each; a document
    with several labels counts as toxic if one says so.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        score = judge(shared.value, batch.column(2))
        yield record(_OUT, batch.column(0), batch.column(1), score, (score >= THRESHOLD).astype(np.int32))

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_crc() % 5 == 0).alias("held_out"), "text")
    return map_batches(chosen, one, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents scored below the threshold; rows pass through, nothing is joined.

    Defined results: null and empty texts have the base score (and stay unless that is toxic); without any toxic label
    every document stays; repeated rows and rows without id are judged each by its text; extra columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return filter_batches(docs, "text", lambda texts: judge(shared.value, texts) < THRESHOLD)
