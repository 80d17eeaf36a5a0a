"""Language identification with a linear-chain conditional random field.

Each word is labelled with a language. A word's emission scores are sums of learned
weights of its features: affixes (first and last one to four bytes), character
n-grams (one to four bytes, with the word's edges) and the word itself as a lexicon
entry, all hashed to ``BUCKETS``. Transition weights between the labels of
neighbouring words are learned too. Training maximises the conditional likelihood by
forward-backward on sequences that are spliced from passages in different languages,
so that the transitions describe code-switched text. Prediction runs
forward-backward over every word of a text as one chain, however long: blocks of
``BLOCK`` words are reduced to transfer matrices, messages pass over the blocks, and
the words of all blocks are then finished side by side. The text's language has the
largest summed posterior.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.bpe import by_character
from docloom.llm.plumbing import filter_batches, fit_in_task, hash_edge, id_crc, map_batches, record
from docloom.llm.textcore import between_words, buffers, encode_spans, mix64, runs, segment_sum, slices

#: Training sample: documents, shared out among the languages, and windows of SEQUENCE words of each, drawn from its whole text.
TRAIN_DOCS, TRAIN_WINDOWS, SEQUENCE = 1500, 8, 48
BUCKETS = 1 << 18
BLOCK, RESCALE = 256, 8  # words of a block; steps after which messages are scaled
STEP = 8192  # words at once: bounds the feature arrays
SPLICE, ROUNDS, RATE, L2 = 0.4, 16, 0.2, 1e-5
UNKNOWN = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(code of each letter run, distinct runs in lower case, runs before each text)."""
    starts, ends, before = runs(by_character(data, letters()), offsets)
    codes, distinct = encode_spans(data, starts, ends)
    return codes, [w.decode("utf-8", "replace").lower() for w in distinct.to_pylist()], before


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, bounds): the feature buckets of each word."""
    data, offsets = buffers(pa.array(words, pa.string()))
    n = len(words)
    size = offsets[1:] - offsets[:-1]
    padded = np.zeros(int(size.sum()) + 2 * n, np.uint64)
    at = offsets[:-1] + 2 * np.arange(n)
    padded[np.arange(len(data)) + np.repeat(1 + 2 * np.arange(n), size)] = data
    padded[at], padded[at + size + 1] = 1, 2  # the word's edges
    word, out = np.repeat(np.arange(n), size + 2), []
    place = np.arange(len(padded)) - at[word]
    total = size + 2
    code = np.zeros(len(padded), np.uint64)
    for k in range(1, 5):  # n-grams
        code = code.copy()
        code[: len(padded) - k + 1] |= padded[k - 1 :] << np.uint64(8 * (k - 1))
        inside = np.flatnonzero(place + k <= total[word])
        out.append((word[inside], mix64(code[inside] << np.uint64(3) | np.uint64(k))))
        grams = code
        mine = np.flatnonzero(size >= k)  # affixes
        out.append((mine, mix64(grams[at[mine] + 1] << np.uint64(6) | np.uint64(8 + k))))
        out.append((mine, mix64(grams[at[mine] + 1 + size[mine] - k] << np.uint64(6) | np.uint64(16 + k))))
    whole = np.zeros(n, np.uint64)  # lexicon
    power = np.uint64(0x100000001B3) ** place.astype(np.uint64)
    np.add.at(whole, word, padded * power)
    out.append((np.arange(n), mix64(whole + np.uint64(5))))
    owner = np.concatenate([w for w, _ in out])
    order = np.argsort(owner, kind="stable")
    bucket = (np.concatenate([h for _, h in out]) % np.uint64(BUCKETS)).astype(np.int64)[order]
    return bucket, np.searchsorted(owner[order], np.arange(n + 1))


@dataclass
class Crf:
    labels: list[str]
    buckets: np.ndarray  # those that have weights, in order
    weights: np.ndarray  # (buckets, labels)
    transition: np.ndarray  # (labels, labels), from → to
    start: np.ndarray

    def __post_init__(self) -> None:
        self._row = None

    def emissions(self, words: list[str]) -> np.ndarray:
        if self._row is None:
            self._row = np.full(BUCKETS, len(self.buckets), np.int32)
            self._row[self.buckets] = np.arange(len(self.buckets))
            self._table = np.concatenate([self.weights, np.zeros((1, len(self.labels)), self.weights.dtype)])
        out = np.empty((len(words), len(self.labels)))
        for i in range(0, len(words), STEP):
            bucket, bounds = features(words[i : i + STEP])
            scale = 1 / np.sqrt(np.maximum(1, np.diff(bounds)))
            out[i : i + STEP] = segment_sum(self._table[self._row[bucket]], bounds) * scale[:, None]
        return out

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("labels", "buckets", "weights", "transition", "start")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._row = None


def posteriors(emission: np.ndarray, size: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over padded chains.

    emission: (chains, steps, labels) scores; size: words of each chain, longest chain
    first. Returns word posteriors, expected transition counts, summed log-likelihood
    normaliser.
    """
    chains, steps, _ = emission.shape
    top = emission.max(axis=2, keepdims=True)
    e, t = np.exp(emission - top), np.exp(transition - transition.max())
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.ones((chains, steps))
    live = [int((size > k).sum()) for k in range(steps)]
    now = np.exp(start) * e[:, 0]
    scale[:, 0] = now.sum(axis=1)
    alpha[:, 0] = now / scale[:, :1]
    for k in range(1, steps):
        m = live[k]
        now = (alpha[:m, k - 1] @ t) * e[:m, k]
        s = now.sum(axis=1)
        scale[:m, k] = s
        alpha[:m, k] = now / s[:, None]
    expected = np.zeros_like(t)
    for k in range(steps - 1, 0, -1):
        m = live[k]
        ahead = e[:m, k] * beta[:m, k] / scale[:m, k, None]
        expected += t * (alpha[:m, k - 1].T @ ahead)
        beta[:m, k - 1] = ahead @ t.T
    valid = np.arange(steps)[None] < size[:, None]
    norm = float((np.log(scale) * valid).sum() + (top[..., 0] * valid).sum() + (np.maximum(size - 1, 0)).sum() * transition.max())
    return alpha * beta * valid[..., None], expected, norm


def fit(texts: list[str], langs: list[str], seed: int = 7) -> Crf:
    """Train on labelled passages."""
    labels = sorted(set(langs))
    rng, n = np.random.default_rng(seed), len(labels)
    codes, words, before = words_of(*buffers(pa.array(texts, pa.string())))
    lang = np.array([labels.index(x) for x in langs], np.int64)
    chosen = [i for i in range(len(texts)) if before[i + 1] > before[i]]
    rows_x, rows_y = [], []
    for i in chosen:
        mine = codes[before[i] : before[i + 1]]
        for a in range(0, len(mine), SEQUENCE):
            x = mine[a : a + SEQUENCE]
            y = np.full(len(x), lang[i])
            if rng.random() < SPLICE and len(x) >= 8:
                j = chosen[rng.integers(len(chosen))]
                other = codes[before[j] : before[j + 1]]
                cut = int(rng.integers(2, len(x) - 2))
                more = other[: len(x) - cut]
                x, y = np.concatenate([x[:cut], more]), np.concatenate([y[:cut], np.full(len(more), lang[j])])
            rows_x.append(x)
            rows_y.append(y)
    model = Crf(labels, np.zeros(0, np.int64), np.zeros((0, n), np.float32), np.zeros((n, n)), np.zeros(n))
    if not rows_x:
        return model
    order = np.argsort([-len(x) for x in rows_x], kind="stable")
    size = np.array([len(rows_x[i]) for i in order])
    x, y = np.zeros((len(order), SEQUENCE), np.int64), np.zeros((len(order), SEQUENCE), np.int64)
    for r, i in enumerate(order):
        x[r, : size[r]], y[r, : size[r]] = rows_x[i], rows_y[i]
    valid = np.arange(SEQUENCE)[None] < size[:, None]
    parts = [features(words[i : i + STEP]) for i in range(0, len(words), STEP)]
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in parts]))])
    bucket = np.concatenate([b.astype(np.int32) for b, _ in parts])
    del parts
    scale = 1 / np.sqrt(np.maximum(1, bounds[1:] - bounds[:-1]))
    used = np.unique(bucket)
    inverse = np.searchsorted(used, bucket).astype(np.int32)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), bounds[1:] - bounds[:-1])
    del bucket
    truth = np.zeros((len(words), n))
    np.add.at(truth, (x[valid], y[valid]), 1)
    pair = valid[:, 1:]
    moves = np.zeros((n, n))
    np.add.at(moves, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    first = np.bincount(y[:, 0], minlength=n).astype(float)
    tokens = valid.sum()
    w, t, s = np.zeros((len(used), n)), model.transition, model.start
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, t, s)]
    for r in range(1, ROUNDS + 1):
        # One label at a time: the feature arrays are the largest of the fit.
        emission = np.stack([segment_sum(w[:, k][inverse], bounds) * scale for k in range(n)], axis=1)
        post, expected, _ = posteriors(emission[x], size, t, s)
        got = np.stack([np.bincount(x[valid], post[valid][:, k], len(words)) for k in range(n)], axis=1)
        gain = (truth - got) * scale[:, None] / tokens
        grad_w = np.stack([np.bincount(inverse, gain[owner, k], len(used)) for k in range(n)], axis=1) * 1e3 - L2 * w
        grads = (grad_w, (moves - expected) / tokens, (first - post[:, 0].sum(axis=0)) / len(size))
        for p, g, (m, v) in zip((w, t, s), grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += RATE * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Crf(labels, used, w.astype(np.float32), t, s)


@dataclass
class Marginals:
    word: np.ndarray  # (words, labels) posteriors
    ahead: np.ndarray  # (texts, labels) message to the word after each text
    back: np.ndarray  # (texts, labels) message to the word before each text


def _unit(x: np.ndarray, axes: int | tuple[int, ...] = -1) -> np.ndarray:
    return x / x.sum(axis=axes, keepdims=True)


def marginals(emission: np.ndarray, before: np.ndarray, transition: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> Marginals:
    """Exact posteriors of texts of any length, each one chain.

    emission: scores by word; before: words before each text; enter: message into each
    text's first word; leave: message back into its last one (all ones at a text's end).
    """
    n, count = emission.shape[1], before[1:] - before[:-1]
    t = np.exp(transition - transition.max())
    blocks = -(-count // BLOCK)
    last = np.cumsum(blocks)
    text = np.repeat(np.arange(len(count)), blocks)
    place = np.arange(len(text)) - (last - blocks)[text]
    size = np.minimum(BLOCK, count[text] - BLOCK * place)
    # Longest block first; words by their place in the block: step k works on the blocks first[k] … first[k + 1].
    order = np.argsort(-size, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    steps = int(size[order[0]]) if len(order) else 0
    live = len(size) - np.searchsorted(np.sort(size), np.arange(steps), "right")
    first = np.concatenate([[0], np.cumsum(live)]).astype(np.int64)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    spot = first[step] + np.repeat(rank, size)
    e = np.empty_like(emission)
    e[spot] = np.exp(emission - emission.max(axis=1, keepdims=True))
    into, out_of = np.zeros((len(text), n)), np.ones((len(text), n))
    into[place == 0] = enter[blocks > 0]
    out_of[last[blocks > 0] - 1] = leave[blocks > 0]
    # Transfer matrices of the blocks of texts with several: diag(e) t diag(e) t … diag(e).
    many = order[blocks[text[order]] > 1]
    if len(many):
        m = np.eye(n) * e[rank[many]][:, None, :]
        for k in range(1, int(size[many[0]])):
            still = int(np.searchsorted(-size[many], -k, "left"))
            m[:still] = (m[:still].reshape(-1, n) @ t).reshape(still, n, n) * e[first[k] + rank[many[:still]]][:, None, :]
            if k % RESCALE == 0:
                m /= m.sum(axis=(1, 2), keepdims=True)
        matrix = np.zeros((len(text), n, n))
        matrix[many] = _unit(m, (1, 2))
        for k in range(1, int(blocks.max())):
            now = np.flatnonzero(place == k)
            into[now] = _unit(np.einsum("bi,bij->bj", into[now - 1], matrix[now - 1]) @ t)
        for k in range(int(blocks.max()) - 1, 0, -1):
            now = np.flatnonzero(place == k)
            out_of[now - 1] = _unit(np.einsum("bij,bj->bi", matrix[now], out_of[now]) @ t.T)
    word, now = np.empty_like(e), into[order]
    for k in range(steps):
        own = slice(first[k], first[k + 1])
        np.multiply(now[: live[k]] @ t if k else now, e[own], out=word[own])
        now = word[own] = _unit(word[own]) if k % RESCALE == 0 else word[own]
    at_end = np.empty((len(size), n))
    at_end[order] = word[first[size[order] - 1] + np.arange(len(size))] if len(size) else 0
    beta = out_of[order]
    for k in range(steps - 1, -1, -1):
        own, m = slice(first[k], first[k + 1]), live[k]
        word[own] *= beta[:m]
        beta[:m] = (e[own] * beta[:m]) @ t.T
        if k % RESCALE == 0:
            beta = _unit(beta)
    back, ahead = leave.copy(), enter.copy()
    full = np.flatnonzero(blocks)
    back[full] = _unit(beta[rank[(last - blocks)[full]]])
    ahead[full] = _unit(at_end[last[full] - 1] @ t)
    return Marginals(_unit(word[spot]), ahead, back)


def label_texts(model: Crf, data: np.ndarray, offsets: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, Marginals]:
    """(code of each word, words before each text, posteriors) of some texts or parts of texts."""
    codes, words, before = words_of(data, offsets)
    texts, n = len(offsets) - 1, len(model.labels)
    enter = np.tile(_unit(np.exp(model.start - model.start.max())), (texts, 1)) if enter is None else enter
    leave = np.ones((texts, n)) if leave is None else leave
    return codes, before, marginals(model.emissions(words)[codes], before, model.transition, enter, leave)


def _long_text(model: Crf, parts: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """(posterior mass by label, words) of one text that comes in parts: messages go forward over all, then back."""
    enter, mass, words = [None], np.zeros(len(model.labels)), 0
    for part in parts[:-1]:
        enter.append(label_texts(model, part, np.array([0, len(part)]), enter[-1])[2].ahead)
    leave = None
    for part, message in zip(reversed(parts), reversed(enter), strict=True):
        codes, _, found = label_texts(model, part, np.array([0, len(part)]), message, leave)
        mass, words, leave = mass + found.word.sum(axis=0), words + len(codes), found.back
    return mass, words


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def share(counts: list[int], rows: int) -> int:
    """The least bound by language whose sample has ``rows`` rows, or all; what small languages leave goes to the others."""
    left = rows
    for k, n in enumerate(sorted(counts)):
        if (bound := max(1, -(-left // (len(counts) - k)))) <= n:
            return bound
        left -= n
    return max(counts, default=0)


_SAMPLE = pa.schema([("lang", pa.string()), ("text", pa.string()), ("h", pa.int64())])


def sample(docs: DataFrame, rows: int = TRAIN_DOCS, windows: int = TRAIN_WINDOWS) -> DataFrame:
    """(lang, text, h): at most ``windows`` windows of SEQUENCE words of documents with a language and a letter whose id is not held out.

    Each language has an equal share of the documents, and one at least: about ``rows`` in all, one more a language at
    most. The windows are drawn from the whole text. Copies with one id count once.
    """
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (id_crc() % 4 != 2))
    # The text is part of the key: rows without id differ too. Keys are 63 bits, evenly spread.
    keyed = known.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit("train")), 1))
    found = {r["lang"]: r["n"] for r in keyed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not found:
        return keyed.select("lang", "text", "h").limit(0)
    bound = share([max(1, n) for n in found.values()], rows)
    # So many keys lie below the edge that the bound is met; only they are ranked, each once.
    edges = docs.sparkSession.createDataFrame([(k, hash_edge(bound, n)) for k, n in found.items()], "lang string, edge long")
    near = keyed.join(F.broadcast(edges), "lang").where("h <= edge")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    last = near.select("lang", "h").distinct().withColumn("n", place).where(F.col("n") <= bound).groupBy("lang").agg(F.max("h").alias("last"))
    chosen = keyed.join(F.broadcast(last), "lang").where("h <= last").groupBy("lang", "h").agg(F.first("text").alias("text"))

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs, keys, texts = [], [], []
        data, offsets = buffers(batch.column(1))
        held: dict[int, list[str]] = {}
        for i, j, chunk, at in slices(data, offsets, cut=between_words):
            codes, words, before = words_of(chunk, at)
            for k in range(i, j):
                mine = codes[before[k - i] : before[k - i + 1]]
                held.setdefault(k, []).extend(" ".join(words[c] for c in mine[a : a + SEQUENCE]) for a in range(0, len(mine), SEQUENCE))
        for k, found in held.items():
            lang, h = batch.column(0)[k].as_py(), batch.column(2)[k].as_py()
            drawn = np.random.default_rng(h).choice(len(found), min(windows, len(found)), replace=False)
            langs += [lang] * len(drawn)
            keys += [h] * len(drawn)
            texts += [found[d] for d in sorted(drawn)]
        yield record(_SAMPLE, langs, texts, keys)

    return map_batches(chosen.select("lang", "text", "h"), one, "lang string, text string, h long")


def train(docs: DataFrame, rows: int = TRAIN_DOCS, windows: int = TRAIN_WINDOWS) -> Crf:
    """Fit, in one task, on a bounded sample in which every language has rows (but for one whose ids are all held out)."""

    def fit_sample(chosen: pa.Table) -> Crf:
        chosen = chosen.sort_by([("h", "ascending"), ("lang", "ascending"), ("text", "ascending")])
        return fit(chosen["text"].to_pylist(), chosen["lang"].to_pylist())

    return fit_in_task(sample(docs, rows, windows), fit_sample)


def judge(model: Crf, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text."""
    n = len(texts)
    if not model.labels:
        return [UNKNOWN] * n, np.zeros(n)
    mass, count = np.zeros((n, len(model.labels))), np.zeros(n, np.int64)
    data, offsets = buffers(texts)
    parts: dict[int, list[np.ndarray]] = {}
    for i, j, chunk, at in slices(data, offsets, cut=between_words):
        if j - i == 1 and len(chunk) < offsets[j] - offsets[i]:
            parts.setdefault(i, []).append(chunk)
            continue
        _, before, found = label_texts(model, chunk, at)
        mass[i:j], count[i:j] = segment_sum(found.word, before), before[1:] - before[:-1]
    for i, chunks in parts.items():
        mass[i], count[i] = _long_text(model, chunks)
    best = mass.argmax(axis=1)
    names = [model.labels[b] if c else UNKNOWN for b, c in zip(best.tolist(), count.tolist(), strict=True)]
    return names, np.clip(np.where(count > 0, mass[np.arange(n), best] / np.maximum(count, 1), 0), 0, 1)


def predict(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, held_out, lang_pred, score of whole texts.

    Defined results: `und` with score 0 if the text is null or has no letter, or if no
    language was learned; ties go to the first label in alphabetical order; repeated
    rows are judged each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield record(_OUT, batch.column(0), batch.column(1), *judge(shared.value, batch.column(2)))

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_crc() % 4 == 2).alias("held_out"), "text")
    return map_batches(chosen, one, "doc_id long, held_out boolean, lang_pred string, score double")


def word_labels(texts: list[str | None], model: Crf) -> list[list[tuple[str, str]]]:
    """(word, language) of each word, for code-switched text."""
    data, offsets = buffers(pa.array(texts, pa.string()))
    codes, words, _ = words_of(data, offsets)
    _, before, found = label_texts(model, data, offsets)
    label = found.word.argmax(axis=1)
    return [[(words[codes[k]], model.labels[label[k]]) for k in range(before[i], before[i + 1])] for i in range(len(texts))]


def identify_languages(docs: DataFrame, rows: int = TRAIN_DOCS) -> DataFrame:
    return predict(docs, train(docs, rows))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents with a language, however small its share of the words is; rows pass through, nothing is joined.

    Defined results: null, empty and letterless texts go, and every text goes where no language can be learned; repeated
    rows and rows without id are kept or dropped each by its text; extra columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def keep(texts: pa.Array) -> np.ndarray:
        names, _ = judge(shared.value, texts)
        return np.array([n != UNKNOWN for n in names], bool)

    return filter_batches(docs, "text", keep)
