"""Text quality by a sparse ensemble of rules.

Statistics of a text are Spark column expressions. Boosted trees over a bounded
sample of labelled rows give candidate rules: every path from a root to a node is a
conjunction of threshold tests. A lasso logistic regression keeps a few of them with
weights, and the kept rules are compiled back into one Spark column expression, so
that scoring runs inside the JVM, without Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.plumbing import fit_in_task, hashed_sample, id_crc

#: Bound of the training sample.
TRAIN_ROWS = 6000
TREES, DEPTH, BINS, SHRINK, LEAF = 30, 3, 32, 0.3, 8
LASSO, ROUNDS = 2e-3, 400
THRESHOLD = 0.7
#: A rule: conjunction of (statistic, is-above, threshold).
Rule = tuple[tuple[str, bool, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """name → expression over ``text``; ``words`` (the distinct-word base) is computed once by ``with_statistics``."""
    chars, words = F.col("__chars"), F.col("__words")
    share = lambda n, of: n / F.greatest(of, F.lit(1))
    dropped = lambda mark: chars - F.char_length(F.replace(text, F.lit(mark)))
    return {
        "log_words": F.log1p(words),
        "distinct_share": share(F.col("__distinct"), words),
        "distinct_root": F.col("__distinct") / F.sqrt(F.greatest(words, F.lit(1))),
        "word_length": share(chars, words),
        "letter_share": share(F.col("__letters"), chars),
        "upper_share": share(F.col("__upper"), F.col("__letters")),
        "digit_share": share(F.col("__digits"), chars),
        "line_share": share(dropped("\n"), words),
        "stop_share": share(dropped("."), words),
        "comma_share": share(dropped(","), words),
        "shout_share": share(dropped("!"), words),
        "bar_share": share(dropped("|"), words),
    }


def with_statistics(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """The columns in ``keep`` and one column for each statistic of the whole text; null texts count as empty."""
    text = F.col("__text")
    base = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    split = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    base = base.withColumn("__split", split).select(
        *keep,
        "__text",
        F.char_length(text).alias("__chars"),
        F.size("__split").alias("__words"),
        F.size(F.array_distinct("__split")).alias("__distinct"),
        F.char_length(F.regexp_replace(text, r"[^\p{L}]+", "")).alias("__letters"),
        F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("__upper"),
        F.char_length(F.regexp_replace(text, r"[^0-9]+", "")).alias("__digits"),
    )
    named = statistics(text)
    return base.select(*keep, *(c.cast("double").alias(f"__s_{k}") for k, c in named.items())), list(named)


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def column(self) -> Column:
        """The score as one expression over the statistics' columns."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            tests = [(F.col(f"__s_{name}") > t) if above else (F.col(f"__s_{name}") <= t) for name, above, t in rule]
            total = total + F.when(reduce(lambda a, b: a & b, tests), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def scores(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        """The same in NumPy, for tests."""
        z = np.full(len(x), self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            z += weight * _holds(rule, x, names)
        return 1 / (1 + np.exp(-z))


def _holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, t in rule:
        column = x[:, names.index(name)]
        out &= (column > t) if above else (column <= t)
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> list[Rule]:
    """Paths of boosted regression trees on logistic gradients; splits at sample quantiles."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = [np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]  # code ≤ k exactly if x ≤ cut k
    rules: dict[Rule, None] = {}
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    z = np.full(len(y), np.log(rate / (1 - rate)))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        todo: list[tuple[np.ndarray, Rule]] = [(np.arange(len(y)), ())]
        while todo:
            rows, path = todo.pop()
            best = (1e-6, 0, 0)
            if len(path) < DEPTH and len(rows) >= 2 * LEAF:
                total_g, total_h = g[rows].sum(), h[rows].sum() + 1
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    bins = len(c) + 1
                    gs, hs, n = (np.cumsum(np.bincount(codes[f][rows], w, bins))[:-1] for w in (g[rows], h[rows], None))
                    gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs) - total_g**2 / total_h
                    gain[(n < LEAF) | (len(rows) - n < LEAF)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
            if best[0] <= 1e-6:
                z[rows] += SHRINK * g[rows].sum() / (h[rows].sum() + 1)
                continue
            _, f, k = best
            for above, mask in ((False, codes[f][rows] <= k), (True, codes[f][rows] > k)):
                longer = (*path, (names[f], above, float(cuts[f][k])))
                rules[longer] = None
                todo.append((rows[mask], longer))
    return list(rules)


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleEnsemble:
    """Rules from trees, weights from lasso logistic regression (accelerated proximal gradient)."""
    if not len(y) or y.min() == y.max():
        rate = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return RuleEnsemble([], [], float(np.log(rate / (1 - rate))))
    rules = tree_rules(x, y, names)
    hold = np.stack([_holds(r, x, names) for r in rules], axis=1) if rules else np.zeros((len(y), 0), bool)
    _, first = np.unique(hold, axis=1, return_index=True)
    rules, hold = [rules[i] for i in sorted(first)], hold[:, sorted(first)].astype(np.float32)
    center = hold.mean(axis=0)
    w, b, v, vb, t = np.zeros(len(rules)), 0.0, np.zeros(len(rules)), 0.0, 1.0
    step = 4 / max(1.0, float(np.linalg.norm(hold - center, 2) ** 2 / len(y)) + 1)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-((hold - center) @ v + vb)))
        r = p - y
        w2 = v - step * ((hold - center).T @ r) / len(y)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * LASSO, 0)
        b2 = vb - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleEnsemble([rules[i] for i in keep], [float(w[i]) for i in keep], float(b - center @ w))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> RuleEnsemble:
    """Fit on a bounded sample of labelled documents whose id is not held out; several labels of a document: the mean."""
    learned = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (id_crc() % 4 != 2))
    # At most `rows` labels are sent to the join.
    sample = hashed_sample(learned.groupBy("doc_id").agg(F.avg("quality").alias("quality")), rows, F.col("doc_id"), "quality")
    joined = hashed_sample(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), rows, F.struct("doc_id", "text"), "quality")
    table, names = with_statistics(joined, ["quality"])

    def fit_sample(rows: pa.Table) -> RuleEnsemble:
        data = np.stack([rows[k].to_numpy().astype(float) for k in ("quality", *(f"__s_{k}" for k in names))], axis=1) if rows.num_rows else np.zeros((0, len(names) + 1))
        data = data[np.lexsort(data.T[::-1])]  # the same rules whatever the order of arrival
        return fit(data[:, 1:], (data[:, 0] >= 0.5).astype(float), names)

    return fit_in_task(table.select("quality", *(f"__s_{k}" for k in names)), fit_sample)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of whole texts.

    Defined results: a null text has the statistics of an empty one; without labels
    every score is 0.5; repeated rows are scored each.
    """
    model = train(docs, labels)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_crc() % 4 == 2).alias("held_out"), "text")
    table, _ = with_statistics(keyed, ["doc_id", "held_out"])
    return table.select("doc_id", "held_out", model.column().alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
