"""Sentence boundaries learned from a corpus without labels, after Kiss and Strunk (2006).

A period belongs to an abbreviation where its word nearly always has one. For each type
(a word in lower case, without its final period) Spark counts how often it comes with
and without the period; a log-likelihood ratio says how far the type is from the
corpus's average, and is scaled by length (short), inner periods (more) and occurrences
without a period (each one counts against it). Words that follow true sentence ends more
often than chance explains are starters: a period of an abbreviation ends a sentence
where a capitalised starter comes next.

Counts are two aggregations over all words of all texts, combined before their shuffle.
The learned types are tables. Where they are at most ``IN_HAND`` they go to the workers
with the function; beyond that each text gets those of its own words by a join over the
hash of the text.

Odd input: a null or empty text has no words and no sentences; an empty corpus gives
empty tables, with which only the built-in abbreviations count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.markdown import HEURISTIC, Boundaries
from docloom.functions.tables import ABBREVIATIONS

#: Scores from which a type is an abbreviation and a word a sentence starter (published values).
ABBREVIATION_SCORE, STARTER_SCORE = 0.3, 30.0
#: Learned types that are shipped with the function; more of them are joined.
IN_HAND = 100_000
_WORD = r"^\p{L}(?:[\p{L}.]*\p{L})?\.?$"


def _words(text: Column) -> Column:
    """The words of a text, without marks around them; numbers and ellipses stay as places without a word (empty)."""
    bare = F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", ""))
    return F.transform(bare, lambda w: F.when(w.rlike(_WORD), w).otherwise(F.lit("")))


def _type(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"\.$", ""))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(type, dotted, plain): occurrences of each type with and without a period after it."""
    words = docs.select(F.explode(_words(F.col(text))).alias("word")).where("word <> ''")
    dot = F.col("word").endswith(".")
    return words.groupBy(_type(F.col("word")).alias("type")).agg(F.count_if(dot).alias("dotted"), F.count_if(~dot).alias("plain"))


def abbreviation_scores(docs: DataFrame, text: str = "text") -> DataFrame:
    """(type, dotted, plain, score) of each type that comes with a period."""
    counts = word_counts(docs, text)
    total = counts.agg(F.sum("dotted").alias("dots"), F.sum(F.col("dotted") + F.col("plain")).alias("words"))
    share = F.col("dots") / F.col("words")
    letters = F.length(F.replace("type", F.lit("."))).cast("double")
    inner = F.length("type") - letters
    # A corpus in which every word has a period says nothing about a type.
    ratio = 2 * (F.col("dotted") * (F.log(F.lit(0.99)) - F.log(share)) + F.col("plain") * (F.log(F.lit(0.01)) - F.log(F.greatest(1 - share, F.lit(1e-12)))))
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -F.col("plain").cast("double"))
    return counts.where("dotted > 0").crossJoin(F.broadcast(total)).select("type", "dotted", "plain", score.alias("score"))


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    """k · ln p + (n - k) · ln (1 - p), where 0 · ln 0 is 0."""
    term = lambda c, q: F.when(c > 0, c * F.log(q)).otherwise(0.0)
    return term(k, p) + term(n - k, 1 - p)


def starter_scores(docs: DataFrame, abbreviations: DataFrame, text: str = "text") -> DataFrame:
    """(type, after_end, elsewhere, score) of the words that follow sentence ends more often than chance explains.

    A sentence end is a period of a type that is not in ``abbreviations``. The first word of a text follows nothing
    and is not counted.
    """
    words = docs.select(_words(F.col(text)).alias("w"))
    pairs = words.select(F.explode(F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.struct(a.alias("before"), b.alias("word")))).alias("p")).select("p.*")
    pairs = pairs.where("word <> ''").select(_type(F.col("word")).alias("type"), F.when(F.col("before").endswith("."), _type(F.col("before"))).alias("before"))
    counted = pairs.groupBy("type", "before").count()
    ends = counted.join(abbreviations.select(F.col("type").alias("before"), F.lit(True).alias("short")), "before", "left")
    end = F.col("before").isNotNull() & F.col("short").isNull()
    each = ends.groupBy("type").agg(F.sum(F.when(end, F.col("count")).otherwise(0)).alias("after_end"), F.sum(F.when(end, 0).otherwise(F.col("count"))).alias("elsewhere"))
    total = each.agg(F.sum("after_end").alias("ends"), F.sum("elsewhere").alias("rest"))
    k1, n1, k2, n2 = (F.col(c).cast("double") for c in ("after_end", "ends", "elsewhere", "rest"))
    p, p1, p2 = (k1 + k2) / (n1 + n2), k1 / n1, F.when(n2 > 0, k2 / n2).otherwise(0.0)
    score = 2 * (_log_likelihood(k1, n1, p1) + _log_likelihood(k2, n2, p2) - _log_likelihood(k1, n1, p) - _log_likelihood(k2, n2, p))
    return each.crossJoin(F.broadcast(total)).where((F.col("after_end") > 0) & (p1 > p2)).select("type", "after_end", "elsewhere", score.alias("score"))


@dataclass
class Engine:
    """A way to find sentence ends: what every text shares, and a step that gives each text what its own words add."""

    shared: Boundaries = HEURISTIC
    abbreviations: DataFrame | None = None
    starters: DataFrame | None = None

    def attach(self, docs: DataFrame, text: str) -> DataFrame:
        """``docs`` with __abbreviations and __starters: the learned types among a text's own words; null where they are shared."""
        none = F.lit(None).cast("array<string>")
        if self.abbreviations is None:
            return docs.withColumns({"__abbreviations": none, "__starters": none})
        key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
        own = docs.select(key.alias("__key"), F.explode(F.array_distinct(F.transform(_words(F.col(text)), _type))).alias("type")).distinct()
        tagged = [t.select("type", F.lit(name).alias("kind")) for name, t in (("a", self.abbreviations), ("s", self.starters))]
        met = own.join(tagged[0].unionByName(tagged[1]), "type").groupBy("__key").agg(
            F.array_sort(F.collect_list(F.when(F.col("kind") == "a", F.col("type")))).alias("__abbreviations"),
            F.array_sort(F.collect_list(F.when(F.col("kind") == "s", F.col("type")))).alias("__starters"),
        )
        return docs.withColumn("__key", key).join(met, "__key", "left").drop("__key")


#: The engine of the built-in abbreviations alone.
BUILT_IN = Engine()


def trained(docs: DataFrame, text: str = "text", in_hand: int = IN_HAND) -> Engine:
    """An engine learned from the texts of ``docs``; the built-in abbreviations count as well.

    The learned tables are made here (jobs over all texts): they are staged in the shared folder and counted.
    """
    from docloom.runtime import stage

    short = stage(abbreviation_scores(docs, text).where(F.col("score") >= ABBREVIATION_SCORE).select("type"), "abbreviations")
    first = stage(starter_scores(docs, short, text).where(F.col("score") >= STARTER_SCORE).select("type"), "starters")
    if short.count() + first.count() > in_hand:
        return Engine(HEURISTIC, short, first)
    return Engine(Boundaries(ABBREVIATIONS | {r["type"] for r in short.collect()}, {r["type"] for r in first.collect()}))
