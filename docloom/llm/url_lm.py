"""URL filter by the ratio of two character language models.

Rules (host, path prefix → allow or block) judge the URLs that they fit; the longest
fitting rule wins. Other URLs are judged by two variable-order Markov models over
bytes, one of accepted and one of rejected URLs: the difference of their
log-likelihoods per byte against a calibrated threshold. Witten-Bell smoothing blends
the orders 0 to ``ORDER``: a longer context counts the more, the more often it was
seen against the number of different bytes after it, and an unseen one not at all. So
contexts get longer where the URLs give reason to.

The models are tables, not arrays: a window of ``ORDER`` + 1 = 8 bytes is one long, its
context a shift and its shorter windows masks. Counts of all orders and their
probabilities are Spark tables that grow with the URLs; order k is computed from order
k - 1 by joins on windows, of which at most 256 share a context or a shorter window,
so no key is hot. Only the windows of the URLs themselves can be: they are joined to
their log-ratios with the hot ones broadcast (a bounded number).

The models learn from four fifths of the rule-judged URLs, by a hash of the URL; the
threshold is calibrated on the last fifth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.graph import join_low
from docloom.llm.plumbing import map_batches, record, stage
from docloom.llm.textcore import buffers

#: The contract's rules (host, path prefix, verdict).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
ORDER = 7
BYTES = 256
_MASKS = [(1 << 8 * (k + 1)) - 1 if k < ORDER else -1 for k in range(ORDER + 1)]  # the last k + 1 bytes of a window
BINS, SPREAD = 2000, 10.0
#: One in HELD_OUT rule-judged URLs calibrates the threshold.
HELD_OUT = 5


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lowered; none: empty."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ? # or the end."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def apply_rules(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Add rule and rule_verdict (null where none fits) from host and path."""
    name = verdict = None
    for host, path, what in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name = F.when(fits, F.lit(host + path)) if name is None else F.when(fits, F.lit(host + path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)) if verdict is None else F.when(fits, F.lit(what)).otherwise(verdict)
    none = F.lit(None).cast("string")
    return pages.withColumn("rule", none if name is None else name).withColumn("rule_verdict", none if verdict is None else verdict)


def byte_windows(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a long of each byte and its ORDER predecessors, bytes of each URL); before a URL stand zero bytes."""
    data, offsets = buffers(urls)
    size = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    window = data.astype(np.uint64)
    for k in range(1, min(ORDER, len(data) - 1) + 1):
        before = np.zeros(len(data), np.uint64)
        before[k:] = data[:-k]
        before[place < k] = 0
        window |= before << np.uint64(8 * k)
    return window.view(np.int64), size


_PLACES = pa.schema([("key", pa.int64()), ("side", pa.string()), ("n", pa.int64()), ("w", pa.int64())])


def _places(urls: DataFrame) -> DataFrame:
    """A row for each byte of each URL: key, side, n and the byte's window."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        window, size = byte_windows(batch.column(3))
        owner = pa.array(np.repeat(np.arange(batch.num_rows), size))
        yield record(_PLACES, *(batch.column(k).take(owner) for k in range(3)), window)

    return map_batches(urls.select("key", "side", "n", "url"), one, "key long, side string, n long, w long")


def log_ratios(counts: DataFrame) -> DataFrame:
    """(w, ratio) of all windows: log of the accepted over the rejected model's probability of a window's last byte.

    counts: (w, a, b), how often accepted and rejected URLs have each window; a window with none is to be judged only.
    """
    shorter = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("w").bitwiseAND(F.lit(_MASKS[k])).alias("w")) for k in range(ORDER + 1)))).alias("g")
    grams = counts.select(shorter, "a", "b").groupBy("g.k", "g.w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    grams = grams.select("k", "w", "a", "b", F.shiftrightunsigned("w", 8).alias("c"))
    seen = [f for s in "ab" for f in (F.sum(s).alias(f"{s}_all"), F.sum((F.col(s) > 0).cast("long")).alias(f"{s}_kinds"))]
    contexts = grams.groupBy("k", "c").agg(*seen)
    rows = stage(grams.join(contexts, ["k", "c"]).sortWithinPartitions("k"), "url-grams")
    known = None
    for k in range(ORDER + 1):
        own = rows.where(F.col("k") == k)
        if known is None:
            own = own.select("*", F.lit(1 / BYTES).alias("a_less"), F.lit(1 / BYTES).alias("b_less"))
        else:
            less = known.select(F.col("w").alias("s"), F.col("a_p").alias("a_less"), F.col("b_p").alias("b_less"))
            own = own.withColumn("s", F.col("w").bitwiseAND(F.lit(_MASKS[k - 1]))).join(less, "s")
        known = own.select("w", *(_blend(s).alias(f"{s}_p") for s in "ab"))
    return known.select("w", F.log(F.col("a_p") / F.col("b_p")).alias("ratio"))


def _blend(side: str) -> Column:
    """Witten-Bell: the counts of a seen context, with the shorter window's probability for as many as it has different bytes."""
    kinds, all_, less = F.col(f"{side}_kinds"), F.col(f"{side}_all"), F.col(f"{side}_less")
    return F.when(all_ > 0, (F.col(side) + kinds * less) / (all_ + kinds)).otherwise(less)


def threshold_of(scored: DataFrame) -> float:
    """The threshold with the highest balanced accuracy on (rule_verdict, score), from a histogram; 0 without both verdicts."""
    place = F.least(F.greatest(((F.col("score") / SPREAD + 1) / 2 * BINS).cast("int"), F.lit(0)), F.lit(BINS - 1))
    # At most 2 * BINS rows reach the driver.
    rows = scored.where("rule_verdict is not null").groupBy("rule_verdict", place.alias("bin")).count().collect()
    share = {}
    for verdict in ("allow", "block"):
        total = sum(r["count"] for r in rows if r["rule_verdict"] == verdict)
        if not total:
            return 0.0
        share[verdict] = [0.0] * BINS
        for r in rows:
            if r["rule_verdict"] == verdict:
                share[verdict][r["bin"]] = r["count"] / total
    below, edges = 0.0, [0.0]
    for block, allow in zip(share["block"], share["allow"], strict=True):
        below += block - allow
        edges.append(below)
    best = [k for k, x in enumerate(edges) if x >= max(edges) - 1e-12]
    return ((best[0] + best[-1]) / BINS - 1) * SPREAD


def score_urls(judged: DataFrame) -> tuple[DataFrame, float]:
    """(url, score, n) of each distinct URL, and the threshold; judged: (url, rule_verdict).

    The score is the length-normalised log-likelihood difference; it is 0 where rules have not given both verdicts.
    """
    calibrates = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0
    # A URL counts as often as it stands in the table; it is scored once.
    urls = judged.where("url is not null and url <> ''").groupBy("url").agg(F.count("*").alias("n"), F.max("rule_verdict").alias("rule_verdict"))
    side = F.when(calibrates, None).when(F.col("rule_verdict") == "allow", "a").when(F.col("rule_verdict") == "block", "b")
    urls = stage(urls.select(F.monotonically_increasing_id().alias("key"), "url", "n", "rule_verdict", side.alias("side")), "url-distinct")
    both = {r["side"] for r in urls.where("side is not null").select("side").distinct().collect()}
    if both != {"a", "b"}:
        return urls.select("url", F.lit(0.0).alias("score"), "n"), 0.0
    places = _places(urls)
    counts = places.groupBy("w").agg(*(F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(s) for s in "ab"), F.count("*").alias("n"))
    counts = stage(counts, "url-windows")
    named = log_ratios(counts.select("w", "a", "b")).join(counts.select("w", "n"), "w")
    total = counts.agg(F.sum("n")).first()[0]
    each = join_low(places.select("key", "w"), stage(named, "url-ratios"), "w", total)
    scored = each.groupBy("key").agg((F.sum("ratio") / F.count("*")).alias("score")).join(urls.select("key", "url", "n", "rule_verdict"), "key")
    scored = stage(scored, "url-scores")
    return scored.select("url", "score", "n"), threshold_of(scored.where(calibrates))


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of each URL.

    Defined results: a null URL or one without :// has empty host and path, fits no
    rule and is scored as it stands (null and empty: 0); without learned URLs of both
    verdicts every score and the threshold are 0 (allow); repeated rows are judged
    each, and a URL counts as often as it stands in the table; an empty table gives no
    rows; extra columns are ignored.
    """
    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    judged = apply_rules(chosen, rules)
    scored, threshold = score_urls(judged.select("url", "rule_verdict"))
    known = judged.where("url is not null and url <> ''")
    rest = judged.where("url is null or url = ''").withColumn("score", F.lit(0.0))
    rows = join_low(known, scored, "url", pages.count()).select(*judged.columns, "score").unionByName(rest.select(*judged.columns, "score"))
    own = F.when(F.col("score") >= F.lit(threshold), "allow").otherwise("block")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "score")
