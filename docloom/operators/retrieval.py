"""Ranked retrieval: exact dense search, BM25, reciprocal-rank fusion, context budgets.

Each leg works on its own narrow table: the dense leg on ids and vectors, the lexical
leg on counts of words. Texts are tokenised once, by a vectorised Arrow pass, and read
again only for the k rows that are shown. An index keeps the counts by term for many
queries. Batches of queries are scored in blocks of a matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import columns as C
from docloom.functions.words import term_counts
from docloom.operators.segments import SegmentedIndex
from docloom.operators.segments import term_score as _term_score
from docloom.operators.threshold_join import Best, dots, first_hits, threshold_join
from docloom.runtime import file_version, fresh_path, spread, stage

RRF_K, POOL_FACTOR, POOL_LEAST = 60, 5, 50
#: Most values of a query matrix that is sent to every executor.
QUERY_VALUES = 8_000_000
#: Queries and rows of a task beyond that; queries and rows of one matrix product, whatever the number of queries.
BATCH_BLOCK, SCORE_BLOCK = 16_384, 1024
CONTEXT_HITS, CONTEXT_CHARS = 8, 12_000


@dataclass
class Corpus:
    """What a search reads: rows (id, seq and whatever is shown), vectors (id, embedding, filter columns), and a lexical index if there is one."""

    rows: DataFrame
    vectors: DataFrame
    index: LexicalIndex | SegmentedIndex | None = None

    @property
    def columns(self) -> list[str]:
        return self.rows.columns


def vectors(docs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Documents with their vectors as one table."""
    held = embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    return docs.join(held, "doc_id", "left").withColumns(_ids("doc_id"))


def _ids(key: str) -> dict[str, Column]:
    return {"id": F.concat(F.lit("doc-"), F.col(key).cast("string")), "seq": F.col(key)}


def corpus_of(docs: DataFrame, embeddings: DataFrame, indexed: bool = True) -> Corpus:
    """The search corpus of two tables, which are never joined but on ids; its index is kept for as long as the files stay as they are."""
    rows = docs.withColumns(_ids("doc_id"))
    held = embeddings.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select(_ids("vec_id")["id"].alias("id"), "embedding")
    return Corpus(rows, held, index_of(rows, file_version(docs)) if indexed else None)


def _corpus(source: DataFrame | Corpus) -> Corpus:
    return source if isinstance(source, Corpus) else Corpus(source, source)


def block_scores(rows: pa.Array, queries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(scores, sizes): cosine of each query with each row in f64; null rows have size -1 and, like other dimensions or zero vectors, score 0."""
    size = np.asarray(rows.value_lengths().fill_null(-1))
    flat = np.asarray(rows.flatten().cast(pa.float64()))
    at = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    scores = np.zeros((len(queries), len(size)))
    for d in {len(q) for q in queries} - {0}:
        mine, own = np.flatnonzero(size == d), [i for i, q in enumerate(queries) if len(q) == d]
        if len(mine):
            m, q = flat[at[mine, None] + np.arange(d)], np.stack([queries[i] for i in own])
            scale = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((m * m).sum(1))[None]
            cosine = np.divide(dots(q, m), scale, out=np.zeros_like(scale), where=scale > 0)
            if cosine.shape == scores.shape:
                return cosine, size
            scores[np.ix_(own, mine)] = cosine
    return scores, size


def query_score(embedding: Column, query: list[float]) -> Column:
    """Cosine with a constant vector: one matrix product per Arrow batch."""
    constant = np.asarray(query, float)

    def score(rows: pa.Array) -> pa.Array:
        return pa.array(block_scores(rows, [constant])[0][0])

    score.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, "double")(embedding)


def top(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows with their rank: a bounded heap per task, then a window over k rows."""
    if k <= 0:
        return scored.limit(0).withColumn("rank", F.lit(0))
    return scored.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def dense_search(corpus: DataFrame, query: list[float], k: int, min_score: float = 0.0, filters: dict | None = None) -> DataFrame:
    """(corpus columns, score, rank): filters before ranking, then score ≥ min_score, ties by id."""
    rows = corpus.where(F.col("embedding").isNotNull())
    if filters:
        rows = rows.where(C.matches({c: F.col(c) for c in corpus.columns if c != "metadata"}, F.col("metadata") if "metadata" in corpus.columns else None, filters))
    scored = rows.drop("score", "rank").withColumn("score", query_score(F.col("embedding"), query)).where(F.col("score") >= min_score)
    return top(scored, k, F.desc("score"), F.asc("id"))


def dense_all(corpus: DataFrame, query: list[float], min_score: float = 0.0) -> DataFrame:
    """(id, score, rank) of every row with score ≥ min_score, ties by id: sorted in ranges, ranked by place and range."""
    scored = corpus.where(F.col("embedding").isNotNull()).select("id", query_score(F.col("embedding"), query).alias("score")).where(F.col("score") >= min_score)
    order = (F.desc("score"), F.asc("id"))
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    # The id's upper bits are the range, its lower 33 the place: staged, so that both uses see the same.
    placed = stage(placed, "dense-all").withColumns({"__range": F.shiftright("__at", 33), "__place": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = F.sum("rows").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    bases = placed.groupBy("__range").agg(F.count("*").alias("rows")).select("__range", F.coalesce(before, F.lit(0)).alias("base"))
    return placed.join(F.broadcast(bases), "__range").select("id", "score", (F.col("base") + F.col("__place") + 1).alias("rank"))


def _vectors(rows: pa.Array) -> list[np.ndarray]:
    """Each vector in f64, as a view of one array."""
    flat = np.asarray(rows.flatten().cast(pa.float64()))
    ends = np.cumsum(np.asarray(rows.value_lengths()))
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if len(ends) else []


def _meet(best: Best, queries: list[np.ndarray], ids: pa.Array, rows: pa.Array, block: int) -> None:
    """Let all queries meet a batch of rows, ``block`` of each at a time; equal scores go by id."""
    order = pc.sort_indices(ids)
    ids, rows = ids.take(order), rows.take(order)
    for j in range(0, len(rows), block):
        part = rows.slice(j, block)
        for i in range(0, len(queries), block):
            scores, size = block_scores(part, queries[i : i + block])
            q, r = first_hits(scores, (scores >= best.bound[i : i + block, None]) & (size >= 0), best.k)
            best.add(q + i, ids.take(pa.array(r + j)), scores[q, r])
    best.merge()


def dense_batch(corpus: DataFrame, queries: DataFrame | list[tuple[object, list[float]]], k: int, min_score: float = 0.0) -> DataFrame:
    """(query, id, score, rank): each query's top k by blocked matrix products; queries: (query, embedding) or a list of such pairs.

    Queries of at most QUERY_VALUES values are sent to every task, which holds and returns k
    rows a query at most. More are never gathered: blocks of queries meet blocks of rows in
    tasks of their own. Either way a task holds the scores of SCORE_BLOCK queries and rows.
    """
    rows = corpus.where(F.col("embedding").isNotNull()).select("id", "embedding")
    if isinstance(queries, list):
        kind = "long" if isinstance(queries[0][0], int) else "string"
        queries = corpus.sparkSession.createDataFrame(queries, f"query {kind}, embedding array<double>")
    # Aliased: queries that come of the same table would share its column.
    asks = queries.where(F.col("embedding").isNotNull()).select(F.col("query").alias("query"), F.col("embedding").alias("embedding"))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((asks, "query"), (rows, "id"))]
    schema, block = f"query {kinds[0]}, id {kinds[1]}, score double", SCORE_BLOCK
    size = asks.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0)).alias("values"), F.count("*").alias("asks")).first()
    if not size["asks"]:
        return corpus.sparkSession.createDataFrame([], f"{schema}, rank int")
    if size["values"] <= QUERY_VALUES:
        held = asks.toArrow()
        shared = corpus.sparkSession.sparkContext.broadcast((held["query"].combine_chunks(), held["embedding"].combine_chunks()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, asked = shared.value
            qs, best = _vectors(asked), None
            for batch in batches:
                best = best or Best(len(qs), k, min_score, batch.column(0).type)
                _meet(best, qs, batch.column(0), batch.column(1), block)
            if best is not None:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(best.q)), best.ids, pa.array(best.s)], names=["query", "id", "score"])

        found = rows.mapInArrow(run, schema)
    else:
        number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        a, b = (max(1, -(-n // BATCH_BLOCK)) for n in (size["asks"], rows.count()))
        left = asks.withColumn("a", number("query", a)).withColumn("b", every(b))
        right = rows.withColumn("b", number("id", b)).withColumn("a", every(a))

        def meet(q: pa.Table, r: pa.Table) -> pa.Table:
            best = Best(q.num_rows, k, min_score, r.schema.field("id").type)
            _meet(best, _vectors(q["embedding"].combine_chunks()), r["id"].combine_chunks(), r["embedding"].combine_chunks(), block)
            return pa.table([q["query"].combine_chunks().take(pa.array(best.q)), best.ids, pa.array(best.s)], names=["query", "id", "score"])

        found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(meet, schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def query_terms(text: str) -> list[str]:
    import re

    return sorted(set(re.findall("[a-z0-9_]+", text.lower())))


_COUNTED = "id {id}, seq {seq}, words long, counts array<long>"


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def bm25_counts(rows: DataFrame, terms: list[str]) -> DataFrame:
    """(id, seq, words, counts): each text's words and how often it has each term, by one vectorised pass; id null: sums of a batch's other texts.

    Texts without a term give no row of their own; their number, words and no more are in the sums (counts[0] is their number).
    """
    schema = _COUNTED.format(id=_kind(rows, "id"), seq=_kind(rows, "seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words, row, code, known, count = term_counts(batch.column(2))
            place = {t: i for i, t in enumerate(terms)}
            to = np.array([place.get(w, -1) for w in known] or [-1], np.int64)[code if len(code) else []]
            found = np.zeros((batch.num_rows, len(terms)), np.int64)
            found[row[to >= 0], to[to >= 0]] = count[to >= 0]
            hit = np.flatnonzero(found.any(axis=1))
            rest = np.zeros((1, len(terms)), np.int64)
            rest[0, 0] = batch.num_rows - len(hit)
            counts = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([found[hit], rest]).ravel()), len(terms)).cast(pa.list_(pa.int64()))
            keys = [pa.concat_arrays([c.take(pa.array(hit)), pa.nulls(1, c.type)]) for c in batch.columns[:2]]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.append(words[hit], words.sum() - words[hit].sum())), counts], names=["id", "seq", "words", "counts"])

    return rows.select("id", "seq", "text").mapInArrow(run, schema)


def bm25_legs(source: DataFrame | Corpus, query: str, k: int | None = None) -> DataFrame:
    """(id, seq, score) of all rows with a query term, or at least of the k best of them."""
    corpus, terms = _corpus(source), query_terms(query)
    if k is not None and isinstance(corpus.index, SegmentedIndex):
        return corpus.index.top(terms, k)
    if corpus.index:
        return corpus.index.scores(terms)
    counted = stage(bm25_counts(spread(corpus.rows.select("id", "seq", "text")), terms), "bm25-counts")
    n, many = F.when(F.col("id").isNull(), F.col("counts")[0]).otherwise(1), range(len(terms))
    stats = counted.agg(F.sum(n).alias("__n"), F.sum("words").alias("__words"), *(F.count_if(F.col("id").isNotNull() & (F.col("counts")[i] > 0)).alias(f"__df{i}") for i in many))
    mean = F.col("__words") / F.col("__n")
    score = reduce(lambda a, b: a + b, (F.when(F.col("counts")[i] > 0, _term_score(F.col("counts")[i], F.col(f"__df{i}"), F.col("__n"), F.col("words"), mean)).otherwise(0.0) for i in many))
    return counted.where("id is not null").crossJoin(F.broadcast(stats)).select("id", "seq", score.alias("score"))


def bm25_search(source: DataFrame | Corpus, query: str, k: int) -> DataFrame:
    """(rows' columns, score, rank) of documents with a query term; ties by seq."""
    corpus = _corpus(source)
    if not query_terms(query) or k <= 0:
        return corpus.rows.limit(0).withColumns({"score": F.lit(0.0), "rank": F.lit(0)})
    return shown(corpus.rows, top(bm25_legs(corpus, query, k), k, F.desc("score"), F.asc("seq")).select("id", "seq", "score", "rank"))


#: Most ids that are looked up as literals, so that the scan can skip what it does not need.
FETCH = 1000


def shown(rows: DataFrame, best: DataFrame) -> DataFrame:
    """rows' columns of the best (id, …) few, with the other columns of ``best``; what rows already has under these names is replaced.

    A small result is looked up by its keys in the scan; texts of other rows are not read where the file can skip them.
    For this the best few are computed here, at most FETCH + 1 rows: making the plan runs their jobs. A caller who wants
    no job yet takes the ranked ids themselves (``bm25_legs``, ``top``) and joins them later.
    """
    extra = [c for c in best.columns if c not in ("id", "seq")]
    few = best.limit(FETCH + 1).collect()
    if len(few) > FETCH:
        return rows.drop(*extra).join(best.drop("seq"), "id")
    kept = rows.drop(*extra)
    if few and "seq" in best.columns:
        kept = kept.where(F.col("seq").isin(sorted({r["seq"] for r in few})))
    kept = kept.where(F.col("id").isin(sorted({r["id"] for r in few}))) if few else kept.limit(0)
    found = rows.sparkSession.createDataFrame([tuple(r) for r in few], best.schema).drop("seq")
    return kept.join(F.broadcast(found), "id")


@dataclass
class LexicalIndex:
    """Postings (term, id, seq, words, tf) sorted by term: a search reads the row groups of its terms. The term '' names every document."""

    postings: DataFrame
    documents: int
    words: int

    def scores(self, terms: list[str]) -> DataFrame:
        """(id, seq, score) of all documents with a term."""
        found = self.postings.where(F.col("term").isin(terms))
        # One row a term is sent.
        df = found.groupBy("term").agg(F.count("*").alias("df"))
        part = _term_score(F.col("tf"), F.col("df"), F.lit(self.documents), F.col("words"), F.lit(self.words / max(1, self.documents)))
        return found.join(F.broadcast(df), "term").groupBy("id", "seq").agg(F.sum(part).alias("score"))


def build_index(rows: DataFrame, path: str | None = None) -> LexicalIndex:
    """Tokenise rows (id, seq, text) once and write the postings, in ranges of (term, id): a term of every document is many tasks' work."""
    schema = f"term string, id {_kind(rows, 'id')}, seq {_kind(rows, 'seq')}, words long, tf long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words, row, code, known, count = term_counts(batch.column(2))
            every = np.concatenate([np.arange(batch.num_rows), row])
            term = pa.array(["", *known]).take(pa.array(np.concatenate([np.zeros(batch.num_rows, np.int64), code + 1])))
            keys = [c.take(pa.array(every)) for c in batch.columns[:2]]
            yield pa.RecordBatch.from_arrays([term, *keys, pa.array(words[every]), pa.array(np.concatenate([np.zeros(batch.num_rows, np.int64), count]))], names=["term", "id", "seq", "words", "tf"])

    made = spread(rows.select("id", "seq", "text")).mapInArrow(run, schema)
    path = path or fresh_path(rows.sparkSession, "lexical-index")
    made.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(path)
    return open_index(rows.sparkSession, path, schema)


def open_index(spark: SparkSession, path: str, schema: str | None = None) -> LexicalIndex:
    """An index as it was written under a path."""
    postings = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    total = postings.where("term = ''").agg(F.count("*").alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    return LexicalIndex(postings, total["n"], total["words"])


_INDEXES: list[tuple[str, str, DataFrame, LexicalIndex]] = []
#: Indexes of this many tables are remembered by a session.
KEPT_INDEXES = 8


def index_of(rows: DataFrame, version: str | None) -> LexicalIndex | None:
    """The index of a table at a version of its files, built when it is first asked for.

    Another plan over the same files (filtered, joined, with another text) is another table and has another index.
    """
    if version is None:
        return None
    session, narrow = rows.sparkSession.sparkContext.applicationId, rows.select("id", "seq", "text")
    for app, files, table, index in _INDEXES:
        if (app, files) == (session, version) and table.sameSemantics(narrow):
            return index
    _INDEXES[: max(0, len(_INDEXES) - KEPT_INDEXES + 1)] = []
    _INDEXES.append((session, version, narrow, build_index(rows)))
    return _INDEXES[-1][-1]


def bm25_postings(docs: DataFrame, id_: str = "doc_id") -> DataFrame:
    """(term, id, tf) of all documents."""
    return docs.select(id_, F.explode(C.tokens("text")).alias("term")).groupBy("term", id_).agg(F.count("*").alias("tf"))


def bm25_statistics(docs: DataFrame) -> DataFrame:
    """One row: documents (empty ones too), words, mean length."""
    return docs.select(F.size(C.tokens(F.coalesce("text", F.lit("")))).alias("dl")).agg(F.count("*").alias("n_docs"), F.sum("dl").alias("n_words"), F.avg("dl").alias("avg_dl"))


def rrf(legs: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(id, rrf) of rank lists (id, rank): an id may occur more than once."""
    union = reduce(DataFrame.unionAll, (leg.select("id", (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("part")) for leg in legs))
    return union.groupBy("id").agg(F.sum("part").alias("rrf"))


def hybrid_search(source: DataFrame | Corpus, query: str, vector: list[float] | None, k: int = 10, min_score: float = 0.0, post_filter: Column | None = None) -> DataFrame:
    """(rows' columns, rrf, rank): dense and BM25 legs of max(5k, 50) candidates, fused; the post filter comes after the cut."""
    corpus = _corpus(source)
    if k <= 0 or (not query.strip() and not vector):
        return corpus.rows.limit(0).withColumns({"rrf": F.lit(0.0), "rank": F.lit(0)})
    pool = max(POOL_FACTOR * k, POOL_LEAST)
    legs = []
    if vector:
        scored = corpus.vectors.where(F.col("embedding").isNotNull()).select("id", query_score(F.col("embedding"), vector).alias("score"))
        legs.append(top(scored.where(F.col("score") >= 0), pool, F.desc("score"), F.asc("id")))
    if query_terms(query):
        legs.append(top(bm25_legs(corpus, query, pool), pool, F.desc("score"), F.asc("seq")))
    if not legs:
        return corpus.rows.limit(0).withColumns({"rrf": F.lit(0.0), "rank": F.lit(0)})
    fused = top(rrf(legs).where(F.col("rrf") >= min_score), k, F.desc("rrf"), F.asc("id"))
    hits = shown(corpus.rows, fused)
    return hits.where(post_filter) if post_filter is not None else hits


def service_search(source: DataFrame | Corpus, query: str, embed, k: int = 10, min_score: float = 0.0, filters: dict | None = None) -> DataFrame:
    """The search facade: a blank query finds nothing, a failing embedder leaves the lexical leg."""
    corpus = _corpus(source)
    if not query.strip():
        return corpus.rows.limit(0).withColumns({"rrf": F.lit(0.0), "rank": F.lit(0)})
    try:
        vector = embed(query) if embed else None
    except Exception:
        vector = None
    fields = {c: F.col(c) for c in corpus.columns if c not in ("metadata", "embedding")}
    wanted = C.matches(fields, F.col("metadata") if "metadata" in corpus.columns else None, filters) if filters else None
    return hybrid_search(corpus, query, vector or None, k, min_score, wanted)


def context_blocks(hits: DataFrame, chars: int = CONTEXT_CHARS, most: int = CONTEXT_HITS) -> DataFrame:
    """(hit columns, kept, block): the first hits in rank order, cut where the character budget ends."""
    first = hits.where(F.col("rank") <= most).withColumn("__text", C.collapse(F.coalesce("text", F.lit(""))))
    before = F.coalesce(F.sum(F.char_length("__text")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = first.withColumn("__before", before).where(F.col("__before") < chars).withColumn("kept", F.expr(f"substring(__text, 1, int({chars} - __before))"))
    head = F.concat(F.lit("[SOURCE "), F.col("rank").cast("string"), F.lit("]\nSource: "), F.col("source"), F.lit("\nScore: "), F.format_string("%.4f", F.col("rrf")), F.lit("\nContent:\n"), F.col("kept"))
    return kept.withColumn("block", head).drop("__text", "__before")


def build_context(hits: DataFrame) -> DataFrame:
    """One row, context: the blocks in order, a blank line between them (eight rows at most are gathered)."""
    blocks = context_blocks(hits).agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return blocks.select(F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"))


def cross_document_links(chunks: DataFrame, threshold: float = 0.7, top_k: int = 3, first_chunks: int = 3, prior: bool = False) -> DataFrame:
    """(source, links): other sources among the top_k of each of a source's first chunks with cosine ≥ threshold.

    chunks: id, source, chunk_index, seq, embedding. The store competes as a whole,
    own chunks included; ``prior`` only lets earlier chunks (seq up to the source's
    last) compete. An exact join, pruned by pivots; it runs while the plan is made.
    """
    rows = chunks.where(F.col("embedding").isNotNull())
    first = rows.where(F.col("chunk_index") < first_chunks)
    if prior:
        first = first.join(rows.groupBy("source").agg(F.max("seq").alias("last")), "source")
    asks = first.select(F.col("id").alias("query"), "embedding", F.col("last") if prior else F.lit(None).cast("long").alias("last"))
    near = threshold_join(rows.select("id", "seq", "embedding"), asks, threshold, top_k)
    names = rows.select("id", "source")
    pairs = near.select("query", "id").join(names.withColumnRenamed("source", "other"), "id").join(names.withColumnRenamed("id", "query"), "query")
    found = pairs.where("other <> source").groupBy("source").agg(F.countDistinct("other").alias("links"))
    return rows.select("source").distinct().join(found, "source", "left").select("source", F.coalesce("links", F.lit(0)).alias("links"))


def empty_hits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id string, source string, text string, rrf double, rank int")
