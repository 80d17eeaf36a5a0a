"""Headline timings: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import time

from docloom.session import local_session

HEADLINES = (
    "dense_topk", "dense_batch_top3", "bm25_topk", "hybrid_search", "hybrid_post_filter", "cross_document_links", "qa_context_budget",
    "exact_duplicates", "language_detect", "html_strip", "chunks", "clean_text", "relationships", "kg_subgraph_depth2",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    from docloom.operators.retrieval import corpus_of
    from docloom.plans.catalog import QUERIES

    first: dict[str, float] = {}
    steady: dict[str, float] = {}
    timed = lambda df: df.write.format("noop").mode("overwrite").save()
    spark.range(1).count()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    timed(docs.select("doc_id"))
    # The index that searches share is built by itself, so that no query's time hides or carries it.
    began = time.perf_counter()
    corpus_of(docs, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    build = round(time.perf_counter() - began, 3)
    for name in HEADLINES:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            timed(QUERIES[name](spark, sf_dir))
            runs.append(time.perf_counter() - began)
        first[name], steady[name] = round(runs[0], 3), round(min(runs[1:]), 3)
    total = round(build + sum(steady.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": {"lexical_index_build": build, **steady}, "first_runs": first, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
