"""python -m docloom.cli: ingest, search, ask, watch, status, config, doctor."""

from __future__ import annotations

import argparse
import json
import os
import sys
from importlib.util import find_spec

from pyspark.sql import functions as F

from docloom import config, observability
from docloom.functions import columns as C
from docloom.operators import retrieval as R
from docloom.operators.models import ask
from docloom.session import local_session
from docloom.sources import files, store
from docloom.streaming.watch import watch


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="docloom")
    top.add_argument("--store", default="store", help="folder of the engine's tables")
    top.add_argument("--log-folder", help="folder of rotating log files, JSON lines")
    top.add_argument("--log-level", default="WARNING")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("ingest")
    p.add_argument("path")
    for name, words in (("search", "query"), ("ask", "question")):
        p = sub.add_parser(name)
        p.add_argument(words)
        p.add_argument("--top-k", type=int, default=10)
        p.add_argument("--min-score", type=float, default=0.0)
        p.add_argument("--source-type")
        p.add_argument("--filter", help="JSON object of field: value")
    p = sub.add_parser("watch")
    p.add_argument("folder")
    sub.add_parser("status")
    p = sub.add_parser("config")
    p.add_argument("folder", nargs="?", default="config", help="folder of default.yaml and <environment>.yaml")
    p.add_argument("--environment")
    sub.add_parser("doctor")
    return top


def checks(store_folder: str) -> list[tuple[str, str, str]]:
    """(what, OK, WARN or FAIL, detail) of the interpreter, the libraries and the store's folder."""
    found = [("python", "OK", f"{sys.version_info.major}.{sys.version_info.minor}")]
    for needed, module in ((True, "pyspark"), (True, "pyarrow"), (True, "pandas"), (True, "numpy"), (False, "yaml"), (False, "pypdf")):
        there = find_spec(module) is not None
        found.append((module, "OK" if there else "FAIL" if needed else "WARN", "installed" if there else "not installed"))
    if "://" in store_folder:
        return [*found, ("store", "OK", f"{store_folder} is reached through Spark")]
    at = os.path.abspath(store_folder)
    while not os.path.exists(at):
        at = os.path.dirname(at)
    return [*found, ("store", "OK" if os.path.isdir(at) and os.access(at, os.W_OK) else "FAIL", at)]


def filters_of(text: str | None, source_type: str | None) -> dict:
    found = json.loads(text) if text else {}
    if not isinstance(found, dict):
        raise SystemExit("--filter must be a JSON object")
    return found | ({"source_type": source_type} if source_type else {})


def main(args: list[str] | None = None) -> None:
    a = _parser().parse_args(args)
    observability.configure(a.log_folder, a.log_level)
    if a.command == "config":
        print(json.dumps(config.load(a.folder, a.environment), indent=2, sort_keys=True, default=str))
        return
    if a.command == "doctor":
        found = checks(a.store)
        for row in found:
            print(*row, sep="\t")
        if any(state == "FAIL" for _, state, _ in found):
            raise SystemExit(1)
        return
    spark = local_session()
    if a.command == "ingest":
        good, bad = files.ingest(spark, a.path)
        old = store.versions(spark, f"{a.store}/documents")
        store.write_version(good, f"{a.store}/documents", (old or [0])[-1] + 1)
        bad.show(truncate=False)
    elif a.command == "watch":
        watch(spark, a.folder, f"{a.store}/watch", f"{a.store}/watch-checkpoint").awaitTermination()
    elif a.command == "status":
        for name in ("documents", "watch/manifest", "watch/quarantine"):
            try:
                found = store.read_latest(spark, f"{a.store}/{name}") if name == "documents" else spark.read.parquet(f"{a.store}/{name}/*")
                print(name, found.count() if found is not None else 0)
            except Exception:
                print(name, 0)
    else:
        docs = store.read_latest(spark, f"{a.store}/documents")
        if docs is None:
            raise SystemExit("nothing was ingested yet")
        corpus = docs.select("source", "source_type", "text", F.col("source").alias("id"), F.xxhash64("source").alias("seq"), F.lit(None).cast("array<double>").alias("embedding"))
        wanted = filters_of(a.filter, a.source_type)
        if a.command == "search":
            hits = R.service_search(corpus, a.query, None, a.top_k, a.min_score, wanted)
            hits.orderBy("rank").select("rank", F.format_string("%.4f", "rrf").alias("score"), "source", C.snippet(F.col("text")).alias("snippet")).show(truncate=False)
        else:
            answer, hits = ask(corpus, a.question, lambda prompt: prompt, None, a.top_k, a.min_score, wanted)
            print(answer)


if __name__ == "__main__":
    main()
