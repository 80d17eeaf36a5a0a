"""External models behind small protocols, with deterministic stand-ins; question answering."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.retrieval import build_context, service_search


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def __call__(self, prompt: str) -> str: ...


class ModelError(RuntimeError):
    """A model call failed for good."""


def hash_embedder(dimensions: int = 64) -> Embedder:
    """Unit Gaussian vectors seeded by the text: the same text, the same vector."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            seed = int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")
            v = np.random.default_rng(seed).standard_normal(dimensions)
            out.append((v / np.linalg.norm(v)).tolist())
        return out

    return embed


def with_retries(call: Callable[[], object], tries: int = 3, base_seconds: float = 1.0, sleep: Callable[[float], None] = time.sleep, fatal: tuple = ()) -> object:
    """Call again after base · 2^n seconds; ``fatal`` errors are not tried again."""
    for n in range(tries):
        try:
            return call()
        except fatal:
            raise
        except Exception as error:
            if n + 1 == tries:
                raise ModelError(str(error)) from error
            sleep(base_seconds * 2**n)
    raise ModelError("no tries")


def embed_column(text: Column, embedder: Embedder, batch: int = 64) -> Column:
    """Vectors of a text column; blank texts give null; a wrong number of vectors is an error."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            known = [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip()]
            out: list = [None] * len(texts)
            for a in range(0, len(known), batch):
                part = known[a : a + batch]
                got = with_retries(lambda part=part: embedder([texts.iloc[i] for i in part]))
                if len(got) != len(part):
                    raise ModelError("the embedder returned another number of vectors")
                for i, v in zip(part, got, strict=True):
                    out[i] = v
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")(text)


class ServiceError(RuntimeError):
    """What a model server answers instead of a text: its HTTP status."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(message or f"status {status}")
        self.status = status

    def __reduce__(self):
        return ServiceError, (self.status, str(self))


class NoSuchModel(ModelError):
    """The server does not have the model (404)."""


class BadAnswer(ModelError):
    """The server refused the request, or its answer is empty or no text."""


class TimedOut(ModelError):
    """No answer in time, on every attempt."""


class Unreachable(ModelError):
    """No connection, on every attempt."""


def call_service(call: Callable[[], object], retries: int = 2, backoff: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """One text from a model server, without white space around it.

    Statuses of 500 and more, timeouts and lost connections are tried again after backoff · 2^n seconds.
    404, other statuses and empty answers are not. Errors of other kinds pass through.
    """
    for attempt in range(retries + 1):
        last = attempt == retries
        try:
            answer = call()
        except ServiceError as error:
            if error.status == 404:
                raise NoSuchModel(str(error)) from error
            if error.status < 500 or last:
                raise BadAnswer(f"status {error.status}") from error
        except TimeoutError as error:
            if last:
                raise TimedOut("no answer in time") from error
        except ConnectionError as error:
            if last:
                raise Unreachable("no connection") from error
        else:
            if not isinstance(answer, str) or not answer:
                raise BadAnswer("the answer is empty" if answer in ("", None) else "the answer is no text")
            return answer.strip()
        if backoff > 0:
            sleep(backoff * 2**attempt)
    raise ModelError("no attempts")


def per_row_answers(texts: Column, ask_one: Callable[[str], tuple], kind: str) -> Column:
    """ask_one(text) for each row, as a struct of this type; it has to turn the errors that belong to a row into fields."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [f.split(":")[0].split()[0] for f in kind.split(",")]
        for batch in batches:
            yield pd.DataFrame([ask_one(t) for t in batch], columns=names, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, kind)(texts)


def generate(docs: DataFrame, prompt: Column, generator: Generator, retries: int = 2, backoff: float = 1.0) -> DataFrame:
    """Add `answer` and `answer_error`: one call a row; a null prompt is not sent and has neither."""

    def one(text: str | None) -> tuple[str | None, str | None]:
        if text is None:
            return None, None
        try:
            return call_service(lambda: generator(text), retries, backoff), None
        except ModelError as error:
            return None, f"{type(error).__name__}: {error}"

    made = docs.withColumn("__a", per_row_answers(prompt, one, "answer string, error string"))
    return made.withColumns({"answer": F.col("__a.answer"), "answer_error": F.col("__a.error")}).drop("__a")


def generate_json(docs: DataFrame, prompt: Column, generator: Generator, schema: str, retries: int = 2, backoff: float = 1.0) -> DataFrame:
    """Add `answer` in this schema and `answer_error`; an answer that is no JSON of the schema is an error of its row."""
    made = generate(docs, prompt, generator, retries, backoff).withColumn("__j", F.from_json("answer", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"}))
    bad = F.col("answer").isNotNull() & (F.col("__j").isNull() | F.col("__j.__bad").isNotNull())
    error = F.when(bad, F.lit("BadAnswer: no JSON of the schema")).otherwise(F.col("answer_error"))
    return made.withColumns({"answer_error": error, "answer": F.when(~bad & F.col("answer").isNotNull(), F.col("__j").dropFields("__bad"))}).drop("__j")


ANALYSIS = (
    "title string, summary string, keywords array<string>, concepts array<struct<name:string,importance:string>>, "
    "definitions array<struct<term:string,text:string>>, entities array<struct<name:string,type:string>>, topics array<string>"
)
IMPORTANCE = ("high", "medium", "low")
AGAIN = "\n\nYour last answer did not fit the schema. Answer with corrected JSON only, with all required fields."


def analysis_problem(answer: str) -> str | None:
    """Why an answer is no analysis; None if it is one."""
    try:
        found = json.loads(answer)
    except ValueError:
        return "no valid JSON"
    if not isinstance(found, dict):
        return "no valid JSON"
    if not isinstance(found.get("title"), str) or not found["title"].strip():
        return "blank title"
    concepts = found.get("concepts") or []
    if not all(isinstance(c, dict) and c.get("importance") in IMPORTANCE for c in concepts):
        return "unknown importance"
    return None


def analyse(docs: DataFrame, generator: Generator, prompt: str = "Analyse this document as JSON:\n{text}", validation_retries: int = 2, text: str = "text", retries: int = 2, backoff: float = 1.0) -> DataFrame:
    """Add `analysis` (a fixed schema), `analysis_error` and `attempts`: an answer that does not fit is asked for again, with a word on why."""

    def one(body: str | None) -> tuple[str | None, str | None, int]:
        sent, error = prompt.replace("{text}", body or ""), None
        for attempt in range(1, validation_retries + 2):
            try:
                answer = call_service(lambda: generator(sent if attempt == 1 else sent + AGAIN), retries, backoff)  # noqa: B023
                error = analysis_problem(answer)
            except BadAnswer as bad:
                error = str(bad)
            except ModelError as lost:
                return None, f"{type(lost).__name__}: {lost}", attempt
            if error is None:
                return answer, None, attempt
        return None, error, validation_retries + 1

    made = docs.withColumn("__a", per_row_answers(F.col(text), one, "answer string, error string, attempts int"))
    return made.withColumns({"analysis": F.from_json("__a.answer", ANALYSIS), "analysis_error": F.col("__a.error"), "attempts": F.col("__a.attempts")}).drop("__a")


QA_PROMPT = "Answer from the sources only, and name them.\n\n{context}\n\nQuestion: {question}"


def ask(corpus: DataFrame, question: str, generator: Generator, embed=None, k: int = 8, min_score: float = 0.0, filters: dict | None = None) -> tuple[str, DataFrame]:
    """(answer, hits): search, a bounded context, one model call; without hits the model is not called."""
    hits = service_search(corpus, question, embed, k, min_score, filters)
    context = build_context(hits).first()["context"]
    if not context:
        return "No relevant sources were found.", hits
    return str(with_retries(lambda: generator(QA_PROMPT.replace("{context}", context).replace("{question}", question)))), hits


def ocr_summary(pages: DataFrame, low: float = 60.0) -> DataFrame:
    """(source, mean_confidence, empty_pages, low_confidence_pages) of OCR pages (source, page_no, text, confidence)."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    return pages.groupBy("source").agg(
        F.avg("confidence").alias("mean_confidence"),
        F.array_sort(F.collect_list(F.when(blank, F.col("page_no")))).alias("empty_pages"),
        F.array_sort(F.collect_list(F.when(F.col("confidence") < low, F.col("page_no")))).alias("low_confidence_pages"),
    )
