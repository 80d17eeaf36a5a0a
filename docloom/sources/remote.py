"""Remote documents: repository READMEs and video transcripts by URL, through fetchers that the caller gives.

``read_remote`` takes a table or stream of URLs; ``remote_format`` makes a data source of
the same for ``spark.read``. A fetcher gets an address and gives back the text of the
answer (JSON); it raises ``ServiceError``, ``TimeoutError`` or ``ConnectionError``, which
are tried again by the rules of model clients. A URL that can't be read is a row with a
reason, never a failed task.

URLs are dealt over ``tasks`` tasks by their hash, and each task waits so long between
two calls that all of them together stay below ``per_second``.

Odd input: null and blank URLs and those of no known kind have a reason; a repeated URL
of a table is fetched once. An answer of another shape than expected has a reason.
"""

from __future__ import annotations

import base64
import json
import re
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docloom.functions import columns as C
from docloom.functions.markdown import clean_text
from docloom.operators.models import ModelError, call_service

Fetch = Callable[[str], str]
#: Addresses of a repository's description and README (fixed values).
REPOSITORY, README = "https://api.github.com/repos/{}", "https://api.github.com/repos/{}/readme"
DOCUMENT = "source string, source_type string, filename string, text string, title string, extra string, modified_at timestamp, reason string"
_COLUMNS = [c.split()[0] for c in DOCUMENT.split(", ")]


class Unfetched(ValueError):
    """The answer is no document."""


def _json(fetch: Fetch, address: str, retries: int, backoff: float) -> dict:
    try:
        found = json.loads(call_service(lambda: fetch(address), retries, backoff))
    except ValueError as error:
        raise Unfetched("the answer is no JSON") from error
    if not isinstance(found, dict):
        raise Unfetched("the answer is no object")
    return found


def _text(value: object) -> str | None:
    return value if isinstance(value, str) and value else None


def _time(value: object) -> datetime | None:
    try:
        at = datetime.fromisoformat(value.replace("Z", "+00:00")) if isinstance(value, str) else None
    except ValueError:
        return None
    return at.astimezone(timezone.utc).replace(tzinfo=None) if at else None


def readme(repository: str, get: Callable[[str], dict]) -> tuple:
    """(type, file name, text, title, extra, time) of a repository's README."""
    about, page = get(REPOSITORY.format(repository)), get(README.format(repository))
    if not isinstance(page.get("content"), str):
        raise Unfetched("the README has no content")
    try:
        text = clean_text(base64.b64decode(page["content"]).decode("utf-8"))
    except ValueError as error:
        raise Unfetched("the README is no UTF-8 text") from error
    if not text:
        raise Unfetched("the README is empty")
    owner = about.get("owner") if isinstance(about.get("owner"), dict) else {}
    extra = {"author": _text(owner.get("login")), "default_branch": about.get("default_branch"), "description": about.get("description"), "path": page.get("path")}
    return "github_readme", _text(page.get("name")) or "README.md", text, _text(about.get("full_name")) or repository, extra, _time(about.get("updated_at"))


def transcript(video: str, get: Callable[[str], dict]) -> tuple:
    """(type, file name, text, title, extra, time) of a video's transcript: {"snippets": [{"text": …}], "language": …}."""
    found = get(video)
    snippets = found.get("snippets") if isinstance(found.get("snippets"), list) else []
    text = clean_text("\n".join(_text(s.get("text") if isinstance(s, dict) else s) or "" for s in snippets))
    if not text:
        raise Unfetched("the transcript is empty")
    extra = {k: found.get(k) for k in ("language", "language_code", "is_generated")} | {"snippets": len(snippets)}
    return "youtube_transcript", f"{video}.transcript.md", text, f"YouTube Transcript - {video}", extra, None


class _Reader:
    """Reads one URL after the other, with waits; runs in a task."""

    def __init__(self, repositories: Fetch | None, transcripts: Fetch | None, wait: float, retries: int, backoff: float):
        self.fetchers = {"repository": (repositories, readme), "video": (transcripts, transcript)}
        self.wait, self.retries, self.backoff, self.next = wait, retries, backoff, 0.0

    def _get(self, fetch: Fetch, address: str) -> dict:
        pause = self.next - time.monotonic()
        if pause > 0:
            time.sleep(pause)
        self.next = time.monotonic() + self.wait
        return _json(fetch, address, self.retries, self.backoff)

    def read(self, url: str | None, kind: str | None, name: str | None) -> tuple:
        try:
            if kind not in self.fetchers:
                raise Unfetched("no reader for this URL")
            fetch, read = self.fetchers[kind]
            if fetch is None:
                raise Unfetched("no fetcher for this kind")
            type_, file, text, title, extra, at = read(name, lambda address: self._get(fetch, address))
            return url, type_, file, text, title, json.dumps(extra, sort_keys=True, default=str), at, None
        except (Unfetched, ModelError) as error:
            return url, kind, None, None, None, None, None, str(error)
        except Exception as error:  # a broken answer of any kind is set aside
            return url, kind, None, None, None, None, None, type(error).__name__


def read_remote(
    urls: DataFrame, repositories: Fetch | None = None, transcripts: Fetch | None = None, url: str = "url", per_second: float | None = None, tasks: int = 8, retries: int = 2, backoff: float = 1.0
) -> DataFrame:
    """One row (``DOCUMENT``) for each URL; ``reason`` tells why one could not be read."""
    own = urls.select(F.col(url).cast("string").alias("url"))
    own = own if urls.isStreaming else own.dropDuplicates(["url"])
    video, repo = C.video_id(F.col("url")), C.repository(F.col("url"))
    kind = F.when(video.isNotNull(), "video").when(repo.isNotNull(), "repository")
    name = F.coalesce(video, F.concat(repo["owner"], F.lit("/"), repo["name"]))
    wait = tasks / per_second if per_second else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Reader(repositories, transcripts, wait, retries, backoff)
        for b in batches:
            rows = [reader.read(*(x if isinstance(x, str) else None for x in r)) for r in b.itertuples(index=False)]
            out = pd.DataFrame(rows, columns=_COLUMNS)
            yield out.astype({"modified_at": "datetime64[ns]"})

    return own.select("url", kind.alias("kind"), name.alias("name")).repartition(tasks, "url").mapInPandas(run, DOCUMENT)


_VIDEO = re.compile(r"(?i)https?://(?:(?:www\.|m\.)?youtube\.com/(?:watch\?(?:.*&)?v=|embed/|shorts/|live/|v/)|youtu\.be/)([^/?&#]+)")
_REPOSITORY = re.compile(r"(?i)https?://github\.com/([^/?#]+)/([^/?#]+?)(?:\.git)?(?:[/?#]|$)")


def remote_format(name: str, repositories: Fetch | None = None, transcripts: Fetch | None = None) -> type[DataSource]:
    """A data source for ``spark.dataSource.register``: spark.read.format(name).option("urls", JSON list).load().

    Options: ``tasks`` (partitions), ``perSecond``, ``retries``, ``backoff``. For more URLs than the driver should
    hold, and for streams, use ``read_remote``.
    """

    class Remote(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return DOCUMENT

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.urls = list(dict.fromkeys(json.loads(options["urls"])))
            self.tasks = max(1, min(int(options.get("tasks", 8)), len(self.urls)))
            rate = float(options.get("perSecond", 0))
            self.how = (self.tasks / rate if rate else 0.0, int(options.get("retries", 2)), float(options.get("backoff", 1.0)))

        def partitions(self):
            return [InputPartition(self.urls[i :: self.tasks]) for i in range(self.tasks)]

        def read(self, partition):
            reader = _Reader(repositories, transcripts, *self.how)
            for url in partition.value or []:
                video, repo = _VIDEO.match(url or ""), _REPOSITORY.match(url or "")
                kind, what = ("video", video[1]) if video else ("repository", f"{repo[1]}/{repo[2]}") if repo else (None, None)
                yield reader.read(url, kind, what)

    return Remote
