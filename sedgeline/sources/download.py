"""Archives over HTTP: one Python Data Source fetches them, another stores them and commits what became of each.

Reading "archive_download" gives a row for each task, with the archive's bytes and a status, and has a
partition for each, so that no Spark task holds more than one archive. Writing rows to "archive_store" puts each
archive in its place (whole or not at all) and its status into a part of the state, which counts only once
the job is committed: a job that fails leaves the state as it was, and the archives that are in their place
already are found by the next one.

Statuses: completed (reason existing: it was there before), skipped_empty (not_found, empty, not_zip),
failed (timeout, rate_limited, http_<code>, connection).
"""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sedgeline.sources import stores

#: Fixed value: the first bytes of a ZIP file.
ZIP_MAGIC = b"PK\x03\x04"
FETCHED = "output_path string, item_code long, fiscal_year int, status string, reason string, error string, http int, attempts int, bytes long, content binary"
RECORDED = "output_path string, status string, reason string, error string, http int, attempts int, bytes long, at timestamp"
_COLUMNS = pa.schema([
    ("output_path", pa.string()), ("item_code", pa.int64()), ("fiscal_year", pa.int32()), ("status", pa.string()), ("reason", pa.string()),
    ("error", pa.string()), ("http", pa.int32()), ("attempts", pa.int32()), ("bytes", pa.int64()), ("content", pa.binary()),
])


@dataclass(frozen=True)
class Settings:
    """url: with {item_code} and {fiscal_year}. Seconds: backoff doubles with each attempt, limited_wait follows a 429, delay an archive."""

    url: str
    attempts: int = 3
    backoff: float = 5.0
    limited_wait: float = 60.0
    timeout: float = 60.0
    delay: float = 2.0
    agent: str = "sedgeline"


@dataclass(frozen=True)
class Outcome:
    status: str
    reason: str | None = None
    error: str | None = None
    http: int | None = None
    attempts: int = 0
    content: bytes | None = None


def fetch(url: str, settings: Settings, sleep: Callable[[float], None] = time.sleep) -> Outcome:
    """The archive at url, or why there is none. Time-outs, 429 and 5xx are tried again."""
    last = Outcome("failed", "no_attempt")
    for attempt in range(1, settings.attempts + 1):
        wait = settings.backoff * 2 ** (attempt - 1)
        try:
            request = urllib.request.Request(url, headers={"User-Agent": settings.agent})
            with urllib.request.urlopen(request, timeout=settings.timeout) as answer:
                content = b"" if answer.headers.get("Content-Length") == "0" else answer.read()
            if content[:4] == ZIP_MAGIC:
                return Outcome("completed", None, None, answer.status, attempt, content)
            return Outcome("skipped_empty", "not_zip" if content else "empty", None, answer.status, attempt)
        except urllib.error.HTTPError as answer:
            answer.close()
            if answer.code == 404:
                return Outcome("skipped_empty", "not_found", None, 404, attempt)
            last = Outcome("failed", "rate_limited" if answer.code == 429 else f"http_{answer.code}", str(answer), answer.code, attempt)
            if answer.code == 429:
                wait = settings.limited_wait
            elif answer.code < 500:
                return last
        except (OSError, http.client.HTTPException) as broken:
            late = isinstance(broken, TimeoutError) or isinstance(getattr(broken, "reason", None), TimeoutError)
            last = Outcome("failed", "timeout" if late else "connection", repr(broken), None, attempt)
            if not late:
                return last
        if attempt < settings.attempts:
            sleep(wait)
    return last


@dataclass
class _Task(InputPartition):
    task: dict


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.tasks = json.loads(options["tasks"])
        self.root = options.get("root")
        self.settings = Settings(**json.loads(options["settings"]))

    def partitions(self) -> Sequence[InputPartition]:
        return [_Task(t) for t in self.tasks]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        task = partition.task
        there = stores.size(f"{self.root}/{task['output_path']}") if self.root else 0
        found = Outcome("completed", "existing") if there else fetch(self.settings.url.format(**task), self.settings)
        row = {k: task[k] for k in ("output_path", "item_code", "fiscal_year")} | asdict(found)
        row["bytes"] = there or len(found.content or b"")
        yield pa.RecordBatch.from_pylist([row], schema=_COLUMNS)
        if found.content:
            time.sleep(self.settings.delay)


class ArchiveDownload(DataSource):
    """Options: tasks (JSON: item_code, fiscal_year, output_path of each), settings (JSON of Settings), root (archives that are there aren't fetched)."""

    @classmethod
    def name(cls) -> str:
        return "archive_download"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


@dataclass
class _Part(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.root, self.state = options.get("root"), options["state"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        lines = []
        for batch in iterator:
            named = dict(zip(batch.schema.names, batch.columns, strict=True))
            archives = named.pop("content", None)
            rows = pa.RecordBatch.from_pydict({k: v for k, v in named.items() if k in RECORDED}).to_pylist()
            for i, row in enumerate(rows):
                if archives is not None and archives[i].is_valid:
                    stores.put(f"{self.root}/{row['output_path']}", archives[i].as_py())
                lines.append(json.dumps(row | {"at": datetime.now(UTC).isoformat()}, ensure_ascii=False, default=str))
        if not lines:
            return _Part(None)
        name = f"{uuid.uuid4().hex}.json"
        stores.put(f"{self.state}/parts/{name}", "\n".join(lines).encode())
        return _Part(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = [m.name for m in messages if m and m.name]
        if parts:
            stores.put(f"{self.state}/commits/{time.time_ns():020d}-{uuid.uuid4().hex}.json", "\n".join(json.dumps({"part": p}) for p in parts).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m and m.name:
                stores.remove(f"{self.state}/parts/{m.name}")


class ArchiveStore(DataSource):
    """Options: state (a folder), root (under which output_path is). Rows: output_path, status, and any of the columns of the download."""

    @classmethod
    def name(cls) -> str:
        return "archive_store"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveDownload)
    spark.dataSource.register(ArchiveStore)


def downloads(spark: SparkSession, tasks: list[dict], settings: Settings, root: str | None = None) -> DataFrame:
    """A row for each task, fetched when the frame is used. The tasks go with the plan: some thousands at most."""
    register(spark)
    plain = [{k: t[k] for k in ("output_path", "item_code", "fiscal_year")} for t in tasks]
    reader = spark.read.format("archive_download").options(tasks=json.dumps(plain), settings=json.dumps(asdict(settings)))
    return (reader.option("root", stores.qualified(spark, root)) if root else reader).load()


def store(fetched: DataFrame, state: str, root: str | None = None) -> None:
    """Archives to their places under root, and what became of each task to the state: all of it, or, if the job fails, nothing."""
    spark = fetched.sparkSession
    register(spark)
    writer = fetched.write.format("archive_store").mode("append").option("state", stores.qualified(spark, state))
    (writer.option("root", stores.qualified(spark, root)) if root else writer).save()


def recorded(spark: SparkSession, state: str) -> DataFrame:
    """Every entry of committed jobs."""
    if not stores.exists(spark, f"{state}/commits"):
        return spark.createDataFrame([], RECORDED)
    committed = spark.read.schema("part string").json(f"{state}/commits")
    entries = spark.read.schema(RECORDED).json(f"{state}/parts").select("*", F.col("_metadata.file_name").alias("part"))
    return entries.join(committed, "part", "left_semi").drop("part")
