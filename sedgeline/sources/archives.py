"""Archived CSV files as DataFrames, with an account of every file, and the acquisition's tasks and state.

No archive is read whole. Spark lists the files; tasks read the directories at their ends by ranges, which
gives a table of members; these are dealt out by size, so that one archive's members are in several tasks,
and each task decompresses and parses its members as streams. Every member gives either rows or one status,
and a damaged one doesn't touch the others.
"""

from __future__ import annotations

import codecs
import csv
import io
import math
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import csv as arrow_csv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.sources import download, stores

#: The raw files' columns, by position; None is dropped.
RAW_COLUMNS = (
    "category", "measurement_type", "organization", "mesh_code", "latitude", "longitude", "prefecture", "city",
    None, None, None, "correction_date", "value", "statistical_error", "detection_lower_limit", "unit", None,
    "measurement_height_cm", None, None, None, None, None, None, None, "sampling_point_state", None, None, None,
    "note", "project_id", None, "mesh_id_250m", None, None, None, "distance_from_fdnpp_km",
)
ENCODINGS = ("utf-8-sig", "shift_jis", "cp932")
#: Rows of a file that are sent at a time.
_SLICE = 20_000
#: Members up to this size are decompressed once and held, larger ones are read as streams, once for each question.
HELD_BYTES = 8 << 20
#: Bytes of members, decompressed, for a task.
PART_BYTES = 64 << 20
_KEPT = [(i, c) for i, c in enumerate(RAW_COLUMNS) if c]
_DATE = RAW_COLUMNS.index("correction_date")
_MEMBERS = "path string, bytes long, member string, size long, status string"
_SCHEMA = "path string, bytes long, member string, status string, row_no long, " + ", ".join(f"{c} string" for _, c in _KEPT)
_DAMAGED = (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, struct.error, ValueError)


def archive_files(spark: SparkSession, path: str, classes: Sequence[str] | None = None, items: Sequence[str] | None = None, years: Sequence[int] | None = None) -> DataFrame:
    """path, bytes, source_class, source_item of the ZIP files under path (<class>/<item>/<year>.zip); nothing of them is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path)
    parts = F.split("path", "/")
    named = files.select("path", F.col("length").alias("bytes"), F.element_at(parts, -3).alias("source_class"), F.element_at(parts, -2).alias("source_item"))
    year = F.regexp_extract("path", r"([^/]*)\.zip$", 1)
    for column, wanted in ((F.col("source_class"), classes), (F.col("source_item"), items), (year, years)):
        if wanted is not None:
            named = named.filter(column.isin([str(x) for x in wanted]))
    return named


def _directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The CSV members of each archive, by the directory at its end; or one row with a status."""
    for batch in batches:
        rows = []
        for path, size in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            try:
                with stores.opened(path) as file, zipfile.ZipFile(file) as archive:
                    found = [(i.filename, i.file_size) for i in archive.infolist() if i.filename.lower().endswith(".csv")]
                rows += [(path, size, name, length, None) for name, length in sorted(found)] or [(path, size, None, 0, "no_csv")]
            except _DAMAGED:
                rows.append((path, size, None, 0, "corrupt"))
            except OSError:
                rows.append((path, size, None, 0, "unreadable"))
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays(columns, ["path", "bytes", "member", "size", "status"])


def members(files: DataFrame) -> DataFrame:
    """path, bytes, member, size (decompressed), status: the CSV members of archive_files; a status where there are none."""
    return files.select("path", "bytes").mapInArrow(_directories, _MEMBERS)


def _encoding(open_member: Callable[[], BinaryIO]) -> str | None:
    """The first encoding in which the whole member can be read."""
    for encoding in ENCODINGS:
        decoder = codecs.getincrementaldecoder(encoding)()
        try:
            with open_member() as raw:
                while chunk := raw.read(1 << 20):
                    decoder.decode(chunk)
            decoder.decode(b"", final=True)
        except UnicodeDecodeError:
            continue
        return encoding
    return None


def _lines(open_member: Callable[[], BinaryIO], encoding: str) -> Iterator[list[str]]:
    """The header, and every line that isn't blank."""
    with io.TextIOWrapper(open_member(), encoding=encoding, newline="") as text:
        for k, row in enumerate(csv.reader(text, strict=True)):
            if row or not k:
                yield row


def _examined(open_member: Callable[[], BinaryIO]) -> tuple[str, str | None]:
    """What the member is (ok, or why it is rejected) and its encoding."""
    encoding = _encoding(open_member)
    if encoding is None:
        return "undecodable", None
    n, dated = 0, False
    try:
        for row in _lines(open_member, encoding):
            if len(row) != len(RAW_COLUMNS):
                return "wrong_columns", encoding
            dated |= n > 0 and row[_DATE] not in ("", " ")
            n += 1
    except csv.Error:
        return "malformed", encoding
    return "wrong_columns" if not n else "empty" if n == 1 else "ok" if dated else "undated", encoding


def _rows(open_member: Callable[[], BinaryIO]) -> Iterator[tuple[str, list[list[str]]]]:
    """(status, rows) in slices; a rejected member gives one status without rows."""
    status, encoding = _examined(open_member)
    if status != "ok":
        yield status, []
        return
    part: list[list[str]] = []
    lines = _lines(open_member, encoding or "")
    next(lines)
    for row in lines:
        part.append(row)
        if len(part) == _SLICE:
            yield "ok", part
            part = []
    if part:
        yield "ok", part


def _plain(raw: bytes) -> pa.Table | None:
    """The kept columns of a held member in which nothing is quoted and all is as it should be; None if _rows has to tell what it is."""
    for encoding in ENCODINGS:
        try:
            text = raw.decode(encoding)
        except UnicodeDecodeError:
            continue
        break
    else:
        return None
    content = text.encode()
    ends = np.flatnonzero(np.frombuffer(content, np.uint8) == 10)
    longest = np.diff(ends, prepend=-1, append=len(content)).max()
    odd = b'"' in content or b"\0" in content or content.count(b"\r") != content.count(b"\r\n") or longest > csv.field_size_limit()
    if odd or not len(ends) or content[: ends[0]].count(b",") != len(RAW_COLUMNS) - 1:
        return None
    names = [c or f"_{i}" for i, c in enumerate(RAW_COLUMNS)]
    kept = [c for _, c in _KEPT]
    try:
        found = arrow_csv.read_csv(
            pa.BufferReader(content),
            arrow_csv.ReadOptions(use_threads=False, block_size=len(content) + 1, skip_rows=1, column_names=names),
            arrow_csv.ParseOptions(quote_char=False),
            arrow_csv.ConvertOptions(include_columns=kept, column_types=dict.fromkeys(kept, pa.string()), null_values=["", " "], strings_can_be_null=True),
        )
    except pa.ArrowInvalid:
        return None
    return found if found.column("correction_date").null_count < found.num_rows else None


_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


def _batch(path: str, size: int, member: str | None, status: str, first: int, n: int, cells: list[pa.Array]) -> pa.RecordBatch:
    about = [pa.repeat(pa.scalar(x, t), n) for x, t in ((path, pa.string()), (size, pa.int64()), (member, pa.string()), (status, pa.string()))]
    return pa.RecordBatch.from_arrays([*about, pa.array(np.arange(first, first + n)), *cells], _NAMES)


def _rejected(path: str, size: int, member: str | None, status: str, first: int = 0) -> pa.RecordBatch:
    return _batch(path, size, member, status, first, 1, [pa.nulls(1, pa.string())] * len(_KEPT))


def _parts(open_member: Callable[[], BinaryIO], raw: bytes | None) -> Iterator[tuple[str, int, list[pa.Array]]]:
    """(status, rows, columns) in slices; a rejected member gives one status without rows. raw: its bytes, if they are held."""
    found = None if raw is None else _plain(raw)
    if found is None:
        for status, rows in _rows(open_member):
            yield status, len(rows), [pa.array([(r[i] if r[i] not in ("", " ") else None) for r in rows], pa.string()) for i, _ in _KEPT]
        return
    for k in range(0, found.num_rows, _SLICE):
        part = found.slice(k, _SLICE)
        yield "ok", part.num_rows, [c.combine_chunks() for c in part.columns]


def _read_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of members; members of one archive that follow each other share its directory."""
    held: tuple[str, zipfile.ZipFile] | None = None
    for batch in batches:
        for listed in batch.to_pylist():
            path, size, member = listed["path"], listed["bytes"], listed["member"]
            if listed["status"]:
                yield _rejected(path, size, None, listed["status"])
                continue
            first = 0
            try:
                if held is None or held[0] != path:
                    held = (path, zipfile.ZipFile(stores.opened(path)))
                archive = held[1]
                raw = archive.read(member) if listed["size"] <= HELD_BYTES else None
                open_member = lambda archive=archive, member=member, raw=raw: archive.open(member) if raw is None else io.BytesIO(raw)
                for status, n, cells in _parts(open_member, raw):
                    yield _batch(path, size, member, status, first, n, cells) if n else _rejected(path, size, member, status, first)
                    first += n
            except _DAMAGED:
                yield _rejected(path, size, member, "corrupt", first)
            except OSError:
                yield _rejected(path, size, member, "unreadable", first)


def read_archives(
    spark: SparkSession, path: str, classes: Sequence[str] | None = None, items: Sequence[str] | None = None, years: Sequence[int] | None = None,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Rows of all ZIP files under path (status ok) and one row for each file or member that is rejected.

    classes, items, years: only these archives are opened at all. part_bytes: decompressed bytes for a task.
    """
    listed = members(archive_files(spark, path, classes, items, years))
    size = listed.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    n = max(1, min(math.ceil((size["bytes"] or 0) / part_bytes), size["rows"]))
    found = listed.repartition(n, "path", "member").sortWithinPartitions("path", "member").mapInArrow(_read_members, _SCHEMA)
    parts = F.split("path", "/")
    return found.withColumns({"source_item": F.element_at(parts, -2), "source_class": F.element_at(parts, -3)})


def measurements(found: DataFrame) -> DataFrame:
    return found.filter("status = 'ok'").drop("status", "bytes")


def file_audit(found: DataFrame) -> DataFrame:
    """path, member, status, rows: each file or member once, in order."""
    rows = F.count_if(F.col("status") == "ok").alias("rows")
    return found.groupBy("path", "member", "status").agg(rows).orderBy("path", F.col("member").asc_nulls_first())


def status_counts(audit: DataFrame) -> DataFrame:
    """status, files (or members): of file_audit or of a state of downloads."""
    return audit.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def inventory(spark: SparkSession, path: str, **only: Sequence) -> DataFrame:
    """source_class, source_item, zips, csvs, bytes of the archives under path, with totals (nulls). Only directories are read.

    only: classes, items, years, as for read_archives.
    """
    files = members(archive_files(spark, path, **only)).groupBy("path", F.col("bytes").alias("length")).agg(F.count("member").alias("csvs"))
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -3).alias("source_class"), F.element_at(parts, -2).alias("source_item"), "length", "csvs")
    return rolled_up(named, F.sum("csvs").alias("csvs"), F.sum("length").alias("bytes"))


def rolled_up(files: DataFrame, *sums: Column) -> DataFrame:
    """zips and sums of each class and item, of each class, and of all (nulls)."""
    return files.rollup("source_class", "source_item").agg(F.count(F.lit(1)).alias("zips"), *sums)


def catalog(spark: SparkSession, path: str, content_code: int = 1) -> DataFrame:
    """Items of a saved catalog (JSON with a data list) that hold measurements."""
    raw = spark.read.option("multiLine", True).json(path)
    if "data" not in raw.columns:
        raise ValueError("the catalog has no data key")
    return raw.select(F.explode("data").alias("item")).select("item.*").filter(F.col("content_code") == content_code)


#: Folder names of item classes.
CLASS_NAMES = {
    2: "02_drive_survey",
    3: "03_walk_survey",
    4: "04_survey_meter",
    45: "45_airborne_monitoring",
    50: "50_background",
    60: "60_monitoring_post",
    78: "78_other",
}


def task_list(items: DataFrame, first_year: int = 2011, last_year: int = 2024) -> DataFrame:
    """item_code, class_code, fiscal_year, output_path for each item and year."""
    names = F.create_map(*[x for k, v in CLASS_NAMES.items() for x in (F.lit(k), F.lit(v))])
    folder = F.coalesce(F.element_at(names, F.col("class_code").cast("int")), F.format_string("%02d_unknown", F.col("class_code").cast("int")))
    years = items.withColumn("fiscal_year", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))))
    path = F.format_string("dataset/%s/item_%03d/%d.zip", folder, F.col("item_code").cast("int"), F.col("fiscal_year"))
    return years.select("item_code", "class_code", "fiscal_year", path.alias("output_path"))


def open_tasks(tasks: DataFrame, state: DataFrame) -> DataFrame:
    """Tasks that are neither completed nor skipped; failed ones are tried again.

    Both sides are sorted by path: a state holds a row for each task that ever ran, far more than the size of
    the items that it comes from tells, so it isn't broadcast or held by a task.
    """
    done = state.filter(F.col("status").isin("completed", "skipped_empty")).select("output_path")
    return tasks.join(done.hint("merge"), "output_path", "left_anti")


def record_state(updates: DataFrame, path: str) -> None:
    """Adds what became of tasks (output_path, status, error) to the state under path, by a commit: all of it or nothing."""
    download.store(updates, path)


def current_state(spark: SparkSession, path: str) -> DataFrame:
    """output_path, status, reason, error: the last entry of each task in the commits under path; none if there is no state yet."""
    last = download.recorded(spark, path).groupBy("output_path").agg(F.max(F.struct("at", "status", "reason", "error")).alias("last"))
    return last.select("output_path", "last.status", "last.reason", "last.error")


def manifest(items: DataFrame, state: DataFrame) -> dict:
    """Counts of a download: items, files by status, and those that failed."""
    files = {r["status"]: r["files"] for r in status_counts(state).collect()}
    counts = {f"files_{n}": files.get(n, 0) for n in ("completed", "skipped_empty", "failed")}
    at = datetime.now(UTC).isoformat(timespec="seconds")
    return {"downloaded_at": at, "encoding": "UTF-8", "content_code": 1, "items_downloaded": items.count()} | counts
