"""WARC derivative builder: metadata and plain-text conversion records from response records.

Response records are read from WARC files (plain or gzip) or built from a table of fetched pages, and
are parsed as they stand: WARC fields and HTTP fields in order, repeated names included. Each response
gives a metadata record (its HTTP fields, title, links) and a conversion record (its text). Both refer to
the response by its record id and repeat its target, date and payload digest; their own ids are made from
the response's, so that a rerun gives the same records. The records can be written as WARC files.

Results for odd input: a null or empty payload gives an empty conversion record and metadata without
links. A null url gives records without a target. Repeated rows of pages are separate responses with ids
of their own. A record that is no response, or has no complete header, gives nothing. Extra columns are
ignored unless they are asked for; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.llm.common import cut, fresh, with_possible

#: The date of pages without one of their own.
DATE = "2024-01-01T00:00:00Z"
_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|br|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|footer|header|title|blockquote|pre)\b[^>]*>", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>?")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CHARSET = re.compile(r"charset\s*=\s*\"?([\w.:-]+)", re.I)
#: Bytes of records that are sent at a time.
_BATCH = 8 << 20
Fields = list[tuple[str, str]]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def plain_text(page: str) -> str:
    """The text of a page: a line for each block, runs of spaces as one, entities resolved, scripts left out."""
    page = _TAG.sub("", _BREAK.sub("\n", _DROPPED.sub(" ", page)))
    lines = (" ".join(line.split()) for line in html.unescape(page).split("\n"))
    return "\n".join(line for line in lines if line)


def links(page: str, base: str) -> list[str]:
    found = []
    for quoted, single, bare in _LINK.findall(_DROPPED.sub(" ", page)):
        try:
            found.append(urljoin(base, html.unescape(quoted or single or bare).strip()))
        except ValueError:  # not a URL
            continue
    return found


def first(fields: Fields, name: str) -> str | None:
    return next((v for k, v in fields if k.lower() == name.lower()), None)


def serialise(fields: Fields, block: bytes) -> bytes:
    """A record; line breaks in values are spaces."""
    lines = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _fields(head: bytes) -> tuple[str, Fields]:
    """First line, and the fields in order; a line that begins with a blank goes on with the one before."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    found: Fields = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and found:
            found[-1] = (found[-1][0], f"{found[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            found.append((name.strip(), value.strip()))
    return lines[0], found


def parse(record: bytes) -> tuple[Fields, bytes] | None:
    """Fields and block of one record; None if its header isn't complete."""
    head, end, rest = record.partition(b"\r\n\r\n")
    start, fields = _fields(head)
    length = first(fields, "Content-Length") or ""
    if not end or not start.startswith("WARC/") or not length.isdigit():
        return None
    return fields, rest[: int(length)]


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body  # not chunked after all
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def http_message(block: bytes) -> tuple[str, Fields, bytes]:
    """Status line, fields and payload (as it was sent, without transfer coding) of a response's block."""
    head, _, body = block.partition(b"\r\n\r\n")
    status, fields = _fields(head)
    return status, fields, _unchunked(body) if "chunked" in (first(fields, "Transfer-Encoding") or "").lower() else body


def page_of(fields: Fields, payload: bytes) -> str:
    """The payload as text: content coding undone, in the character set that it states (UTF-8 without one)."""
    if "gzip" in (first(fields, "Content-Encoding") or "").lower():
        try:
            payload = zlib.decompress(payload, 47)
        except zlib.error:
            payload = b""
    charset = _CHARSET.search(first(fields, "Content-Type") or "")
    try:
        return payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _split(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a WARC file's bytes, one at a time."""
    held, at = b"", 0
    for chunk in chunks:
        held, at = held[at:] + chunk, 0
        while (begin := held.find(b"WARC/", at)) >= 0 and (end := held.find(b"\r\n\r\n", begin)) >= 0:
            length = first(_fields(held[begin:end])[1], "Content-Length") or ""
            stop = end + 4 + (int(length) if length.isdigit() else 0)
            if len(held) < stop:
                break
            yield held[begin:stop]
            at = stop


def _inflated(content: bytes) -> Iterator[bytes]:
    """Bytes of a file piece by piece; gzip members follow each other."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = member.decompress(content, 1 << 20)
            content = member.unconsumed_tail
            if not piece and not content:
                break
            yield piece
        content = member.unused_data


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path, record: the response records of all WARC files under path (each below 2 GB, as Spark reads them whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                held, size = [], 0
                for record in _split(_inflated(content.as_buffer().to_pybytes())):
                    parsed = parse(record)
                    if parsed and first(parsed[0], "WARC-Type") == "response":
                        held.append(record)
                        size += len(record)
                    if size > _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array(held, pa.binary())], ["path", "record"])
                        held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.string()), pa.array(held, pa.binary())], ["path", "record"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.warc{,.gz}").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, record binary")


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """The records (UTF-8) as WARC files: a record's end is what ends a line here."""
    end = F.length(F.col("record").cast("string")) - 4
    records.select(F.substring(F.col("record").cast("string"), F.lit(1), end).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html", date: str = DATE) -> DataFrame:
    """page_id, record: pages as response records, fetched at date."""
    chosen = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(body).alias("body"))
    key, flag = fresh(chosen, "key", "flag")
    keyed = chosen.withColumn(key, F.xxhash64("page_id", "url", "body"))
    # Rows that may be repeated are counted as groups, then told apart by a number; all others aren't shuffled.
    repeated = cut(keyed.groupBy(key).count().filter("count > 1").select(key))
    marked = with_possible(keyed, repeated, key, flag)
    single = marked.filter(~F.col(flag)).select("page_id", "url", "body", F.lit(0).cast("long").alias("copy"))
    grouped = marked.filter(F.col(flag)).groupBy("page_id", "url", "body").agg(F.count(F.lit(1)).alias("n"))
    numbered = grouped.select("page_id", "url", "body", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = []
            for i, link, page, copy in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "body", "copy")], strict=True):
                payload = (page or "").encode()
                name = record_id("response", str(i), link or "", digest(payload), *([str(copy)] if copy else []))
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                fields = [("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Date", date), *([("WARC-Target-URI", link)] if link is not None else [])]
                fields += [("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response")]
                records.append(serialise(fields, head.encode() + payload))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(records, pa.binary())], ["page_id", "record"])

    return single.unionByName(numbered).mapInArrow(run, "page_id long, record binary")


def _derived(record: bytes) -> list[tuple]:
    """type, record_id, refers_to, target, payload_digest, block_digest, length, record of both derivatives."""
    parsed = parse(record)
    if not parsed or first(parsed[0], "WARC-Type") != "response":
        return []
    fields, block = parsed
    status, http, payload = http_message(block)
    page = page_of(http, payload)
    refers_to, target, date = (first(fields, n) for n in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date"))
    source = first(fields, "WARC-Payload-Digest") or digest(payload)
    title = _TITLE.search(page)
    about = {"status": status, "http": http, "title": " ".join(html.unescape(_TAG.sub("", title[1])).split()) if title else None, "links": links(page, target or "")}
    blocks = (("metadata", "application/json", json.dumps(about, ensure_ascii=False)), ("conversion", "text/plain; charset=utf-8", plain_text(page)))
    rows = []
    for kind, media, text in blocks:
        made = text.encode("utf-8", "replace")
        own = record_id(kind, refers_to or digest(record))
        out = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", refers_to), ("WARC-Target-URI", target), ("WARC-Date", date)]
        out += [("WARC-Payload-Digest", source), ("WARC-Block-Digest", digest(made)), ("Content-Type", media)]
        rows.append((kind, own, refers_to, target, source, digest(made), len(made), serialise([(k, v) for k, v in out if v is not None], made)))
    return rows


def derive(found: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Two records for each response in the column record: the columns in keep, type, record_id, refers_to, target,
    payload_digest (the response's own, computed where it states none), block_digest, length, record (bytes)."""
    names = ["type", "record_id", "refers_to", "target", "payload_digest", "block_digest", "length", "record"]
    kinds = [*[pa.string()] * 6, pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owner = [], []
            for i, record in enumerate(batch.column("record")):
                made = _derived(record.as_py() or b"")
                rows += made
                owner += [i] * len(made)
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            kept = [batch.column(c).take(pa.array(owner, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], [*keep, *names])

    schema = found.select(*keep).schema
    for name in names:
        schema = schema.add(name, "long" if name == "length" else "binary" if name == "record" else "string")
    return found.select(*keep, "record").mapInArrow(run, schema)
