"""Line dedup: hashes range-partitioned and sorted by document and position, streamed once.

Lines are hashed to 128 bits (their text stays where it is), range-partitioned by (hash, document,
position) and sorted. A run of equal lines that is longer than a partition goes over several; the few
runs that touch a partition's ends are completed by a summary of two rows per partition. The stream
gives the positions that go, and these come back per document as a compressed bitmap of what stays.

Results for odd input: null and empty texts are one empty line. A document is a pair of doc_id (which
may be null) and text: repeated rows are one document and get the same result. Lines whose key is
shorter than min_chars are never dropped and count nowhere. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.llm.common import ascii_lower, cut, partitions, row_key, text_or_empty

FREQUENT, REPEATED = "frequent", "repeated"


#: What is stripped from the ends of a line: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "doc", "text_hash", "pos", "part"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last run of the partition: hash, number of documents, first and last document."""
    open_run, done, part = None, [], None
    for h1, h2, doc, text, pos, parts in _runs(batches):
        part = int(parts[0])
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], len(h1))
        for i, j in sorted({(int(starts[0]), int(stops[0])), (int(starts[-1]), int(stops[-1]))}):
            first, last = (doc[i], text[i]), (doc[j - 1], text[j - 1])
            changes = 1 + int(np.count_nonzero((doc[i + 1 : j] != doc[i : j - 1]) | (text[i + 1 : j] != text[i : j - 1])))
            run = [int(h1[i]), int(h2[i]), changes, first, last]
            if open_run and i == 0 and open_run[:2] == run[:2]:
                open_run[2] += changes - (open_run[4] == first)
                open_run[4] = last
            elif open_run is None or i == starts[-1]:
                if open_run and not done:
                    done.append(open_run)
                open_run = run
    if open_run:
        rows = done + [open_run]
        columns = [[part] * len(rows), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]]
        columns += [[int(r[k][m]) for r in rows] for k in (3, 4) for m in (0, 1)]
        names = ["part", "h1", "h2", "n_docs", "first_doc", "first_text", "last_doc", "last_text"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _totals(rows: list) -> tuple[dict, dict]:
    """Documents of each run that touches an end of a partition; which partitions go on with an earlier run, and its last document."""
    totals: dict[tuple[int, int], int] = {}
    before: dict[tuple[int, int, int], tuple[int, int]] = {}
    last: dict[tuple[int, int], tuple[int, int]] = {}
    for r in rows:
        key, first = (r["h1"], r["h2"]), (r["first_doc"], r["first_text"])
        if key in last:
            before[(r["part"], *key)] = last[key]
        totals[key] = totals.get(key, 0) + r["n_docs"] - (last.get(key) == first)
        last[key] = (r["last_doc"], r["last_text"])
    return totals, before


def _stream(policy: str, min_docs: int, totals: dict, before: dict):
    """The rows that go. Of an undecided run at a batch's end only rows of fewer than min_docs documents are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        held_docs = 0
        seen = False  # the run that is open has had a row (or, where many documents are asked for, is sure to go)

        def out(rows: tuple[np.ndarray, ...], keep: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[k][keep].astype(np.int64)) for k in (2, 3, 4)], ["doc", "text_hash", "pos"])

        open_key = None
        last_row, last_new = None, True
        for rows in _runs(batches):
            if policy == REPEATED:
                h1, h2, part = rows[0], rows[1], int(rows[5][0])
                new = np.ones(len(h1), bool)
                new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                first = (int(h1[0]), int(h2[0]))
                if open_key == first or (open_key is None and (part, *first) in before):
                    new[0] = False
                open_key = (int(h1[-1]), int(h2[-1]))
                # A line of a repeated row (they are next to each other, in one partition) fares as its first copy.
                same = np.append(last_row == tuple(int(x[0]) for x in rows[:5]), np.all([x[1:] == x[:-1] for x in rows[:5]], axis=0))
                own = np.maximum.accumulate(np.where(same, -1, np.arange(len(h1))))
                new = np.where(own >= 0, new[own], last_new)
                last_row, last_new = tuple(int(x[-1]) for x in rows[:5]), bool(new[-1])
                yield out(rows, ~new)
                continue
            if held and open_key == (int(rows[0][0]), int(rows[1][0])) == (int(rows[0][-1]), int(rows[1][-1])):
                # All of the batch goes on with a run that isn't decided: it is only put by, however long the run gets.
                docs = np.stack([np.append(held[-1][k][-1], rows[k]) for k in (2, 3)])
                held_docs += int(np.count_nonzero(np.any(docs[:, 1:] != docs[:, :-1], axis=0)))
                held.append(rows)
                if held_docs < min_docs:
                    continue
                rows, held = held[-1], held[:-1]
            if held:
                rows = tuple(np.concatenate(parts) for parts in zip(*held, rows, strict=True))
            h1, h2, doc, text = rows[:4]
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_doc = new.copy()
            new_doc[1:] |= (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
            starts = np.flatnonzero(new)
            docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            for at in {0, len(starts) - 1}:
                docs[at] = max(docs[at], totals.get((int(h1[starts[at]]), int(h2[starts[at]])), 0))
            if seen and open_key == (int(h1[0]), int(h2[0])):
                docs[0] = min_docs
            sure = bool(docs[-1] >= min_docs)
            length = np.diff(np.append(starts, len(h1)))
            drop = np.repeat(docs >= min_docs, length)
            held = [] if sure else [tuple(x[starts[-1] :].copy() for x in rows)]
            held_docs = int(docs[-1])
            open_key, seen = (int(h1[-1]), int(h2[-1])), sure
            yield out(rows, drop)

    return run


def _bitmap(positions: np.ndarray, n_lines: int) -> bytes:
    keep = np.ones(n_lines, np.uint8)
    keep[positions] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def keep_bitmaps(
    docs: DataFrame,
    policy: str = REPEATED,
    min_docs: int = 2,
    min_chars: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, text_hash, n_lines, n_dropped, keep (zlib of a bit per line, 1: stays) for every document that loses lines.

    policy: REPEATED keeps the first occurrence of a line in order of document and position;
    FREQUENT drops every occurrence of lines that are in min_docs documents or more.
    """
    if policy not in (FREQUENT, REPEATED):
        raise ValueError(f"policy is {FREQUENT} or {REPEATED}")
    spark = docs.sparkSession
    named = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("text_hash"), text_or_empty(text).alias("text"))
    # Whole texts are lower-cased, once, before they are split.
    lines = F.split(ascii_lower(F.col("text")), "\n", -1)
    keys = named.select(
        F.coalesce(F.col("doc_id"), F.lit(0)).alias("doc"), "text_hash", F.posexplode(lines).alias("pos", "line")
    ).withColumn("key", F.btrim(F.col("line"), F.lit(BLANKS)))
    hashed = keys.filter(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "doc", "text_hash", F.col("pos").cast("long").alias("pos")
    )
    order = ["h1", "h2", "doc", "text_hash", "pos"]
    placed = hashed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("part", F.spark_partition_id().cast("long")))
    # Two rows per partition at most, however many lines there are.
    ends = placed.mapInArrow(_ends, "part long, h1 long, h2 long, n_docs long, first_doc long, first_text long, last_doc long, last_text long")
    totals, before = _totals(sorted(ends.collect(), key=lambda r: (r["part"], r["h1"], r["h2"])))
    dropped = placed.mapInArrow(_stream(policy, min_docs, totals, before), "doc long, text_hash long, pos long").dropDuplicates()
    marked = dropped.groupBy("doc", "text_hash").agg(F.collect_list("pos").alias("positions"))
    counted = named.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("doc"), "text_hash", F.size(F.split("text", "\n", -1)).alias("n_lines")).dropDuplicates()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            positions, n = batch.column("positions"), batch.column("n_lines").to_pylist()
            bits = [_bitmap(np.asarray(positions[i].values), n[i]) for i in range(batch.num_rows)]
            lost = pa.array([len(p) for p in positions], pa.int64())
            arrays = [batch.column("doc_id"), batch.column("text_hash"), batch.column("n_lines").cast(pa.int64()), lost, pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "n_lines", "n_dropped", "keep"])

    both = counted.join(marked, ["doc", "text_hash"]).select("doc_id", "text_hash", "n_lines", "positions")
    return both.mapInArrow(pack, "doc_id long, text_hash long, n_lines long, n_dropped long, keep binary")


def unpack(keep: bytes, n_lines: int) -> np.ndarray:
    """Which lines stay, as booleans."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).astype(bool)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for each row of docs; those without a bitmap keep all their lines."""
    named = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("text_hash"), text_or_empty(text).alias("text"))
    bits = bitmaps.select(F.col("doc_id").alias("b_id"), F.col("text_hash").alias("b_hash"), "n_dropped", "keep")
    joined = named.join(bits, named["doc_id"].eqNullSafe(bits["b_id"]) & (named["text_hash"] == bits["b_hash"]), "left")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, count = [], []
            for text, keep in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), strict=True):
                lines = text.split("\n")
                count.append(len(lines))
                if keep is None:
                    kept.append(text)
                else:
                    stays = unpack(keep, len(lines))
                    kept.append("\n".join([line for line, stay in zip(lines, stays, strict=True) if stay]))
            dropped = batch.column("n_dropped").fill_null(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), dropped, pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])

    return joined.select("doc_id", "text", "n_dropped", "keep").mapInArrow(rest, "doc_id long, n_lines long, n_dropped long, kept_text string")
