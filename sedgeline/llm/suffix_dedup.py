"""Suffix-array dedup on sparse suffixes.

Of each text only the suffixes at minimisers are kept: in every run of WINDOW word positions the one
whose next words hash least, so that equal passages keep equal suffixes. A suffix is written as a code of
one byte for each of its first LENGTH words, then for the words before it, read backwards, then its place:
sorting these bytes, over range partitions, is sorting suffixes by content. Neighbours are compared word
by word; runs of those that share the words that a common minimiser leaves to the right are extended to
the left and right until LENGTH words agree. A run that touches an end of a partition also sends one place
of each of its passages to a count over all partitions, and so does each piece of a run that is too long to
be held.

Codes only find candidates. The whole words of each candidate passage are then hashed from the texts that
have any, and passages that are nowhere else go: so results don't depend on codes, only on 64-bit hashes
of passages.

Results for odd input: null and short texts have no passages. A document is a pair of doc_id (which
may be null) and text; repeated rows are one document. A passage that a document repeats itself counts
as repeated. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.llm.blocks import ASCII_LOWER, hashes, mix, slices, windows, words
from sedgeline.llm.common import cut, partitions, row_key, with_possible

#: Words of a passage, all of which must be equal.
LENGTH = 50
#: Word positions of which one is kept.
WINDOW = 42
_GRAM = 8
#: Words that a passage surely has from its minimiser on.
SHARED = LENGTH - WINDOW + 1
_LEFT = WINDOW - 1
_WIDTH = LENGTH + _LEFT
#: Bytes of a suffix after its codes: document (8), whether it has an id (1), text (8), position (4), words to the left and right (1 each).
_PLACE = np.dtype([("doc", ">i8"), ("has_id", "u1"), ("text", ">i8"), ("pos", ">u4"), ("left", "u1"), ("right", "u1")])
#: Suffixes that are compared at a time, and the runs that begin among them.
_BLOCK = 100_000
#: Suffixes of one run that are held at once; what a longer run has goes on as if in another partition.
_MOST = 2 * _BLOCK


def minimisers(word: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions (in word) of the suffixes that are kept, ascending."""
    n = len(word)
    if n < LENGTH:
        return np.empty(0, np.int64)
    gram = np.zeros(n, np.uint64)
    for k in range(_GRAM):
        gram[: n - k] = mix(gram[: n - k] + word[k:] + np.uint64(k + 1))
    least = ((gram >> np.uint64(32)) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    width = 1
    while width * 2 <= WINDOW:
        least[:-width] = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = WINDOW - width
    least[: n - rest] = np.minimum(least[: n - rest], least[rest:])
    first = np.cumsum(counts) - counts
    starts = np.repeat(first + counts - LENGTH, counts) >= np.arange(n)
    return np.unique(least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """suffix: codes and place of each kept suffix."""
    for batch in batches:
        doc, text = batch.column("doc_id"), batch.column("text_hash").to_numpy()
        has_id, doc = np.asarray(doc.is_valid()), doc.fill_null(0).to_numpy()
        for first, _end, data, rows in slices(batch.column("text")):
            lower = ASCII_LOWER[data]
            starts, ends, counts = words(lower, rows)
            word = hashes(lower, starts, ends)
            at = minimisers(word, counts)
            if not len(at):
                continue
            begin = np.cumsum(counts) - counts
            row = np.searchsorted(begin + counts, at, "right")
            left, right = np.minimum(at - begin[row], _LEFT), np.minimum((begin + counts)[row] - at, LENGTH)
            code = (word >> np.uint64(56)).astype(np.uint8)
            out = np.zeros((len(at), _WIDTH + _PLACE.itemsize), np.uint8)
            for k in range(LENGTH):
                out[:, k] = np.where(right > k, code[np.minimum(at + k, len(code) - 1)], 0)
            for k in range(_LEFT):
                out[:, LENGTH + k] = np.where(left > k, code[np.maximum(at - 1 - k, 0)], 0)
            place = np.empty(len(at), _PLACE)
            owner = row + first
            place["doc"], place["has_id"], place["text"], place["pos"] = doc[owner], has_id[owner], text[owner], at - begin[row]
            place["left"], place["right"] = left, right
            out[:, _WIDTH:] = place.view(np.uint8).reshape(len(at), -1)
            blobs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(out.shape[1]), len(at), [None, pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([blobs.cast(pa.binary())], ["suffix"])


def _common(codes: np.ndarray) -> np.ndarray:
    """How many of their first LENGTH codes each suffix shares with the one before it (the first: none)."""
    shared = np.zeros(len(codes), np.int64)
    if len(codes) > 1:
        equal = codes[1:, :LENGTH] == codes[:-1, :LENGTH]
        shared[1:] = np.where(equal.all(axis=1), LENGTH, equal.argmin(axis=1))
    return shared


def _extended(codes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For suffixes in runs: whether the passage that begins a words to the left (column a) is also at another place;
    and per a the suffixes that stand for the passages, with the passages' names."""
    right, left = np.zeros((len(codes), LENGTH + 1), np.uint64), np.zeros((len(codes), WINDOW), np.uint64)
    for k in range(LENGTH):
        right[:, k + 1] = mix(right[:, k] + codes[:, k].astype(np.uint64) + np.uint64(k + 1))
    for k in range(_LEFT):
        left[:, k + 1] = mix(left[:, k] + codes[:, LENGTH + k].astype(np.uint64) + np.uint64(k + 1))
    text = place["text"].astype(np.int64).view(np.uint64) ^ mix(place["doc"].astype(np.int64).view(np.uint64) + place["has_id"].astype(np.uint64))
    where = mix(text + place["pos"].astype(np.uint64))
    again, first = np.zeros((len(codes), WINDOW), bool), []
    for a in range(WINDOW):
        fits = np.flatnonzero((place["left"] >= a) & (place["right"] >= LENGTH - a))
        if not len(fits):
            continue
        passage = mix(right[fits, LENGTH - a] ^ mix(left[fits, a] + np.uint64(a)))
        order = np.argsort(passage, kind="stable")
        p, w = passage[order], where[fits][order]
        start = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        # Repeated rows share their places.
        several = np.minimum.reduceat(w, start) != np.maximum.reduceat(w, start)
        again[fits[order], a] = np.repeat(several, np.diff(np.append(start, len(p))))
        first.append((fits[order[start]], np.full(len(start), a), p[start]))
    return again, first


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one sorted partition: first and last start of candidate passages (passage null), and passages of its first and last run, which may go on elsewhere."""
    held: list[np.ndarray] = []
    rows, open_start, limit = 0, True, _BLOCK

    def out(block: np.ndarray, at_start: bool, at_end: bool) -> pa.RecordBatch:
        codes, place = block[:, :_WIDTH], np.ascontiguousarray(block[:, _WIDTH:]).view(_PLACE).ravel()
        run = np.cumsum(_common(codes) < SHARED)
        open_run = (at_start & (run == run[0])) | (at_end & (run == run[-1]))
        several = np.bincount(run)[run] > 1
        kept = np.flatnonzero(several | open_run)
        codes, place, open_run = codes[kept], place[kept], open_run[kept]
        again, first = _extended(codes, place)
        edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1] - 1  # as many in each row, in order
        pos = place["pos"].astype(np.int64)
        sent = [(r[open_run[r]], a[open_run[r]], p[open_run[r]]) for r, a, p in first] if open_run.any() else []
        who = np.concatenate([row, *[r for r, _, _ in sent]])
        begin = np.concatenate([pos[row] - high, *[pos[r] - a for r, a, _ in sent]])
        last = np.concatenate([pos[row] - low, *[pos[r] - a for r, a, _ in sent]])
        passage = np.concatenate([np.zeros(len(row), np.uint64), *[p for _, _, p in sent]]).view(np.int64)
        doc = pa.array(place["doc"].astype(np.int64)[who], mask=place["has_id"][who] == 0)
        arrays = [doc, pa.array(place["text"].astype(np.int64)[who]), pa.array(begin), pa.array(last), pa.array(passage, mask=np.arange(len(who)) < len(row))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "first", "last", "passage"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.frombuffer(b"".join(batch.column("suffix").to_pylist()), np.uint8).reshape(batch.num_rows, -1))
        rows += batch.num_rows
        if rows < limit:
            continue
        block = np.concatenate(held)
        # All but the last run, which may go on.
        stop = int(np.flatnonzero(_common(block) < SHARED)[-1])
        if stop:
            yield out(block[:stop], open_start, False)
            open_start = False
        held, rows = [block[stop:]], len(block) - stop
        if rows >= _MOST:
            # One run, as of a passage that is nearly everywhere: its pieces meet again in the count of passages.
            yield out(block[stop:], True, True)
            held, rows, open_start = [], 0, True
        limit = min(max(_BLOCK, 2 * rows), _MOST)
    if rows:
        yield out(np.concatenate(held), open_start, True)


def _starts(ranges: list[tuple[int, int]]) -> np.ndarray:
    return np.unique(np.concatenate([np.arange(a, b + 1) for a, b in ranges]))


def _check(parts: int):
    """Packed hashes of the whole candidate passages, by part: in a slice of texts each once, with one of its places and whether it has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = [[(r["first"], r["last"]) for r in x] for x in batch.column("ranges").to_pylist()]
            doc, text = batch.column("doc_id"), batch.column("text_hash").to_numpy()
            has_id, doc = np.asarray(doc.is_valid()).astype(np.int64), doc.fill_null(0).to_numpy()
            for first, end, data, rows in slices(batch.column("text")):
                lower = ASCII_LOWER[data]
                starts, ends, counts = words(lower, rows)
                begin = np.cumsum(counts) - counts
                own = [_starts(ranges[i]) for i in range(first, end)]
                row = np.repeat(np.arange(first, end), [len(x) for x in own])
                start = np.concatenate(own)
                value = windows(hashes(lower, starts, ends), LENGTH)[begin[row - first] + start]
                order = np.argsort(value, kind="stable")
                new = np.flatnonzero(np.append(True, value[order][1:] != value[order][:-1]))
                several = np.diff(np.append(new, len(order))) > 1
                at = order[new]
                part = (value[at] % np.uint64(parts)).astype(np.int64)
                by_part = np.argsort(part, kind="stable")
                edges = np.flatnonzero(np.append(True, part[by_part][1:] != part[by_part][:-1]))
                packed = []
                for i, j in zip(edges, np.append(edges[1:], len(by_part)), strict=True):
                    mine = by_part[i:j]
                    docs, number = np.unique(row[at[mine]], return_inverse=True)
                    fields = [np.array([len(mine), len(docs)], np.int64), doc[docs], has_id[docs], text[docs], value[at[mine]], number.astype(np.uint32), start[at[mine]].astype(np.uint32), several[mine].astype(np.uint8)]
                    packed.append(b"".join(x.tobytes() for x in fields))
                yield pa.RecordBatch.from_arrays([pa.array(part[by_part][edges]), pa.array(packed, pa.binary())], ["part", "packed"])

    return run


def _single(table: pa.Table) -> pa.Table:
    """Places (doc_id, text_hash, start) of the passages of one part that are nowhere else."""
    found = []
    for blob in table.column("packed"):
        data = blob.as_buffer()
        n, n_docs = (int(x) for x in np.frombuffer(data, np.int64, 2))
        at, columns = 16, []
        for kind, size in ((np.int64, n_docs), (np.int64, n_docs), (np.int64, n_docs), (np.uint64, n), (np.uint32, n), (np.uint32, n), (np.uint8, n)):
            columns.append(np.frombuffer(data, kind, size, at))
            at += np.dtype(kind).itemsize * size
        doc, has_id, text, value, number, start, several = columns
        found.append((value, several, doc[number], has_id[number], text[number], start))
    if not found:
        return pa.table({"doc_id": pa.array([], pa.int64()), "text_hash": pa.array([], pa.int64()), "start": pa.array([], pa.int64())})
    value, several, doc, has_id, text, start = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(value, kind="stable")
    v = value[order]
    alone = np.append(True, v[1:] != v[:-1]) & np.append(v[1:] != v[:-1], True)
    i = order[alone & (several[order] == 0)]
    return pa.table({"doc_id": pa.array(doc[i], mask=has_id[i] == 0), "text_hash": pa.array(text[i]), "start": pa.array(start[i].astype(np.int64))})


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal runs of words that the starts (ranges without those in gone) cover."""
    for batch in batches:
        row, low, high = [], [], []
        for i, (ranges, gone) in enumerate(zip(batch.column("ranges").to_pylist(), batch.column("gone").to_pylist(), strict=True)):
            start = np.setdiff1d(_starts([(r["first"], r["last"]) for r in ranges]), np.array(gone or [], np.int64))
            if not len(start):
                continue
            apart = np.flatnonzero(np.diff(start) > LENGTH)
            row += [i] * (len(apart) + 1)
            low += start[np.append(0, apart + 1)].tolist()
            high += (start[np.append(apart, len(start) - 1)] + LENGTH).tolist()
        who = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(who), batch.column("text_hash").take(who), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["doc_id", "text_hash", "start", "end"])


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, start, end: maximal runs of words [start, end), each word of which is in a repeated passage."""
    parts = partitions(docs.sparkSession)
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(doc_id, text).alias("text_hash"), F.col(text).alias("text"))
    # The place ends the order: equal suffixes, however many, go over as many partitions as they need.
    dealt = named.mapInArrow(_suffixes, "suffix binary").repartitionByRange(parts, "suffix").sortWithinPartitions("suffix")
    found = cut(dealt.mapInArrow(_neighbours, "doc_id long, text_hash long, first long, last long, passage long"))
    open_ones = found.filter(F.col("passage").isNotNull()).distinct()
    again = open_ones.groupBy("passage").agg(F.count(F.lit(1)).alias("places")).filter("places > 1").select("passage")
    late = open_ones.join(again, "passage", "left_semi")
    starts = found.filter(F.col("passage").isNull()).unionByName(late).select("doc_id", "text_hash", "first", "last").distinct()
    ranges = cut(starts.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "last")).alias("ranges")))
    possible = with_possible(named, ranges.select("text_hash"), "text_hash", "possible").filter("possible").drop("possible")
    mine = ranges.select(F.col("doc_id").alias("r_doc"), F.col("text_hash").alias("r_text"), "ranges")
    both = possible.join(mine, (possible["text_hash"] == mine["r_text"]) & possible["doc_id"].eqNullSafe(mine["r_doc"]))
    checked = both.dropDuplicates(["text_hash", "doc_id"]).select("doc_id", "text_hash", "text", "ranges").mapInArrow(_check(parts), "part long, packed binary")
    alone = checked.groupBy("part").applyInArrow(_single, "doc_id long, text_hash long, start long")
    gone = alone.groupBy(F.col("doc_id").alias("g_doc"), F.col("text_hash").alias("g_text")).agg(F.collect_list("start").alias("gone"))
    left = ranges.join(gone, (ranges["text_hash"] == gone["g_text"]) & ranges["doc_id"].eqNullSafe(gone["g_doc"]), "left")
    return left.select("doc_id", "text_hash", "ranges", "gone").mapInArrow(_spans, "doc_id long, text_hash long, start long, end long")
