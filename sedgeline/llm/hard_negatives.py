"""Hard negatives by a pivot table over vectors whose inner product is turned into a distance.

A vector x gets one more component, sqrt(M - |x|^2), where M is the greatest squared length of all; an
anchor q gets 0. Then |q' - x'|^2 = |q|^2 + M - 2 q.x, so that near is high-scoring. A few rows of a
bounded sample are pivots, and every row's distances to them are stored. For an anchor, the triangle
inequality gives from these a bracket of each row's score; only rows whose bracket reaches what is still
looked for are scored, exactly, in integers.

Anchors and rows are dealt into blocks, and each pair of blocks is a task of bounded size: first the
anchors' best rows of their own label (positives), then for each positive's score the best rows of other
labels whose score is within a share of it (negatives). Each task returns as many rows as are asked for,
and these are ranked once more.

Results for odd input: a row with a null id, label or vector, or with a null or non-finite component,
takes no part. Vectors of fewer components than others are as if followed by zeros. Rows of one id are
never each other's positives; an anchor that repeats in id, label and vector counts once, other repeated
rows count as often as they are there. Equal scores are ranked by id. An anchor without a positive, and a
positive without a negative, give no rows. Vectors so long that a score may not fit a long number (2^62)
are an error. Without anchors, or for an empty table, the result is empty. Extra columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.llm.common import cut, partitions

PIVOTS = 8
#: Rows of the smallest hashes, of which the pivots are chosen.
SAMPLE = 1024
#: Bytes of the rows, and of the anchors, that one task holds.
BLOCK_BYTES = 16 << 20
#: Rows in a task at least, unless there are fewer.
BLOCK_ROWS = 256
#: Anchors and rows whose brackets and scores are worked out at once.
ANCHORS_AT_ONCE, ROWS_AT_ONCE = 256, 2048
_LARGEST = 2**62
_EXACT = 2**53  # integers up to this are exact as double
_SCHEMA = "anchor long, query long, score long, id long"
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vectors: DataFrame, is_anchor: Column, vec_id: str, label: str, embedding: str, scale: float) -> DataFrame:
    """id, label (as text), anchor and v (floor of scale * component) of the rows that take part."""
    finite = F.forall(F.col(embedding), lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(math.inf), F.lit(False)))
    rows = vectors.withColumn("__anchor", F.coalesce(is_anchor, F.lit(False)))
    rows = rows.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.coalesce(finite, F.lit(False)))
    scaled = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col("__anchor").alias("anchor"), scaled.alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix, zeros after the end of each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), flat.dtype)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _augmented(v: np.ndarray, most: float, anchors: bool = False) -> np.ndarray:
    v = v.astype(np.float64)
    extra = np.zeros(len(v)) if anchors else np.sqrt(np.maximum(most - (v * v).sum(1), 0.0))
    return np.column_stack([v, extra])


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((points - p) ** 2).sum(1)) for p in pivots], axis=1) if len(points) else np.zeros((0, len(pivots)))


def choose_pivots(sample: np.ndarray, number: int) -> np.ndarray:
    """Points of the sample that are far from each other, each the farthest from those before."""
    found = [sample[np.argmax(((sample - sample.mean(0)) ** 2).sum(1))]]
    least = ((sample - found[0]) ** 2).sum(1)
    while len(found) < min(number, len(sample)) and least.max() > 0:
        found.append(sample[np.argmax(least)])
        least = np.minimum(least, ((sample - found[-1]) ** 2).sum(1))
    return np.array(found)


class Best:
    """The k best (score, id) of each query, merged chunk by chunk. floor: the least score that counts, by query."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k = k
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: A row below this can't be among the best any more.
        self.least = floor.astype(np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        query, score, ident = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ident])
        order = np.lexsort((ident, -score, query))
        query, score, ident = query[order], score[order], ident[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        keep = place < self.k
        self.query, self.score, self.id = query[keep], score[keep], ident[keep]
        full = place == self.k - 1
        self.least[query[full]] = np.maximum(self.least[query[full]], score[full])


def _reach(lows: np.ndarray, highs: np.ndarray, at: np.ndarray, total: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of anchors (distances at, |q|^2 + M total) with rows of distances between lows and highs."""
    near, far = np.zeros((len(at), len(lows)), np.float32), np.full((len(at), len(lows)), np.inf, np.float32)
    for p in range(at.shape[1]):
        d = at[:, p, None]
        np.maximum(near, np.maximum(lows[None, :, p] - d, d - highs[None, :, p]), out=near)
        np.minimum(far, d + highs[None, :, p], out=far)
    total = total.astype(np.float32)[:, None]
    return (total - far * far) * 0.5 - slack, (total - near * near) * 0.5 + slack


class Block:
    """Rows of a block: sorted by label and nearest pivot, so that neighbours' distances to pivots are alike."""

    def __init__(self, table: pa.Table, width: int):
        pivots = len(table.column("d")[0]) if len(table) else 0
        d = _matrix(table.column("d"), pivots)
        label = table.column("label").to_pandas().to_numpy()
        order = np.lexsort((d.min(1), d.argmin(1), pd.factorize(label)[0])) if pivots else np.zeros(0, np.int64)
        self.id, self.label = table.column("id").to_numpy()[order], label[order]
        self.v, self.d = _matrix(table.column("v"), width)[order], d[order]
        self.pieces = [(i, min(i + ROWS_AT_ONCE, len(order))) for i in range(0, len(order), ROWS_AT_ONCE)]


def search(anchors: pa.Table, rows: pa.Table, space: dict, k: int, same_label: bool) -> pa.Table:
    """For each query of each anchor (a range of scores) the k best rows of the block, of its label or of others.

    anchors: anchor, id, label, v, low and high (lists: the ranges). space: width, most (M), pivots.
    """
    width, most, pivots = space["width"], space["most"], space["pivots"]
    block = Block(rows, width)
    exact, lowest = (np.float64, -np.inf) if most < _EXACT else (np.int64, np.iinfo(np.int64).min)
    out = [pa.table({c: pa.array([], pa.int64()) for c in ("anchor", "query", "score", "id")})]
    for start in range(0, len(anchors), ANCHORS_AT_ONCE):
        part = anchors.slice(start, ANCHORS_AT_ONCE).combine_chunks()
        v, ids, label = _matrix(part.column("v"), width), part.column("id").to_numpy(), part.column("label").to_pandas().to_numpy()
        counts = pc.list_value_length(part.column("low")).to_numpy()
        low, high = pc.list_flatten(part.column("low")).to_numpy(), pc.list_flatten(part.column("high")).to_numpy()
        owner = np.repeat(np.arange(len(part)), counts)
        best = Best(k, low)
        at = _distances(_augmented(v, most, anchors=True), pivots).astype(np.float32)
        total = (v.astype(np.float64) ** 2).sum(1) + most
        # Distances are of single precision, so that their squares (up to 2 * total) are off by 2^-21 of that at most.
        slack = 2.0 + float(total.max()) * 2.0**-18
        top = np.full(len(part), -np.inf)
        np.maximum.at(top, owner, high.astype(np.float64))
        for first, end in block.pieces:
            least = np.full(len(part), np.inf)
            np.minimum.at(least, owner, best.least.astype(np.float64))
            d, here = block.d[first:end], block.label[first:end]
            some = np.ones(len(part), bool)
            if same_label:
                some = np.isin(label, here)
            bottom, ceiling = _reach(d.min(0)[None], d.max(0)[None], at, total, slack)
            some = np.flatnonzero(some & (ceiling[:, 0] >= least) & (bottom[:, 0] <= top))
            if not len(some):
                continue
            bottom, ceiling = _reach(d, d, at[some], total[some], slack)
            wanted = (ceiling >= least[some, None]) & (bottom <= top[some, None])
            equal = label[some, None] == here[None]
            wanted &= (equal & (ids[some, None] != block.id[first:end][None])) if same_label else ~equal
            left, right = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
            if not len(left):
                continue
            score = v[some[left]].astype(exact) @ block.v[first + right].astype(exact).T
            score[~wanted[np.ix_(left, right)]] = lowest
            line = np.full(len(part), -1)
            line[some[left]] = np.arange(len(left))
            asked = np.flatnonzero(line[owner] >= 0)
            for q in range(0, len(asked), ANCHORS_AT_ONCE):
                these = asked[q : q + ANCHORS_AT_ONCE]
                s = score[line[owner[these]]]
                hit = (s >= best.least[these, None]) & (s <= high[these, None])
                if s.shape[1] > k and hit.sum() > 4 * k * len(these):
                    s[~hit] = lowest
                    hit &= s >= np.partition(s, -k, axis=1)[:, -k, None]
                query, row = np.nonzero(hit)
                best.add(these[query], s[query, row].astype(np.int64), block.id[first + right[row]])
        number = np.arange(len(owner)) - np.searchsorted(owner, owner)
        anchor = part.column("anchor").to_numpy()
        out.append(pa.table({"anchor": anchor[owner[best.query]], "query": number[best.query], "score": best.score, "id": best.id}))
    return pa.concat_tables(out)


def _best_of_blocks(anchors: DataFrame, rows: DataFrame, groups: int, parts: int, space: dict, k: int, same_label: bool) -> DataFrame:
    """anchor, query, score, id, rank: the k best of each query over all rows, by pairs of blocks."""
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    # Aliases, as the anchors are rows of the same table.
    own = [F.col(c).alias(c) for c in ("anchor", "id", "label", "v", "low", "high", "group")]
    asked = anchors.select(*own, every("part", parts)).groupBy("group", "part")
    dealt = rows.select("id", "label", "v", "d", every("group", groups), "part").groupBy("group", "part")
    found = asked.cogroup(dealt).applyInArrow(lambda left, right: search(left, right, space, k, same_label), _SCHEMA)
    order = Window.partitionBy("anchor", "query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _share(score: str, percent: int, up: bool) -> Column:
    """percent of a score, rounded up or down, without leaving the long numbers."""
    rest = F.pmod(F.col(score), F.lit(100))
    part = rest * F.lit(percent)
    part = F.ceil(part / 100) if up else F.floor(part / 100)
    return F.call_function("div", F.col(score) - rest, F.lit(100)) * F.lit(percent) + part


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256,
    vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor: which rows are anchors. positives, negatives: how many of each. low, high: percents of the
    positive's score within which a negative's must be. scale: components become floor(scale * x) first.
    """
    spark = vectors.sparkSession
    prepared = usable(vectors, is_anchor, vec_id, label, embedding, scale)
    length = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    stats = prepared.agg(F.max(length).alias("most"), F.max(F.size("v")).alias("width"), F.count(F.lit(1)).alias("rows")).first()
    if not stats["rows"]:
        return spark.createDataFrame([], _RESULT)
    if stats["most"] >= _LARGEST:
        raise ArithmeticError("scores of vectors this long may not fit a long number; use a smaller scale")
    width, most = max(1, int(stats["width"])), float(stats["most"])
    sample = prepared.select(F.xxhash64("id", "v").alias("draw"), "v").orderBy("draw").limit(SAMPLE).toArrow()
    pivots = choose_pivots(_augmented(_matrix(sample.column("v"), width), most), PIVOTS)
    space = {"width": width, "most": most, "pivots": pivots}

    def with_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_augmented(_matrix(batch.column("v"), width), most), pivots).astype(np.float32)
            ends = pa.array(np.arange(len(d) + 1, dtype=np.int32) * len(pivots))
            lists = pa.ListArray.from_arrays(ends, pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "d"])

    row_bytes = 4 * (width + len(pivots)) + 40
    parts = math.ceil(stats["rows"] * row_bytes / BLOCK_BYTES)
    parts = max(parts, min(2 * partitions(spark), math.ceil(stats["rows"] / BLOCK_ROWS)))
    # Which block a row is in doesn't matter to the result, and copies of one row are in many.
    place = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    whole = prepared.withColumn("v", F.col("v").cast("array<int>"))
    table = whole.mapInArrow(with_distances, "id long, label string, anchor boolean, v array<int>, d array<float>")
    table = cut(table.withColumn("part", place(parts)))
    anchors = cut(table.filter("anchor").select("id", "label", "v").distinct().withColumn("anchor", F.monotonically_increasing_id()))
    groups = max(1, math.ceil(anchors.count() * (row_bytes + 16 * positives) / BLOCK_BYTES))
    anchors = anchors.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int"))

    everything = anchors.withColumns({"low": F.array(F.lit(-_LARGEST)), "high": F.array(F.lit(_LARGEST))})
    own = _best_of_blocks(everything, table, groups, parts, space, positives, same_label=True)
    own = cut(own.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    ranges = own.withColumns({"low": _share("positive_score", low, up=True), "high": _share("positive_score", high, up=False)})
    scores = ranges.groupBy("anchor").agg(F.array_sort(F.collect_set(F.struct("positive_score", "low", "high"))).alias("asked"))
    scores = scores.select(F.col("anchor").alias("of"), F.col("asked.positive_score").alias("scores"), F.col("asked.low").alias("low"), F.col("asked.high").alias("high"))
    asked = anchors.join(scores, F.col("anchor") == F.col("of"))
    others = _best_of_blocks(asked, table, groups, parts, space, negatives, same_label=False)
    others = others.select("anchor", "query", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    own = own.join(asked.select("of", "scores", F.col("id").alias("anchor_id")), F.col("anchor") == F.col("of"))
    own = own.withColumn("query", F.array_position("scores", F.col("positive_score")) - 1)
    return own.join(others, ["anchor", "query"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
