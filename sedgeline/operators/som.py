"""Self-organizing maps: the grid, training of many maps with one aggregation a pass, and the measures of a map.

Codebooks are bounded by their grids and go to the tasks with the code, so that nothing needs a join. Tasks
work on Arrow batches: one matrix product gives the distances of a batch to the neurons of all maps. A
task returns sums for each neuron, never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Hexagonal grid; neurons count from 1, x fastest."""

    columns: int
    rows: int

    def points(self) -> np.ndarray:
        return np.array([(x + 1 + 0.5 * ((y + 1) % 2), (y + 1) * math.sqrt(3) / 2) for y in range(self.rows) for x in range(self.columns)])

    def distances(self) -> np.ndarray:
        p = self.points()
        return np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))

    def neighbours(self) -> dict[int, list[int]]:
        d = self.distances()
        return {i + 1: [j + 1 for j in range(len(d)) if 0 < d[i, j] < 1.1] for i in range(len(d))}

    def edges(self, spark: SparkSession) -> DataFrame:
        pairs = [(a, b) for a, near in self.neighbours().items() for b in near]
        # An Arrow table is sent as it is; rows would be made by Python workers, one a core.
        return spark.createDataFrame(pa.table({name: pa.array([p[k] for p in pairs], pa.int32()) for k, name in enumerate(("src", "dst"))}))


#: Numbers in a block of differences between vectors and neurons.
_BLOCK = 1 << 17


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that aren't null as rows, and which rows these are."""
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    kept = column.drop_null()
    return kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(kept), -1 if len(kept) else 0), there


def _distances(x: np.ndarray, codebook: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances to each neuron) in blocks; sums of squared differences, so that equal neurons are equally near."""
    step = max(1, _BLOCK // max(1, codebook.size))
    for i in range(0, len(x), step):
        yield i, np.sqrt(((x[i : i + step, None, :] - codebook[None]) ** 2).sum(axis=2))


def assign(df: DataFrame, codebook: np.ndarray, vector: str = "vector") -> DataFrame:
    """df with bmu, bmu_distance and second (the two best neurons); of equally near ones the lower number. Null for a null vector."""
    book = np.asarray(codebook, dtype=np.float64)

    @F.arrow_udf("bmu int, bmu_distance double, second int")
    def nearest(column: pa.Array) -> pa.Array:
        x, there = _matrix(column)
        best, second, near = np.zeros(len(column), np.int32), np.zeros(len(column), np.int32), np.zeros(len(column))
        for i, d in _distances(x, book):
            rows, line = there[i : i + len(d)], np.arange(len(d))
            first = d.argmin(axis=1)
            best[rows], near[rows] = first + 1, d[line, first]
            d[line, first] = np.inf
            second[rows] = d.argmin(axis=1) + 1
        missing = np.ones(len(column), bool)
        missing[there] = False
        alone = missing | (len(book) < 2)
        fields = [pa.array(best, mask=missing), pa.array(near, mask=missing), pa.array(second, mask=alone)]
        return pa.StructArray.from_arrays(fields, ["bmu", "bmu_distance", "second"])

    # Else a condition on the result (a join's, that it isn't null) goes below and has all vectors assigned a second time.
    found = df.withColumn("_near", nearest.asNondeterministic()(F.col(vector)))
    return found.select(*df.columns, "_near.bmu", "_near.bmu_distance", "_near.second")


@dataclass(frozen=True)
class Training:
    """How maps are trained.

    rlen: passes. alpha: the rate of a presentation, falling from the first to the second over the passes;
    None: batches, in which a neuron becomes the weighted mean of what it is shown. shares: a pass shows one
    of so many shares of the rows, chosen by a hash (small batches). bubble: all neurons within the radius
    learn alike; otherwise by a Gaussian of their distance.

    At a rate a, the n presentations of a pass bring a neuron 1 - (1 - a)^n of the way to their mean. That
    is used as it stands, so that a map doesn't depend on how rows are partitioned, or on their order.
    """

    rlen: int = 20
    alpha: tuple[float, float] | None = None
    shares: int = 1
    bubble: bool = False

    def radius(self, k: int, apart: np.ndarray) -> float:
        return max(0.5, (apart.max() / 2) * (1 - k / max(1, self.rlen - 1)))

    def step(self, k: int, book: np.ndarray, apart: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
        """The codebook after pass k. count, total: vectors of each best neuron, and their sum."""
        radius = self.radius(k, apart)
        near = (apart <= radius).astype(float) if self.bubble else np.exp(-(apart**2) / (2 * radius**2))
        weight = near @ count
        mean = (near @ total) / np.maximum(weight, 1e-12)[:, None]
        rate = np.ones(len(book))
        if self.alpha:
            a = self.alpha[0] + (self.alpha[1] - self.alpha[0]) * k / max(1, self.rlen - 1)
            rate = -np.expm1(weight * math.log1p(-min(a, 1 - 1e-9)))
        return np.where(weight[:, None] > 1e-12, book + rate[:, None] * (mean - book), book)


def _first_vectors(df: DataFrame, seeds: Sequence[int], n: int, vector: str) -> dict[int, list]:
    """For each seed the n vectors least by a hash of it: each task keeps as many, and these are ranked."""
    hashed = df.select(F.col(vector).alias("vector"), *[F.xxhash64(F.lit(s), F.col(vector)).alias(f"h{i}") for i, s in enumerate(seeds)])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = [pa.table({"seed": pa.array([], pa.int32()), "h": pa.array([], pa.int64()), "vector": pa.array([], pa.list_(pa.float64()))})] * len(seeds)
        for batch in batches:
            vectors = batch.column("vector").cast(pa.list_(pa.float64()))
            for i in range(len(seeds)):
                own = pa.table({"seed": pa.array([i] * len(batch), pa.int32()), "h": batch.column(f"h{i}"), "vector": vectors})
                own = pa.concat_tables([held[i], own])
                order = np.argsort(own.column("h").to_numpy(), kind="stable")[:n]
                held[i] = own.take(pa.array(order))
        for own in held:
            yield from own.combine_chunks().to_batches()

    found = hashed.mapInArrow(least, "seed int, h long, vector array<double>")
    place = F.row_number().over(Window.partitionBy("seed").orderBy("h", "vector"))
    rows = found.withColumn("place", place).filter(F.col("place") <= n).orderBy("seed", "place").collect()
    return {s: [r["vector"] for r in rows if r["seed"] == i] for i, s in enumerate(seeds)}


def _sums(df: DataFrame, books: Sequence[np.ndarray], vector: str) -> tuple[list[np.ndarray], list[np.ndarray], list[float]]:
    """For each map: vectors of each best neuron, their sum, and the sum of all distances; in one job."""
    stacked = np.concatenate(books)
    square, ends = (stacked**2).sum(axis=1), np.cumsum([0, *[len(b) for b in books]])
    width = stacked.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, near, total = np.zeros(len(stacked)), np.zeros(len(stacked)), np.zeros((len(stacked), width))
        for batch in batches:
            vectors, _ = _matrix(batch.column(0))
            step = max(1, _BLOCK // len(stacked))
            for i in range(0, len(vectors), step):
                x = vectors[i : i + step]
                d = square[None] - 2 * (x @ stacked.T)
                own = (x**2).sum(axis=1)
                for first, end in zip(ends, ends[1:], strict=False):
                    best = d[:, first:end].argmin(axis=1)
                    # The distance itself from differences: a product loses digits where rows are near.
                    apart = np.sqrt(((x - stacked[first + best]) ** 2).sum(axis=1)) if width else np.sqrt(own)
                    count[first:end] += np.bincount(best, minlength=end - first)
                    near[first:end] += np.bincount(best, apart, minlength=end - first)
                    cell = (best[:, None] * width + np.arange(width)).ravel()
                    total[first:end] += np.bincount(cell, x.ravel(), minlength=(end - first) * width).reshape(-1, width)
        some = np.flatnonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * width), pa.array(total[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(near[some]), sums], ["neuron", "n", "d", "s"])

    parts = df.select(F.col(vector).cast("array<double>")).mapInArrow(add, "neuron long, n double, d double, s array<double>")
    rows = parts.groupBy("neuron").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)]).collect()
    count, near, total = np.zeros(len(stacked)), np.zeros(len(stacked)), np.zeros((len(stacked), width))
    for r in rows:
        count[r["neuron"]], near[r["neuron"]], total[r["neuron"]] = r["n"], r["d"], [r[f"s{i}"] for i in range(width)]
    parts_of = list(zip(ends, ends[1:], strict=False))
    return [count[a:b] for a, b in parts_of], [total[a:b] for a, b in parts_of], [float(near[a:b].sum()) for a, b in parts_of]


def train_all(df: DataFrame, maps: Sequence[tuple[Grid, int]], how: Training = Training(), vector: str = "vector") -> list[tuple[np.ndarray, list[float]]]:
    """Codebook, and mean distance of each pass, of each map (grid and seed). A pass is one job for all maps.

    A map starts from the vectors least by a hash of its seed. Neurons that nothing is near keep their weights.
    """
    most = max(g.columns * g.rows for g, _ in maps)
    start = _first_vectors(df, list(dict.fromkeys(s for _, s in maps)), most, vector)
    if not all(start.values()):
        raise ValueError("a map needs at least one vector")
    books = [np.array([start[s][i % len(start[s])] for i in range(g.columns * g.rows)], dtype=float) for g, s in maps]
    apart = [g.distances() for g, _ in maps]
    changes: list[list[float]] = [[] for _ in maps]
    share = F.pmod(F.xxhash64(F.lit("share"), F.col(vector)), F.lit(how.shares))
    for k in range(how.rlen):
        shown = df.select(vector) if how.shares == 1 else df.select(vector).filter(share == k % how.shares)
        count, total, near = _sums(shown, books, vector)
        for i in range(len(maps)):
            books[i] = how.step(k, books[i], apart[i], count[i], total[i])
            changes[i].append(near[i] / max(1.0, count[i].sum()))
    return list(zip(books, changes, strict=True))


def train(df: DataFrame, grid: Grid, passes: int = 20, seed: int = 42, vector: str = "vector", how: Training | None = None) -> tuple[np.ndarray, list[float]]:
    """Codebook and mean distance of each pass of one map; how: instead of so many batch passes."""
    return train_all(df, [(grid, seed)], how or Training(passes), vector)[0]


def quality(assigned: DataFrame, grid: Grid) -> DataFrame:
    """qe: mean distance; te: share of rows whose two best neurons are not neighbours."""
    near = F.create_map(*[x for a, b in grid.neighbours().items() for x in (F.lit(a), F.array(*[F.lit(i) for i in b]))])
    apart = ~F.array_contains(F.element_at(near, F.col("bmu")), F.col("second"))
    return assigned.agg(F.avg("bmu_distance").alias("qe"), F.avg(apart.cast("double")).alias("te"))


def node_counts(assigned: DataFrame, grid: Grid) -> DataFrame:
    spark = assigned.sparkSession
    every = spark.range(1, grid.columns * grid.rows + 1).select(F.col("id").cast("int").alias("neuron"))
    counts = assigned.groupBy(F.col("bmu").alias("neuron")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(F.broadcast(counts), "neuron", "left").select("neuron", F.coalesce("n", F.lit(0)).alias("n"))


def umatrix(spark: SparkSession, codebook: np.ndarray, grid: Grid) -> DataFrame:
    """neuron, mean distance to its neighbours."""
    book = spark.createDataFrame([(i + 1, [float(x) for x in w]) for i, w in enumerate(codebook)], "neuron int, w array<double>")
    a, b = book.select(F.col("neuron").alias("src"), F.col("w").alias("wa")), book.select(F.col("neuron").alias("dst"), F.col("w").alias("wb"))
    apart = F.sqrt(F.aggregate(F.zip_with("wa", "wb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return grid.edges(spark).join(a, "src").join(b, "dst").groupBy(F.col("src").alias("neuron")).agg(F.avg(apart).alias("distance"))


def converged(changes: list[float], limit: float = 0.01) -> tuple[bool, float, float]:
    """(whether, relative change, final change): the mean of the last twentieth of the passes against that of the passes at 70 to 75 %.

    With 2000 passes these are passes 1901 to 2000 and 1400 to 1500.
    """
    n = len(changes)
    late = float(np.mean(changes[-max(1, n // 20) :]))
    middle = float(np.mean(changes[max(0, n * 7 // 10 - 1) : max(1, n * 3 // 4)]))
    relative = abs(late - middle) / middle if middle else 0.0
    return relative < limit, relative, late


@dataclass(frozen=True)
class Run:
    """A trained map with its measures."""

    grid: Grid
    seed: int
    codebook: np.ndarray
    changes: list[float]
    qe: float
    te: float

    @property
    def name(self) -> str:
        return f"{self.grid.columns}x{self.grid.rows}_seed{self.seed}"


#: Grids and seeds that are compared.
GRIDS = (Grid(5, 5), Grid(6, 6))
SEEDS = (42, 123, 456, 789, 2024)


def train_runs(
    df: DataFrame, grids: tuple[Grid, ...] = GRIDS, seeds: tuple[int, ...] = SEEDS, passes: int = 20, vector: str = "vector", how: Training | None = None
) -> list[Run]:
    """A run for each grid and seed. df is read once a pass for all of them: write it before."""
    maps = [(g, s) for g in grids for s in seeds]
    trained = train_all(df, maps, how or Training(passes), vector)
    measured = qualities(df, [book for book, _ in trained], [g for g, _ in maps], vector)
    return [Run(g, s, book, changes, *m) for (g, s), (book, changes), m in zip(maps, trained, measured, strict=True)]


def _best_neurons(vector: Column, books: Sequence[np.ndarray]) -> Column:
    """An array of the two best neurons and the distance of each map in turn, as (bmu, second, distance)."""

    @F.arrow_udf("array<struct<bmu int, second int, distance double>>")
    def nearest(column: pa.Array) -> pa.Array:
        x, there = _matrix(column)
        n = len(books)
        first, second, near = np.zeros((len(x), n), np.int32), np.zeros((len(x), n), np.int32), np.zeros((len(x), n))
        for k, book in enumerate(books):
            for i, d in _distances(x, np.asarray(book, dtype=np.float64)):
                line = np.arange(len(d))
                best = d.argmin(axis=1)
                first[i : i + len(d), k], near[i : i + len(d), k] = best + 1, d[line, best]
                d[line, best] = np.inf
                second[i : i + len(d), k] = d.argmin(axis=1) + 1
        ends = np.zeros(len(column) + 1, np.int32)
        ends[there + 1] = n
        fields = pa.StructArray.from_arrays([pa.array(a.ravel()) for a in (first, second, near)], ["bmu", "second", "distance"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), fields)

    return nearest(vector)


def qualities(df: DataFrame, books: Sequence[np.ndarray], grids: Sequence[Grid], vector: str = "vector") -> list[tuple[float, float]]:
    """(qe, te) of each map, in one job."""
    found = df.select(_best_neurons(F.col(vector), books).alias("near"))
    each = []
    for k, grid in enumerate(grids):
        near = F.create_map(*[x for a, b in grid.neighbours().items() for x in (F.lit(a), F.array(*[F.lit(i) for i in b]))])
        apart = ~F.array_contains(F.element_at(near, F.get("near", F.lit(k))["bmu"]), F.get("near", F.lit(k))["second"])
        each += [F.avg(F.get("near", F.lit(k))["distance"]).alias(f"qe{k}"), F.avg(apart.cast("double")).alias(f"te{k}")]
    row = found.agg(*each).first()
    return [(row[f"qe{k}"], row[f"te{k}"]) for k in range(len(books))]


def assign_runs(df: DataFrame, runs: list[Run], vector: str = "vector") -> DataFrame:
    """df with a column of best neurons for each run, of its name."""
    found = df.withColumn("_near", _best_neurons(F.col(vector), [r.codebook for r in runs]))
    return found.select(*df.columns, *[F.get("_near", F.lit(k))["bmu"].alias(r.name) for k, r in enumerate(runs)])


def runs_table(spark: SparkSession, runs: list[Run]) -> DataFrame:
    """run_id, grid, seed, qe, te, converged, rel_change, final_change: a row for each run."""
    rows = [(r.name, f"{r.grid.columns}x{r.grid.rows}", r.seed, float(r.qe), float(r.te), *converged(r.changes)) for r in runs]
    return spark.createDataFrame(rows, "run_id string, grid string, seed int, qe double, te double, converged boolean, rel_change double, final_change double")


def ari_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, ari for each pair of columns of labels, in one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")) for a, b in pairs])
    cells = df.select(F.inline(each)).groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    total = cells.groupBy("a", "b").agg(two("n").alias("cells"), F.sum("n").alias("all"))
    for side, name in (("x", "rows"), ("y", "columns")):
        total = total.join(cells.groupBy("a", "b", side).agg(F.sum("n").alias("n")).groupBy("a", "b").agg(two("n").alias(name)), ["a", "b"])
    expected = F.try_divide(F.col("rows") * F.col("columns"), F.col("all") * (F.col("all") - 1) / 2)
    top = (F.col("rows") + F.col("columns")) / 2
    return total.select("a", "b", F.coalesce(F.try_divide(F.col("cells") - expected, top - expected), F.lit(1.0)).alias("ari"))


def grid_summary(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """grid, mean_qe, mean_te, mean_ari, min_ari, stable. runs: runs_table; pairs: ari_matrix over runs of one grid each."""
    means = runs.groupBy("grid").agg(F.avg("qe").alias("mean_qe"), F.avg("te").alias("mean_te"))
    inside = pairs.withColumn("grid", F.substring_index("a", "_", 1)).filter(F.col("grid") == F.substring_index("b", "_", 1))
    alike = inside.groupBy("grid").agg(F.avg("ari").alias("mean_ari"), F.min("ari").alias("min_ari"))
    return means.join(alike, "grid", "left").withColumn("stable", F.coalesce(F.col("mean_ari") > 0.80, F.lit(False)))


def codebook_table(spark: SparkSession, run: Run) -> DataFrame:
    """neuron, x, y, w."""
    places = run.grid.points()
    rows = [(i + 1, float(places[i][0]), float(places[i][1]), [float(v) for v in w]) for i, w in enumerate(run.codebook)]
    return spark.createDataFrame(rows, "neuron int, x double, y double, w array<double>")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ari of two labellings of the rows, from their contingency table."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    pair = cells.agg(F.sum(two("n")).alias("cells"), F.sum("n").alias("all"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("rows"))
    columns = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("columns"))
    expected = F.col("rows") * F.col("columns") / two("all")
    top = (F.col("rows") + F.col("columns")) / 2
    # One row each.
    one = pair.join(F.broadcast(rows)).join(F.broadcast(columns))
    return one.select(F.coalesce(F.try_divide(F.col("cells") - expected, top - expected), F.lit(1.0)).alias("ari"))
