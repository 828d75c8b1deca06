"""Grouping a codebook (tens of points) into regimes, and summaries of the groups over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.functions.scalars import significant


def ward(points: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of Ward's method on distances; new clusters count on from len(points)."""
    size = {i: 1 for i in range(len(points))}
    square = {(i, j): float(((points[i] - points[j]) ** 2).sum()) for i in size for j in size if i < j}
    merges, new = [], len(points)
    while len(size) > 1:
        (a, b), d = min(square.items(), key=lambda x: (x[1], x[0]))
        merges.append((a, b, float(np.sqrt(d))))
        for c in [c for c in size if c not in (a, b)]:
            da, db = square[tuple(sorted((a, c)))], square[tuple(sorted((b, c)))]
            total = size[a] + size[b] + size[c]
            square[(c, new)] = ((size[a] + size[c]) * da + (size[b] + size[c]) * db - size[c] * d) / total
        size[new] = size.pop(a) + size.pop(b)
        square = {k: v for k, v in square.items() if a not in k and b not in k}
        new += 1
    return merges


def cut_tree(merges: list[tuple[int, int, float]], n: int, k: int) -> list[int]:
    """Labels 1..k in order of first appearance."""
    members = {i: [i] for i in range(n)}
    for new, (a, b, _) in enumerate(merges[: n - k], start=n):
        members[new] = members.pop(a) + members.pop(b)
    owner = {i: c for c, group in members.items() for i in group}
    seen: dict[int, int] = {}
    return [seen.setdefault(owner[i], len(seen) + 1) for i in range(n)]


def silhouette_widths(points: np.ndarray, labels: list[int]) -> list[float]:
    """The width of each point; 0 for one alone in its cluster."""
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    label = np.array(labels)
    widths = []
    for i in range(len(points)):
        own = (label == label[i]) & (np.arange(len(points)) != i)
        if not own.any():
            widths.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, label == c].mean() for c in set(labels) if c != label[i])
        widths.append(float((b - a) / max(a, b)) if max(a, b) else 0.0)
    return widths


def silhouette(points: np.ndarray, labels: list[int]) -> float:
    return float(np.mean(silhouette_widths(points, labels)))


def within_ss(points: np.ndarray, labels: list[int]) -> float:
    label = np.array(labels)
    return float(sum(((points[label == c] - points[label == c].mean(axis=0)) ** 2).sum() for c in set(labels)))


def _spread(points: np.ndarray, labels: list[int]) -> float:
    """Half the sum over clusters of all their distances over their sizes."""
    label, total = np.array(labels), 0.0
    for c in set(labels):
        x = points[label == c]
        total += np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)).sum() / (2 * len(x))
    return 0.5 * total


def gap_statistic(points: np.ndarray, most: int = 10, draws: int = 100, seed: int = 42) -> tuple[list[float], list[float], int]:
    """Gaps for k = 1.., their standard errors, and the least k whose gap reaches the next one less its error.

    The reference sets are uniform in the box of the principal components, as the gap statistic has it by default.
    """
    rng = np.random.default_rng(seed)
    most = min(most, len(points))

    def dispersion(x: np.ndarray) -> list[float]:
        merges = ward(x)
        return [np.log(max(_spread(x, cut_tree(merges, len(x), k)), 1e-300)) for k in range(1, most + 1)]

    middle = points.mean(axis=0)
    axes = np.linalg.svd(points - middle, full_matrices=False)[2]
    turned = (points - middle) @ axes.T
    low, high = turned.min(axis=0), turned.max(axis=0)
    own = np.array(dispersion(points))
    drawn = np.array([dispersion(rng.uniform(low, high, turned.shape) @ axes + middle) for _ in range(draws)])
    gaps = drawn.mean(axis=0) - own
    errors = drawn.std(axis=0, ddof=1 if draws > 1 else 0) * np.sqrt(1 + 1 / draws)
    best = next((k + 1 for k in range(most - 1) if gaps[k] >= gaps[k + 1] - errors[k + 1]), most)
    return gaps.tolist(), errors.tolist(), best


def k_scores(points: np.ndarray, most: int = 10, draws: int = 100) -> list[tuple[int, float, float, float, float]]:
    """(k, silhouette, within sum of squares, gap, its error) for k = 2 to most."""
    merges, n = ward(points), len(points)
    gaps, errors, _ = gap_statistic(points, most, draws)
    rows = []
    for k in range(2, min(most, n - 1) + 1):
        labels = cut_tree(merges, n, k)
        rows.append((k, silhouette(points, labels), within_ss(points, labels), gaps[k - 1], errors[k - 1]))
    return rows


def choose_k(points: np.ndarray, sizes: dict[int, int], low: int = 3, high: int = 8, share: float = 0.01) -> int:
    """The k of the best silhouette within bounds, less while a cluster has too few rows. sizes: rows per neuron."""
    merges, n = ward(points), len(points)
    scores = {k: silhouette(points, cut_tree(merges, n, k)) for k in range(2, min(10, n - 1) + 1)}
    k = min(max(max(scores, key=lambda x: (scores[x], -x)), low), high)
    least = int(np.ceil(share * sum(sizes.values())))
    while k > 2:
        rows: dict[int, int] = {}
        for neuron, label in enumerate(cut_tree(merges, n, k), start=1):
            rows[label] = rows.get(label, 0) + sizes.get(neuron, 0)
        if min(rows.values()) >= least:
            break
        k -= 1
    return k


#: The label of a cluster by its extreme feature, where that is above and below 0.
EXTREMES = {
    "late_slope": ("Stagnant Late Phase", "Accelerating Late Decay"),
    "slope_ratio": ("Front-Loaded Decay", "Delayed Decay Onset"),
    "temporal_span_years": ("Extended Monitoring", "Short Monitoring Record"),
    "total_decay_ratio": ("Elevated Retention", "Enhanced Decay"),
    "log_linear_slope": ("Shallow Overall Decay", "Steep Overall Decay"),
    "early_slope": ("Slow Early Phase", "Fast Early Decay"),
    "residual_cv": ("High Variability", "Low Variability"),
    "n_increases": ("Frequent Increases", "Steady Decline"),
    "log_linear_r2": ("Good Exponential Fit", "Poor Exponential Fit"),
}


def auto_labels(centroids: list[dict[str, float]], extremes: dict[str, tuple[str, str]] = EXTREMES) -> list[str]:
    """A label for each cluster from its centroid (feature: z)."""
    labels: list[str | None] = [None] * len(centroids)
    middle = float(np.median([c["residual_cv"] for c in centroids]))
    quick = sorted(range(len(centroids)), key=lambda i: centroids[i]["early_slope"])
    for i in quick:
        if centroids[i]["residual_cv"] < middle:
            labels[i] = "Rapid Decay"
            break
    for feature, name in (("total_decay_ratio", "Slow Retention"), ("n_increases", "Recontamination/Anomalous"), ("log_linear_r2", "Consistent Exponential Decay")):
        if free := [i for i in range(len(centroids)) if labels[i] is None]:
            labels[max(free, key=lambda i: (centroids[i][feature], -i))] = name
    for i, c in enumerate(centroids):
        if labels[i] is None:
            feature = max(c, key=lambda f: abs(c[f]))
            high, low = extremes.get(feature, (f"Regime {i + 1}",) * 2)
            labels[i] = "Standard Decay" if abs(c[feature]) < 0.5 else high if c[feature] > 0 else low
    return [f"{x} {i + 1}" if labels.count(x) > 1 else x for i, x in enumerate(labels)]


def select_model(runs: DataFrame, grids: DataFrame, most_te: float = 0.10, least_ari: float = 0.80) -> DataFrame:
    """grid, seed, qe, te, reason of the run to use. runs: som.runs_table; grids: som.grid_summary. A row for each grid is looked at."""
    good = (F.col("mean_te") < most_te) & (F.col("mean_ari") > least_ari)
    key = F.struct(F.when(good, 0).otherwise(1).alias("bad"), F.when(good, F.col("mean_qe")).otherwise(F.col("mean_te")).alias("by"), F.col("grid"))
    best = grids.agg(F.min(key).alias("k"), F.count_if(good).alias("n_good"))
    reason = (
        F.when(F.col("n_good") == 0, "no grid within the limits: least mean TE")
        .when(F.col("n_good") == 1, "the only grid within the limits")
        .otherwise("within the limits: least mean QE")
    )
    best = best.select(F.col("k.grid").alias("grid"), reason.alias("reason"))
    seeds = runs.join(F.broadcast(best), "grid").groupBy("grid", "reason").agg(F.min(F.struct("qe", "seed", "te")).alias("s"))
    return seeds.select("grid", "s.seed", "s.qe", "s.te", "reason")


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """cluster, n, pct."""
    counts = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.join(F.broadcast(total)).select(cluster, "n", (F.col("n") * 100.0 / F.col("all")).alias("pct"))


def centroids(df: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    return df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in columns])


def back_transform(z: DataFrame, params: DataFrame) -> DataFrame:
    """cluster, feature, z -> value = z * iqr + median. params: one row per feature."""
    return z.join(F.broadcast(params), "feature").select("cluster", "feature", "z", (F.col("z") * F.coalesce("iqr", F.lit(0.0)) + F.col("median")).alias("value"))


def within_squares(df: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """cluster, wss: the sum of squared distances of its rows to its mean, in one aggregation."""
    return df.groupBy(cluster).agg(sum((F.coalesce(F.var_pop(c), F.lit(0.0)) * F.count(c) for c in columns), F.lit(0.0)).alias("wss"))


def context_means(df: DataFrame, columns: tuple[str, ...] = ("ecological_half_life_y", "distance_from_fdnpp_km", "initial_dose_rate"), cluster: str = "cluster") -> DataFrame:
    """cluster, mean_<column>; nulls are left out."""
    return df.groupBy(cluster).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def cluster_summary(df: DataFrame, params: DataFrame, labels: dict[int, str], features: tuple[str, ...], cluster: str = "cluster") -> DataFrame:
    """cluster_id, cluster_label, n_observations, pct_of_total, each feature in its own unit (4 digits), context means.

    df: rows with z values (<feature>_z) and the context columns; params: feature, median, iqr.
    """
    known = {r["feature"]: (r["median"], r["iqr"] or 0.0) for r in params.collect()}
    means = centroids(df, [f"{c}_z" for c in features], cluster)
    own = [significant(F.col(f"{c}_z") * F.lit(known[c][1]) + F.lit(known[c][0]), 4).alias(c) for c in features]
    around = context_means(df, cluster=cluster)
    label = F.element_at(F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))]), F.col(cluster))
    joined = cluster_sizes(df, cluster).join(means, cluster).join(around, cluster)
    return joined.select(
        F.col(cluster).alias("cluster_id"),
        label.alias("cluster_label"),
        F.col("n").alias("n_observations"),
        F.round("pct", 2).alias("pct_of_total"),
        *own,
        F.round("mean_ecological_half_life_y", 2).alias("mean_ecological_half_life_y"),
        F.round("mean_distance_from_fdnpp_km", 2).alias("mean_distance_from_fdnpp_km"),
        significant(F.col("mean_initial_dose_rate"), 4).alias("mean_initial_dose_rate"),
    )


def long_form(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    return df.unpivot(ids, columns, "feature", "value")


def box_quartiles(long: DataFrame, by: list[str]) -> DataFrame:
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return long.groupBy(*by).agg(q.alias("q"), F.min("value").alias("low"), F.max("value").alias("high")).select(
        *by, "low", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "high"
    )


def subsample(df: DataFrame, key: str, most: int = 50_000, seed: int = 42) -> DataFrame:
    """At most so many rows, those least by a hash of the key: the same for each run."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(most)


def sample_by_cluster(df: DataFrame, k: int, cluster: str = "cluster", by: Column | None = None, key: str = "mesh_id_250m", seed: int = 42) -> DataFrame:
    """At most k rows of each cluster: those least by a hash (by), then by key.

    Bottom-k sketches merge: every task keeps k candidates of each cluster and drops the rest, so that no
    more than k rows of a cluster leave a task, however large it is, and nothing is put into a global order.
    """
    draw = F.xxhash64(F.lit(seed), key) if by is None else by
    drawn = df.select(F.col(cluster).alias("_cluster"), draw.alias("_draw"), F.col(key).alias("_key"), F.struct(*df.columns).alias("_row"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            own = pa.Table.from_batches([batch])
            own = own if held is None else pa.concat_tables([held, own])
            order = pc.sort_indices(own.select(["_cluster", "_draw", "_key"]), sort_keys=[(c, "ascending") for c in ("_cluster", "_draw", "_key")])
            own = own.take(order)
            groups = own.column("_cluster").combine_chunks().dictionary_encode("encode").indices.to_numpy()
            first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, np.int64)
            place = np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))
            held = own.filter(pa.array(place < k)).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    kept = drawn.mapInArrow(least, drawn.schema)
    order = Window.partitionBy("_cluster").orderBy("_draw", "_key")
    return kept.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k).select("_row.*")
