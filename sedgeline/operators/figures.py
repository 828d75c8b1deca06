"""The frames behind the figures of a clustering: what a plotting library needs, one function each.

Frames of neurons and runs have a row for each of them (tens); those of meshes are as large as the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.operators import cluster, som
from sedgeline.params import FEATURES


def mesh_map(clustered: DataFrame) -> DataFrame:
    """Figure 1: mesh, place and label of every mesh that has a place."""
    placed = clustered.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return placed.select("mesh_id_250m", "longitude", "latitude", "som_cluster", "som_cluster_label")


def centroid_heat(clustered: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Figures 2 and 3: cluster, feature, value (mean z)."""
    return cluster.long_form(cluster.centroids(clustered, [f"{c}_z" for c in columns], "som_cluster"), ["som_cluster"], [f"{c}_z" for c in columns])


def component_planes(spark: SparkSession, run: som.Run, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Figure 4: neuron, x, y, feature, value of the codebook."""
    book = som.codebook_table(spark, run)
    return book.select("neuron", "x", "y", F.posexplode("w").alias("at", "value")).select(
        "neuron", "x", "y", F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("at") + 1).alias("feature"), "value"
    )


def umatrix_plane(spark: SparkSession, run: som.Run, clusters: list[int]) -> DataFrame:
    """Figure 5: neuron, x, y, mean distance to the neighbours, cluster."""
    of = F.element_at(F.array(*[F.lit(c) for c in clusters]), F.col("neuron"))
    far = som.umatrix(spark, run.codebook, run.grid)
    return som.codebook_table(spark, run).drop("w").join(far, "neuron").withColumn("cluster", of)


def convergence(spark: SparkSession, runs: list[som.Run]) -> DataFrame:
    """Figure 6: run_id, grid, seed, iteration (from 1), change."""
    rows = [(r.name, f"{r.grid.columns}x{r.grid.rows}", r.seed, k + 1, float(c)) for r in runs for k, c in enumerate(r.changes)]
    return spark.createDataFrame(rows, "run_id string, grid string, seed int, iteration int, change double")


def node_plane(assigned: DataFrame, run: som.Run) -> DataFrame:
    """Figure 7: neuron, x, y, rows."""
    return som.codebook_table(assigned.sparkSession, run).drop("w").join(som.node_counts(assigned, run.grid), "neuron")


def dendrogram(spark: SparkSession, points: np.ndarray, k: int) -> DataFrame:
    """Figure 8: step, a, b (points, then merged groups), height, above_cut (whether the merge lies above the cut into k)."""
    merges = cluster.ward(points)
    line = sorted((h for *_, h in merges), reverse=True)[k - 2] if k > 1 else float("inf")
    rows = [(i + 1, a + 1, b + 1, float(h), bool(h >= line)) for i, (a, b, h) in enumerate(merges)]
    return spark.createDataFrame(rows, "step int, a int, b int, height double, above_cut boolean")


def silhouettes(spark: SparkSession, points: np.ndarray, clusters: list[int]) -> DataFrame:
    """Figure 9: neuron, cluster, width."""
    rows = [(i + 1, c, w) for i, (c, w) in enumerate(zip(clusters, cluster.silhouette_widths(points, clusters), strict=True))]
    return spark.createDataFrame(rows, "neuron int, cluster int, width double")


def optimal_k(spark: SparkSession, points: np.ndarray, most: int = 10, draws: int = 100) -> DataFrame:
    """Figure 10: k, silhouette, wss, gap, gap_se."""
    return spark.createDataFrame(cluster.k_scores(points, most, draws), "k int, silhouette double, wss double, gap double, gap_se double")


def ari_heat(pairs: DataFrame) -> DataFrame:
    """Figure 11: a, b, ari in both directions and with the diagonal."""
    names = pairs.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "ari")).unionByName(names.select("a", F.col("a").alias("b"), F.lit(1.0).alias("ari")))


def size_bars(clustered: DataFrame, share: float = 0.01, name: str = "som_cluster") -> DataFrame:
    """Figure 12: cluster, n, pct, least (rows that a cluster needs)."""
    total = clustered.agg(F.ceil(F.count(F.lit(1)) * share).alias("least"))
    return cluster.cluster_sizes(clustered, name).join(F.broadcast(total))  # one row


def boxes(clustered: DataFrame, most: int = 50_000, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Figure 13: cluster, feature, quartiles of a repeatable sample of meshes."""
    sample = cluster.subsample(clustered, "mesh_id_250m", most)
    z = [f"{c}_z" for c in columns]
    return cluster.box_quartiles(cluster.long_form(sample.select("som_cluster", *z), ["som_cluster"], z), ["som_cluster", "feature"])
