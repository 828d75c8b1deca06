"""Connected components of links between long numbers; no link leaves the executors.

Each task first reduces the links that it holds to stars (a union-find in numpy). Where the links are
more than a task takes, large and small stars alternate with that, until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.llm.common import TASK_ROWS, compact, cut


def _least_of_group(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, and the least node that links (u, v) reach from each."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, least = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while np.any((x := least[a]) != (y := least[b])):
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while np.any(least[least] != least):
            least = least[least]
    return nodes, nodes[least]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if held:
        nodes, least = _least_of_group(*[np.concatenate(x) for x in zip(*held, strict=True)])
        apart = nodes != least
        yield pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(least[apart])], ["u", "v"])


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Each node's neighbours linked to the least of them and itself: v > u only, or v <= u and u itself."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = pairs.join(least, pairs["u"] == least["w"])
    if larger_only:
        linked = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        to_least = least.select(F.col("w").alias("u"), F.col("m").alias("v"))
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(to_least)
    return linked.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """node, component (its least node) for every node of edges (u, v: longs). rows: links in a task."""
    links = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    before = None
    while True:
        current, parts = compact(links, rows)
        current = current.mapInArrow(_stars, "u long, v long")
        if parts > 1:
            current = cut(current)
            state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if parts == 1 or state == before:
            # A star for each component: every node is linked with its least node only.
            centres = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return cut(current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres))
        before = state
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        links = _star(cut(_star(both, larger_only=True)), larger_only=False)
