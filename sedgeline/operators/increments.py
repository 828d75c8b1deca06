"""The filter stages over a table that grows: facts of each mesh are kept, and new files run only the meshes they touch again.

A batch of cleaned rows is merged with the kept rows of its meshes, and of these the whole state is written
anew under the batch's number: rows without repetitions, with whether they pass all stages, and one row of
facts for each mesh. The last batch that has a mesh is the one that counts. A batch counts once its commit is
written, which is last, so that a run that fails leaves the state as it was.

What is kept is what the stages over all rows at once would give, whatever the order of the batches.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.operators import stages
from sedgeline.operators.stages import DATE, KEYS, MESH, STAGES, TYPE, VALUE
from sedgeline.params import DEFAULT, Params
from sedgeline.sources import stores

#: Counts of a mesh: rows that pass so many stages, and whether it has several types where types are made one.
COUNTS = [f"r{k}" for k in range(len(STAGES))]
#: Facts of a mesh (stages.mesh_facts), also kept with its rows.
FACTS = ["n_dates", "first_mean", "winner", "n_types"]
_COMMIT = "batch long, settings string"


class Increments:
    """State under a folder. order: columns by which the first of repeated rows is told; params: of the stages, the same for all batches."""

    def __init__(self, spark: SparkSession, path: str, order: list[str], params: Params = DEFAULT):
        self.spark, self.path, self.order, self.params = spark, path.rstrip("/"), order, params
        self.settings = json.dumps({"order": order} | asdict(params), sort_keys=True, default=str)
        if any(r["settings"] != self.settings for r in self._commits().select("settings").distinct().collect()):
            raise ValueError("the state was made with other settings")

    def _commits(self) -> DataFrame:
        if not stores.exists(self.spark, f"{self.path}/commits"):
            return self.spark.createDataFrame([], _COMMIT)
        return self.spark.read.schema(_COMMIT).json(f"{self.path}/commits")

    def last_batch(self) -> int:
        """0 before the first batch."""
        return self._commits().agg(F.max("batch")).first()[0] or 0

    def _all(self, name: str) -> DataFrame | None:
        """Rows of the committed batches, with batch."""
        n = self.last_batch()
        return self.spark.read.parquet(f"{self.path}/{name}").filter(F.col("batch") <= n) if n else None

    def facts(self) -> DataFrame | None:
        """One row for each mesh: n_dates, first_mean, winner, n_types, r0 to r6, mixed, of the last batch that has it. None at first."""
        kept = self._all("facts")
        if kept is None:
            return None
        others = [c for c in kept.columns if c not in (MESH, "batch")]
        last = kept.groupBy(MESH).agg(F.max(F.struct("batch", *others)).alias("last"))
        return last.select(MESH, *[f"last.{c}" for c in ("batch", *others)])

    def _current(self, facts: DataFrame) -> DataFrame:
        """Kept rows of the meshes of facts."""
        of = facts.select(F.col(MESH).alias("_of"), F.col("batch").alias("_last"))
        kept = self._all("rows")
        return kept.join(of, (kept[MESH] == of["_of"]) & (kept["batch"] == of["_last"]), "left_semi").drop("batch", *FACTS)

    def add(self, clean: DataFrame) -> int:
        """Merge a batch of cleaned rows; its number."""
        n = self.last_batch() + 1
        clean = clean.filter(F.col(MESH).isNotNull())
        near = F.coalesce(F.col("distance_from_fdnpp_km") <= self.params.distance_cutoff_km, F.lit(False))
        columns = clean.columns
        rest = [*self.order, *[c for c in columns if c not in KEYS and c not in self.order]]
        rows = clean.filter(near).withColumn("_copies", F.lit(1).cast("long"))
        loaded = clean.groupBy(MESH).agg(F.count(F.lit(1)).alias("r0"))
        facts = self.facts()
        if facts is not None:
            # Only what is kept of the batch's meshes is read and merged.
            touched = facts.join(loaded.select(F.col(MESH).alias("_new")), F.col(MESH) == F.col("_new"), "left_semi")
            rows = rows.unionByName(self._current(touched).drop("_passed"))
            loaded = loaded.unionByName(touched.select(MESH, "r0")).groupBy(MESH).agg(F.sum("r0").alias("r0"))
        single = rows.groupBy(*KEYS).agg(F.min(F.struct(*rest)).alias("_first"), F.sum("_copies").alias("_copies"))
        single = single.select(*[F.col(c) if c in KEYS else F.col(f"_first.{c}").alias(c) for c in columns], "_copies")
        limit = F.col("detection_lower_limit")
        detected = F.col(VALUE).isNotNull() & (limit.isNull() | F.coalesce(F.col(VALUE) > limit, F.lit(False)))
        joined = single.join(self._facts_of(single, detected), F.col(MESH) == F.col("_of"), "left")
        # Each row goes with its mesh's facts, so that they are neither computed nor shuffled again.
        joined.withColumn("_passed", self._passed(detected)).drop("_of").write.mode("overwrite").parquet(f"{self.path}/rows/batch={n}")

        kept = self.spark.read.parquet(f"{self.path}/rows/batch={n}")
        passed = [F.sum(F.when(F.col("_passed") >= k, F.col("_copies") if k < 2 else F.lit(1)).otherwise(0)).alias(f"r{k}") for k in range(1, len(STAGES))]
        facts = [F.first(c).alias(c) for c in FACTS]
        counted = kept.groupBy(F.col(MESH).alias("_counted")).agg(*passed, *facts)
        full = loaded.join(counted, F.col(MESH) == F.col("_counted"), "left").drop("_counted").fillna(0, COUNTS)
        mixed = ((F.col("r5") > 0) & (F.coalesce("n_types", F.lit(0)) > 1)).alias("mixed")
        full.select(MESH, *FACTS, *COUNTS, mixed).write.mode("overwrite").parquet(f"{self.path}/facts/batch={n}")
        self.spark.createDataFrame([(n, self.settings)], _COMMIT).coalesce(1).write.mode("append").json(f"{self.path}/commits")
        return n

    def _facts_of(self, single: DataFrame, detected: Column) -> DataFrame:
        """stages.mesh_facts of the detected rows, with the mesh as _of.

        Conditions instead of filters, and copies in all branches: else they differ below the exchange of the
        rows, which then isn't shared but made once for each.
        """
        here = detected & (F.col("_copies") > 0)
        dated = single.groupBy(MESH, DATE).agg(F.sum(F.when(here, F.col(VALUE))).alias("_sum"), F.count_if(here).alias("_n"))
        dates = F.col(DATE).isNotNull() & (F.col("_n") > 0)
        first = F.min(F.when(dates, F.struct(DATE, "_sum", "_n"))).alias("_f")
        means = dated.groupBy(F.col(MESH).alias("_of")).agg(F.when(F.sum("_n") > 0, F.count_if(dates)).alias("n_dates"), first)
        typed = single.groupBy(MESH, TYPE).agg(F.count_if(here).alias("count"))
        there = F.col(TYPE).isNotNull() & (F.col("count") > 0)
        best = F.min(F.when(there, F.struct(-F.col("count"), stages.type_rank(F.col(TYPE)), F.col(TYPE).alias("type")))).alias("best")
        winners = typed.groupBy(F.col(MESH).alias("_typed")).agg(best, F.nullif(F.count_if(there), F.lit(0)).alias("n_types"))
        found = means.join(winners, F.col("_of") == F.col("_typed"), "left")
        return found.select("_of", "n_dates", F.try_divide("_f._sum", F.col("_f._n")).alias("first_mean"), F.col("best.type").alias("winner"), "n_types")

    def _passed(self, detected: Column) -> Column:
        """How many of STAGES after the first a near row without repetitions passes."""
        gates = [
            detected,
            F.coalesce(F.col("first_mean") > self.params.dose_threshold, F.lit(False)),
            F.coalesce(F.col("n_dates") >= self.params.min_dates, F.lit(False)),
            F.coalesce(F.col(TYPE) == F.col("winner"), F.lit(False)),
        ]
        passed, before = F.lit(2), F.lit(True)
        for gate in gates:
            before = before & gate
            passed = passed + before.cast("int")
        return passed

    def result(self) -> DataFrame:
        """The rows that pass all stages."""
        facts = self.facts()
        if facts is None:
            raise ValueError("no batch was added yet")
        return self._current(facts.filter("r6 > 0")).filter(F.col("_passed") == len(STAGES) - 1).drop("_passed", "_copies")

    def audit(self) -> DataFrame:
        """stages.stage_audit of all rows of all batches, from the facts only."""
        facts = self.facts()
        if facts is None:
            raise ValueError("no batch was added yet")
        return stages.audit_of_counts(facts.select(*COUNTS, F.col("mixed").cast("int").alias("mixed")))

    def compact(self) -> int:
        """All that counts, written once more as one batch, so that earlier ones may be removed; its number."""
        facts = self.facts()
        if facts is None:
            raise ValueError("no batch was added yet")
        n = self.last_batch() + 1
        self._current(facts).write.mode("overwrite").parquet(f"{self.path}/rows/batch={n}")
        facts.drop("batch").write.mode("overwrite").parquet(f"{self.path}/facts/batch={n}")
        self.spark.createDataFrame([(n, self.settings)], _COMMIT).coalesce(1).write.mode("append").json(f"{self.path}/commits")
        return n
