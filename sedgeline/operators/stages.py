"""Cleaning and the filter stages: DataFrame in, DataFrame out, nothing collected.

The order of the stages is part of the result: duplicates go before the detection limit, and dates
are counted before types are made consistent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sedgeline.functions import scalars
from sedgeline.params import DEFAULT, TYPE_PRIORITY, Params

MESH, DATE, VALUE, TYPE = "mesh_id_250m", "correction_date", "value", "measurement_type"
#: Readings that are equal in these are one.
KEYS = [MESH, DATE, VALUE, TYPE, "source_item"]


def clean(raw: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Typed rows of raw text columns: coercion, row gates, distance, flags."""
    numbers = ("latitude", "longitude", VALUE, "statistical_error", "detection_lower_limit", "measurement_height_cm", "distance_from_fdnpp_km")
    typed = raw.withColumns({c: scalars.number(F.col(c)) for c in numbers if c in raw.columns})
    typed = typed.withColumns({MESH: scalars.mesh_id(F.col(MESH)), DATE: scalars.timestamp(F.col(DATE))})
    kept = typed.filter(scalars.is_dose_rate(F.col("category")) & F.col(DATE).isNotNull() & F.col(MESH).isNotNull())
    return with_flags(with_distance(kept, params))


def with_distance(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The distance computed where it is missing; rows with neither distance nor place go."""
    lat, lon, distance = F.col("latitude"), F.col("longitude"), F.col("distance_from_fdnpp_km")
    placed = df.filter(~((lat.isNull() | lon.isNull()) & distance.isNull()))
    return placed.withColumn("distance_from_fdnpp_km", F.coalesce(distance, scalars.haversine_km(lat, lon, params)))


def with_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "year": F.year(DATE).cast("short"),
        "height_anomalous": scalars.height_anomalous(F.col("measurement_height_cm")),
        "is_decontaminated": scalars.decontaminated(F.col("sampling_point_state"), F.col("note")),
    })


def stage_1_distance(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return df.filter(F.col("distance_from_fdnpp_km") <= params.distance_cutoff_km)


def deduplicate(df: DataFrame, order: list[str]) -> DataFrame:
    """Of rows with equal keys the first in order; missing equals missing.

    An aggregation, so that a key with very many rows is reduced before the shuffle.
    """
    rest = [*order, *[c for c in df.columns if c not in KEYS and c not in order]]
    first = df.groupBy(*KEYS).agg(F.min(F.struct(*rest)).alias("_first"))
    return first.select(*[c if c in KEYS else F.col(f"_first.{c}").alias(c) for c in df.columns])


def stage_2_detection(df: DataFrame) -> DataFrame:
    limit = F.col("detection_lower_limit")
    return df.filter(F.col(VALUE).isNotNull() & (limit.isNull() | (F.col(VALUE) > limit)))


def first_means(df: DataFrame) -> DataFrame:
    """mesh, n_dates, first_mean (mean of the values at the earliest date): from sums of each mesh and date."""
    dated = df.groupBy(MESH, DATE).agg(F.sum(VALUE).alias("_sum"), F.count(VALUE).alias("_n"))
    first = F.min(F.when(F.col(DATE).isNotNull(), F.struct(DATE, "_sum", "_n"))).alias("_first")
    return dated.groupBy(MESH).agg(F.count(DATE).alias("n_dates"), first).select(
        MESH, "n_dates", F.try_divide("_first._sum", F.col("_first._n")).alias("first_mean")
    )


def stage_3_dose(df: DataFrame, threshold: float) -> DataFrame:
    """Meshes whose earliest values have a mean above the threshold."""
    return df.join(first_means(df).filter(F.col("first_mean") > threshold).select(MESH), MESH, "left_semi")


def stage_4_temporal(df: DataFrame, least: int) -> DataFrame:
    """Meshes with enough distinct dates."""
    return df.join(first_means(df).filter(F.col("n_dates") >= least).select(MESH), MESH, "left_semi")


def type_rank(kind: Column) -> Column:
    rank = F.lit(99)
    for place, name in reversed(list(enumerate(TYPE_PRIORITY))):
        rank = F.when(kind == name, place).otherwise(rank)
    return rank


def winning_types(df: DataFrame) -> DataFrame:
    """Each mesh's most frequent type; ties by priority, then by name."""
    return _types(df).select(MESH, TYPE)


def _types(df: DataFrame) -> DataFrame:
    counts = df.filter(F.col(TYPE).isNotNull()).groupBy(MESH, TYPE).count()
    best = F.min(F.struct(-F.col("count"), type_rank(F.col(TYPE)), F.col(TYPE).alias("type")))
    return counts.groupBy(MESH).agg(best.alias("best"), F.count(F.lit(1)).alias("n_types")).select(MESH, F.col("best.type").alias(TYPE), "n_types")


def stage_5_type(df: DataFrame) -> DataFrame:
    return df.join(winning_types(df), [MESH, TYPE], "left_semi")


def mesh_facts(found: DataFrame) -> DataFrame:
    """mesh, n_dates, first_mean, winner (type), n_types of the rows after stage 2: all that stages 3 to 5 ask for."""
    types = _types(found).withColumnRenamed(TYPE, "winner")
    return first_means(found).join(types, MESH, "left")


def run_stages(df: DataFrame, order: list[str], params: Params = DEFAULT) -> DataFrame:
    """Stage 1 to stage 5 over cleaned rows."""
    found = stage_2_detection(deduplicate(stage_1_distance(df, params), order))
    good = (F.col("first_mean") > params.dose_threshold) & (F.col("n_dates") >= params.min_dates)
    winners = mesh_facts(found).filter(good).select(MESH, F.col("winner").alias(TYPE))
    return found.join(winners, [MESH, TYPE], "left_semi")


#: Stages in order, as they are counted; the number of a row is how many it passes.
STAGES = ("0_loaded", "1_distance", "1b_dedup", "2_detection", "3_dose", "4_temporal", "5_type")


def graded(df: DataFrame, order: list[str], params: Params = DEFAULT) -> DataFrame:
    """One row for each set of repeated rows: its keys, copies, passed (how many of STAGES after the first), n_types of its mesh.

    Rows are grouped once; what meshes pass comes from sums of each mesh.
    """
    near = F.coalesce(F.col("distance_from_fdnpp_km") <= params.distance_cutoff_km, F.lit(False))
    rest = [*order, *[c for c in df.columns if c not in KEYS and c not in order]]
    single = df.groupBy(*KEYS, near.alias("near")).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*rest)).alias("first"))
    single = single.select(*KEYS, "near", "copies", F.col("first.detection_lower_limit").alias("limit"))
    detected = F.col("near") & F.col(VALUE).isNotNull() & (F.col("limit").isNull() | F.coalesce(F.col(VALUE) > F.col("limit"), F.lit(False)))
    single = single.withColumn("detected", detected)
    joined = single.join(mesh_facts(single.filter("detected")), MESH, "left")
    gates = [
        F.col("near"),
        F.lit(True),
        F.col("detected"),
        F.coalesce(F.col("first_mean") > params.dose_threshold, F.lit(False)),
        F.coalesce(F.col("n_dates") >= params.min_dates, F.lit(False)),
        F.coalesce(F.col(TYPE) == F.col("winner"), F.lit(False)),
    ]
    passed, before = F.lit(0), F.lit(True)
    for gate in gates:
        before = before & gate
        passed = passed + before.cast("int")
    return joined.select(*KEYS, "copies", "n_types", passed.alias("passed"))


def stage_audit(df: DataFrame, order: list[str], params: Params = DEFAULT) -> DataFrame:
    """stage, rows, rows_dropped, pct_dropped, meshes, meshes_dropped, mixed_meshes (with several types, at the stage that makes types one)."""
    rows = graded(df, order, params)
    reach = range(len(STAGES))
    weight = [F.col("copies") if k < 2 else F.lit(1) for k in reach]
    per_mesh = rows.groupBy(MESH).agg(
        *[F.sum(F.when(F.col("passed") >= k, weight[k]).otherwise(0)).alias(f"r{k}") for k in reach],
        F.max(F.when((F.col("passed") >= 5) & (F.col("n_types") > 1), 1).otherwise(0)).alias("mixed"),
    )
    return audit_of_counts(per_mesh)


def audit_of_counts(per_mesh: DataFrame) -> DataFrame:
    """The audit from r0 to r6 (rows that pass so many stages) and mixed (0 or 1) of each mesh."""
    named = F.col(MESH).isNotNull() if MESH in per_mesh.columns else F.lit(True)
    total = per_mesh.agg(
        *[F.coalesce(F.sum(f"r{k}"), F.lit(0)).alias(f"r{k}") for k in range(len(STAGES))],
        *[F.count_if((F.col(f"r{k}") > 0) & named).alias(f"m{k}") for k in range(len(STAGES))],
        F.coalesce(F.sum("mixed"), F.lit(0)).alias("mixed"),
    )
    each = []
    for k, name in enumerate(STAGES):
        before, meshes_before = (F.col(f"r{k - 1}"), F.col(f"m{k - 1}")) if k else (F.col("r0"), F.col("m0"))
        dropped = before - F.col(f"r{k}")
        each.append(F.struct(
            F.lit(name).alias("stage"), F.col(f"r{k}").alias("rows"), dropped.alias("rows_dropped"),
            F.round(100.0 * dropped / F.greatest(before, F.lit(1)), 2).alias("pct_dropped"), F.col(f"m{k}").alias("meshes"),
            (meshes_before - F.col(f"m{k}")).alias("meshes_dropped"), (F.col("mixed") if k == 6 else F.lit(0).cast("long")).alias("mixed_meshes"),
        ))
    return total.select(F.inline(F.array(*each)))


@dataclass
class Audit:
    """What the stages kept, counted while their result is written; to be read after that."""

    rows_seen: Observation
    meshes_seen: Observation

    def rows(self) -> list[dict]:
        """stage, rows, rows_dropped, pct_dropped, meshes, meshes_dropped, mixed_meshes: as stage_audit gives them."""
        seen, meshes = self.rows_seen.get, self.meshes_seen.get
        out = []
        for k, name in enumerate(STAGES):
            rows, before = seen[f"r{k}"], seen[f"r{max(k - 1, 0)}"]
            out.append({
                "stage": name, "rows": rows, "rows_dropped": before - rows, "pct_dropped": round(100.0 * (before - rows) / max(before, 1), 2),
                "meshes": meshes[f"m{k}"], "meshes_dropped": meshes[f"m{max(k - 1, 0)}"] - meshes[f"m{k}"], "mixed_meshes": meshes["mixed"] if k == 6 else 0,
            })
        return out


def audited(df: DataFrame, order: list[str], params: Params = DEFAULT) -> tuple[DataFrame, Audit]:
    """run_stages over cleaned rows, and its audit, which is counted by the job that uses the result (once: write it).

    The rows are read and grouped by their keys once; sums of each mesh come from the same exchange. Rows
    without a mesh are left out (clean leaves none). The counts of rows are taken where each is exact; those
    of meshes may count a mesh again if a lost executor's part is computed again, so compare them with
    what was written.
    """
    near = F.coalesce(F.col("distance_from_fdnpp_km") <= params.distance_cutoff_km, F.lit(False))
    rest = [*order, *[c for c in df.columns if c not in KEYS and c not in order]]
    grouped = df.filter(F.col(MESH).isNotNull()).groupBy(*KEYS, near.alias("_near")).agg(F.count(F.lit(1)).alias("_copies"), F.min(F.struct(*rest)).alias("_first"))
    limit = F.col("_first.detection_lower_limit")
    detected = F.col("_near") & F.col(VALUE).isNotNull() & (limit.isNull() | F.coalesce(F.col(VALUE) > limit, F.lit(False)))
    single = grouped.withColumn("_detected", detected)

    # Of each mesh: from sums by date and type, of which there are few.
    here = lambda x: F.when(F.col("_detected"), x)
    parts = single.groupBy(MESH, DATE, TYPE).agg(
        F.sum("_copies").alias("_copies"), F.bool_or("_near").alias("_near"), F.count_if("_detected").alias("_n"), F.sum(here(F.col(VALUE))).alias("_sum")
    )
    dated = parts.groupBy(MESH, DATE).agg(F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"), F.bool_or("_near").alias("_near"), F.sum("_copies").alias("_copies"))
    dates = F.col(DATE).isNotNull() & (F.col("_n") > 0)
    meshes = dated.groupBy(MESH).agg(
        F.count_if(dates).alias("n_dates"), F.min(F.when(dates, F.struct(DATE, "_sum", "_n"))).alias("_f"), F.bool_or("_near").alias("_any_near"),
        (F.sum("_n") > 0).alias("_any_detected"), F.sum("_copies").alias("_loaded"),
    )
    # Conditions instead of filters, and copies in both: else the branches differ below their exchange, and it isn't shared.
    of_types = parts.groupBy(MESH, TYPE).agg(F.sum("_n").alias("count"), F.sum("_copies").alias("_copies"))
    there = F.col(TYPE).isNotNull() & (F.col("count") > 0)
    best = F.min(F.when(there, F.struct(-F.col("count"), type_rank(F.col(TYPE)), F.col(TYPE).alias("type")))).alias("best")
    typed = F.sum(F.when(F.col(TYPE).isNotNull(), F.col("_copies"))).alias("_typed")
    winners = of_types.groupBy(MESH).agg(best, F.count_if(there).alias("_n_types"), typed)
    winners = winners.select(F.col(MESH).alias("_of"), F.col("best.type").alias("_winner"), "_n_types", "_typed")
    facts = meshes.join(winners, F.col(MESH) == F.col("_of"), "left").withColumn("_first_mean", F.try_divide("_f._sum", F.col("_f._n")))
    dose = F.coalesce(F.col("_first_mean") > params.dose_threshold, F.lit(False))
    long_enough = F.coalesce(F.col("n_dates") >= params.min_dates, F.lit(False))
    passing = [F.lit(True), F.col("_any_near"), F.col("_any_near"), F.col("_any_detected")]
    passing += [passing[3] & dose, passing[3] & dose & long_enough, passing[3] & dose & long_enough & F.col("_winner").isNotNull()]
    mixed = F.count_if(passing[5] & (F.col("_n_types") > 1)).alias("mixed")
    of_meshes, of_rows = Observation(), Observation()
    loaded = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("loaded", "_loaded"), ("typed", "_typed"))]
    facts = facts.observe(of_meshes, *[F.count_if(x).alias(f"m{k}") for k, x in enumerate(passing)], mixed, *loaded)
    facts = facts.select(F.col(MESH).alias("_mesh"), dose.alias("_dose"), long_enough.alias("_long"), "_winner")

    joined = single.join(facts, F.col(MESH) == F.col("_mesh"), "left")
    gates = [F.col("_near"), F.lit(True), F.col("_detected"), F.col("_dose"), F.col("_long"), F.coalesce(F.col(TYPE) == F.col("_winner"), F.lit(False))]
    passed, before = F.lit(0), F.lit(True)
    for gate in gates:
        before = before & gate
        passed = passed + before.cast("int")
    graded_rows = joined.withColumn("_passed", passed)
    counts = [F.coalesce(F.sum(F.when(F.col("_passed") >= k, F.col("_copies") if k < 2 else F.lit(1))), F.lit(0)).alias(f"r{k}") for k in range(len(STAGES))]
    kept = graded_rows.observe(of_rows, *counts).filter(F.col("_passed") == len(STAGES) - 1)
    return kept.select(*[F.col(c) if c in KEYS else F.col(f"_first.{c}").alias(c) for c in df.columns]), Audit(of_rows, of_meshes)


def item_breakdown(df: DataFrame, order: list[str], params: Params = DEFAULT, files: DataFrame | None = None) -> DataFrame:
    """Rows and meshes of each source item before and after filtering; with files (archives.file_audit), also its ZIP files."""
    last = F.col("passed") == len(STAGES) - 1
    found = graded(df, order, params).groupBy("source_item").agg(
        F.sum("copies").alias("rows_loaded"), F.count_if(last).alias("rows_final"), F.countDistinct(F.when(last, F.col(MESH))).alias("meshes_final")
    )
    if files is None:
        return found
    return _with_zips(found, files)


def _with_zips(found: DataFrame, files: DataFrame) -> DataFrame:
    zips = files.groupBy(F.element_at(F.split("path", "/"), -2).alias("source_item")).agg(F.countDistinct("path").alias("zips_processed"))
    return zips.join(found, "source_item", "left").fillna(0, ["rows_loaded", "rows_final", "meshes_final"])


def written_breakdown(clean_rows: DataFrame, final: DataFrame, files: DataFrame) -> DataFrame:
    """item_breakdown from cleaned rows (one column of them) and the result as it was written: no stage runs again."""
    loaded = clean_rows.groupBy("source_item").agg(F.count(F.lit(1)).alias("rows_loaded"))
    kept = final.groupBy("source_item").agg(F.count(F.lit(1)).alias("rows_final"), F.countDistinct(MESH).alias("meshes_final"))
    return _with_zips(loaded.join(kept, "source_item", "left"), files)


def compared(found: DataFrame, low: float, high: float, least: int) -> DataFrame:
    """The rows that are in the result under either threshold, with in_low and in_high. found: rows after stage 2."""
    meshes = mesh_facts(found).filter((F.col("n_dates") >= least) & (F.col("first_mean") > min(low, high)))
    meshes = meshes.select(MESH, F.col("winner").alias(TYPE), (F.col("first_mean") > low).alias("in_low"), (F.col("first_mean") > high).alias("in_high"))
    return found.join(meshes, [MESH, TYPE])


def sensitivity(found: DataFrame, low: float, high: float, least: int) -> DataFrame:
    """One row: rows, meshes and years under two thresholds, and what they share. found: rows after stage 2.

    row_overlap is the number of different (mesh, date, value) in both over the rows under low.
    """
    sides = (("low", F.col("in_low")), ("high", F.col("in_high")))
    keys = compared(found, low, high, least).groupBy(MESH, DATE, VALUE).agg(
        *[F.count_if(here).alias(f"rows_{n}") for n, here in sides],
        *[f(F.when(here, F.year(DATE))).alias(f"{w}_year_{n}") for n, here in sides for w, f in (("min", F.min), ("max", F.max))],
    )
    shared = F.count_if((F.col("rows_low") > 0) & (F.col("rows_high") > 0)).alias("shared")
    years = [f(f"{w}_year_{n}").alias(f"{w}_year_{n}") for n, _ in sides for w, f in (("min", F.min), ("max", F.max))]
    per_mesh = keys.groupBy(MESH).agg(*[F.sum(f"rows_{n}").alias(f"rows_{n}") for n, _ in sides], shared, *years)
    here = [F.col(f"rows_{n}") > 0 for n, _ in sides]
    total = per_mesh.agg(
        F.count_if(here[0]).alias("meshes_low"),
        F.count_if(here[1]).alias("meshes_high"),
        F.count_if(here[0] & here[1]).alias("meshes_both"),
        F.count_if(here[0] & ~here[1]).alias("only_low"),
        F.count_if(~here[0] & here[1]).alias("only_high"),
        *[F.coalesce(F.sum(f"rows_{n}"), F.lit(0)).alias(f"rows_{n}") for n, _ in sides],
        F.coalesce(F.sum("shared"), F.lit(0)).alias("shared"),
        *[f(f"{w}_year_{n}").alias(f"{w}_year_{n}") for n, _ in sides for w, f in (("min", F.min), ("max", F.max))],
    )
    fraction = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 4)
    return total.withColumn("row_overlap", fraction("shared", "rows_low")).withColumn("mesh_overlap", fraction("meshes_both", "meshes_low")).drop("shared")


def sensitivity_by(found: DataFrame, low: float, high: float, least: int, by: Column) -> DataFrame:
    """part, rows_low, rows_high for each value of by: the source class, or band()."""
    rows = compared(found, low, high, least)
    return rows.groupBy(by.alias("part")).agg(F.count_if("in_low").alias("rows_low"), F.count_if("in_high").alias("rows_high"))


def band(width: float = 20.0, last: float = 80.0) -> Column:
    """Lower bound of the distance band; the last band holds its upper bound as well."""
    return F.least(F.floor(F.col("distance_from_fdnpp_km") / width) * width, F.lit(last - width)).cast("long")


def distance_bands(df: DataFrame, width: float = 20.0, last: float = 80.0) -> DataFrame:
    """band (lower bound), rows, meshes."""
    return df.groupBy(band(width, last).alias("band")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(MESH).alias("meshes"))


def cleaning_counts() -> list[Column]:
    """Aggregates over raw text: rows, those dropped by each gate of clean in its order, distances computed, rows that stay."""
    lat, lon, far = (scalars.number(F.col(c)) for c in ("latitude", "longitude", "distance_from_fdnpp_km"))
    unplaced = lat.isNull() | lon.isNull()
    gates = {
        "dropped_category": ~scalars.is_dose_rate(F.col("category")),
        "dropped_date": scalars.timestamp(F.col(DATE)).isNull(),
        "dropped_place": unplaced & far.isNull(),
        "dropped_mesh": scalars.mesh_id(F.col(MESH)).isNull(),
    }
    first = F.coalesce(*[F.when(gate, F.lit(name)) for name, gate in gates.items()], F.lit("kept"))
    return [
        F.count(F.lit(1)).alias("rows_loaded"),
        *[F.count_if(first == name).alias(name) for name in gates],
        F.count_if(first.isin("kept", "dropped_mesh") & ~unplaced & far.isNull()).alias("distances_computed"),
        F.count_if(first == "kept").alias("rows_after"),
    ]


def cleaning_audit(raw: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """cleaning_counts of raw rows, as one row."""
    return raw.agg(*cleaning_counts())


def cleaned_and_counted(raw: DataFrame, params: Params = DEFAULT) -> tuple[DataFrame, Observation]:
    """clean, and cleaning_counts of what it reads, taken by the job that writes its result."""
    seen = Observation()
    return clean(raw.observe(seen, *cleaning_counts()), params), seen


def final_summary(final: DataFrame) -> DataFrame:
    """One row: size and ranges of the filtered measurements."""
    numbers = (("year", "year"), ("distance_from_fdnpp_km", "distance"), (VALUE, "value"))
    return final.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.countDistinct(MESH).alias("total_meshes"),
        F.countDistinct("source_item").alias("total_items"),
        *[f(c).alias(f"{n}_{w}") for c, n in numbers for w, f in (("min", F.min), ("max", F.max))],
        F.count_if("is_decontaminated").alias("is_decontaminated_true"),
        F.count_if("height_anomalous").alias("height_anomalous_true"),
    )


def final_counts(final: DataFrame, columns: tuple[str, ...] = (TYPE, "organization", "source_class")) -> DataFrame:
    """part (column), name, rows: the rows of each value of each of the columns."""
    rows = final.select(F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("name")) for c in columns if c in final.columns])).alias("x"))
    return rows.groupBy("x.part", "x.name").agg(F.count(F.lit(1)).alias("rows"))


def profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, meshes and dates of a table of measurements, before anything is computed from it."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(MESH).alias("meshes"), F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date")
    ).withColumn("columns", F.lit(",".join(df.columns)))
