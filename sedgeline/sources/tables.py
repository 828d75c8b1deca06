"""Tables of the run functions: checks when they are read, and column order, types and gates when they are written.

All paths are Spark paths, so that any store works; nothing is opened on the driver's own disk.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.operators import som
from sedgeline.params import FEATURES, REQUIRED

#: Columns of the filtered measurements in order, with their types; those of the second list have no nulls.
MEASUREMENTS = {
    "category": "string", "measurement_type": "string", "organization": "string", "mesh_code": "string", "latitude": "float", "longitude": "float",
    "prefecture": "string", "city": "string", "correction_date": "date", "value": "float", "statistical_error": "float", "detection_lower_limit": "float",
    "unit": "string", "measurement_height_cm": "float", "sampling_point_state": "string", "note": "string", "project_id": "string", "mesh_id_250m": "string",
    "distance_from_fdnpp_km": "float", "year": "smallint", "is_decontaminated": "boolean", "height_anomalous": "boolean", "source_item": "string", "source_class": "string",
}
COMPLETE = (
    "category", "measurement_type", "latitude", "longitude", "correction_date", "value", "mesh_id_250m", "distance_from_fdnpp_km",
    "year", "is_decontaminated", "height_anomalous", "source_item", "source_class",
)
#: Columns of the feature matrix in order, with their types; the scaled ones follow.
FEATURE_COLUMNS = {
    "mesh_id_250m": "string", "log_linear_slope": "double", "log_linear_r2": "double", "intercept": "double", "early_slope": "double", "late_slope": "double",
    "initial_dose_rate": "float", "final_dose_rate": "float", "max_dose_rate": "float", "max_dose_timing_days": "float", "n_increases": "double",
    "recontamination_flag": "boolean", "residual_cv": "double", "total_decay_ratio": "double", "ecological_half_life_y": "double", "slope_ratio": "double",
    "temporal_span_years": "double", "has_early_data": "boolean", "n_measurement_dates": "bigint", "temporal_span_days": "bigint",
    "first_measurement_date": "date", "last_measurement_date": "date", "measurement_type": "string", "is_decontaminated": "boolean",
    "height_anomalous_pct": "double", "latitude": "float", "longitude": "float", "distance_from_fdnpp_km": "float",
} | {f"{c}_z": "float" for c in FEATURES}
#: Rows of a row group.
GROUP_ROWS = 500_000


def read_checked(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """A Parquet table that has the columns asked for."""
    found = spark.read.parquet(path)
    if missing := [c for c in required if c not in found.columns]:
        raise ValueError(f"{path} lacks columns: {missing}")
    return found


def _shaped(df: DataFrame, columns: Mapping[str, str], keep_rest: bool) -> DataFrame:
    own = [F.col(c).cast(t).alias(c) for c, t in columns.items() if c in df.columns]
    rest = [c for c in df.columns if c not in columns] if keep_rest else []
    return df.select(*own, *rest)


def incomplete(df: DataFrame, columns: tuple[str, ...] = COMPLETE) -> dict[str, int]:
    """Nulls of the columns that may have none, where there are any."""
    found = [c for c in columns if c in df.columns]
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in found]).first()
    return {c: row[c] for c in found if row[c]}


def complete_rows(df: DataFrame, columns: tuple[str, ...] = COMPLETE) -> DataFrame:
    """The rows without nulls in the columns that may have none."""
    return df.dropna(subset=[c for c in columns if c in df.columns])


def _parquet(df: DataFrame, path: str) -> None:
    writer = df.write.mode("overwrite").option("compression", "snappy").option("parquet.block.row.count.limit", GROUP_ROWS)
    writer.parquet(path)


def write_measurements(df: DataFrame, path: str) -> None:
    """The filtered measurements as Parquet, in one job. Nulls where there may be none are an error; complete_rows drops them before."""
    shaped = _shaped(df, MEASUREMENTS, keep_rest=False)
    message = "nulls in columns that may have none: "
    gate = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"{message}{c}")).cast(MEASUREMENTS[c])).alias(c)
    try:
        _parquet(shaped.select(*[gate(c) if c in COMPLETE else F.col(c) for c in shaped.columns]), path)
    except PySparkException as failed:
        if message in str(failed):
            raise ValueError(f"{message}{', '.join(c for c in COMPLETE if f'{message}{c}' in str(failed))}") from failed
        raise


def write_features(df: DataFrame, path: str) -> None:
    """The feature matrix as Parquet; columns that it doesn't name come last."""
    _parquet(_shaped(df, FEATURE_COLUMNS, keep_rest=True), path)


def write_clusters(df: DataFrame, path: str) -> None:
    """Features with som_bmu, som_cluster and som_cluster_label."""
    if missing := [c for c in ("som_bmu", "som_cluster", "som_cluster_label") if c not in df.columns]:
        raise ValueError(f"the rows lack {missing}")
    write_features(df, path)


def write_series(medians: DataFrame, about: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """series.daily_medians and series.metadata as tables <name>_days and <name>_about, bucketed by mesh, days sorted by date.

    Features with any parameters then need no shuffle (series.matrix_of_series). Medians are bucketed, not
    readings: a mesh has as many rows as dates, however many readings it has, so that no bucket is hot.
    """
    for part, df, order in (("days", medians, ["mesh_id_250m", "date"]), ("about", about, ["mesh_id_250m"])):
        spark = df.sparkSession
        spark.sql(f"drop table if exists {name}_{part}")
        dealt = df.repartition(buckets, "mesh_id_250m")
        dealt.write.mode("overwrite").bucketBy(buckets, "mesh_id_250m").sortBy(*order).option("path", f"{path}/{part}").saveAsTable(f"{name}_{part}")


def read_series(spark: SparkSession, name: str, path: str, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """What write_series wrote; a session that doesn't know the tables is told of the files and their buckets."""
    for part, order in (("days", "mesh_id_250m, date"), ("about", "mesh_id_250m")):
        if not spark.catalog.tableExists(f"{name}_{part}"):
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{part}").schema)
            spark.sql(f"create table {name}_{part} ({columns}) using parquet clustered by (mesh_id_250m) sorted by ({order}) into {buckets} buckets location '{path}/{part}'")
    return spark.table(f"{name}_days"), spark.table(f"{name}_about")


def write_csv(df: DataFrame, path: str, mark: bool = True) -> None:
    """CSV files with a header; mark: each begins with a byte order mark, as spreadsheets like it."""
    first = df.columns[0]
    (df.withColumnRenamed(first, f"\ufeff{first}") if mark else df).write.mode("overwrite").option("header", True).csv(path)


def write_table_csv(df: DataFrame, path: str) -> None:
    """A small table (a row for each cluster) as one CSV file in the folder path."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(spark: SparkSession, summary: Mapping, path: str) -> None:
    """A nested summary as one JSON document in the folder path."""
    text = json.dumps(summary, ensure_ascii=False, indent=2, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def read_scaling(spark: SparkSession, path: str) -> DataFrame:
    """feature, median, q25, q75, iqr of a saved feature summary."""
    fitted = read_json(spark, path)["normalization_params"]
    rows = [(c, p["median"], p["q25"], p["q75"], p["iqr"]) for c, p in fitted.items()]
    return spark.createDataFrame(rows, "feature string, median double, q25 double, q75 double, iqr double")


def run_key(config: Mapping) -> str:
    """Names the models of a configuration: other settings never find them."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def write_runs(spark: SparkSession, runs: list[som.Run], path: str, config: Mapping) -> None:
    rows = [(r.grid.columns, r.grid.rows, r.seed, [[float(x) for x in w] for w in r.codebook], [float(c) for c in r.changes], float(r.qe), float(r.te)) for r in runs]
    schema = "columns int, rows int, seed int, codebook array<array<double>>, changes array<double>, qe double, te double"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{run_key(config)}")


def read_runs(spark: SparkSession, path: str, config: Mapping) -> list[som.Run] | None:
    """The models trained with just this configuration, or None."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{run_key(config)}/_SUCCESS")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = spark.read.parquet(f"{path}/{run_key(config)}").orderBy("columns", "rows", "seed").collect()
    return [som.Run(som.Grid(r["columns"], r["rows"]), r["seed"], np.array(r["codebook"]), list(r["changes"]), r["qe"], r["te"]) for r in rows]
