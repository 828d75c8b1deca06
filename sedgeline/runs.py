"""The phases of the engine from files to files: acquisition tasks, filtering, features, clustering.

Each function reads and writes tables under the paths it is given and returns its summary. What is used
several times (cleaned rows, the feature matrix) is written once and read again.
"""

from __future__ import annotations

import json
import logging
import time
import urllib.request
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.operators import cluster, figures, preparation, series, som, stages
from sedgeline.operators.storage import cut
from sedgeline.params import DEFAULT, FEATURES, Params
from sedgeline.sources import archives, download, tables

log = logging.getLogger("sedgeline")
#: Load order of readings: of repeated ones the first stays.
ORDER = ["path", "member", "row_no"]


def _rows(df: DataFrame) -> list[dict]:
    """A small report as dictionaries."""
    return [r.asDict(recursive=True) for r in df.collect()]


def fetch_catalog(spark: SparkSession, url: str, path: str, timeout: float = 60.0, agent: str = "sedgeline") -> None:
    """The catalog of items (JSON with a data list) to the folder path. An answer without data is an error."""
    request = urllib.request.Request(url, headers={"User-Agent": agent})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        found = json.loads(answer.read().decode("utf-8"))
    if "data" not in found:
        raise ValueError(f"the catalog has no data key, but {sorted(found)}")
    tables.write_json(spark, found, path)


def plan_downloads(spark: SparkSession, catalog: str, state: str | None = None, first_year: int = 2011, last_year: int = 2024) -> DataFrame:
    """The tasks of a saved catalog that are still to be done, in order of their paths."""
    if first_year > last_year:
        raise ValueError("the first year is after the last one")
    tasks = archives.task_list(archives.catalog(spark, catalog), first_year, last_year)
    if state:
        tasks = archives.open_tasks(tasks, archives.current_state(spark, state))
    return tasks.orderBy("output_path")


def download_archives(
    spark: SparkSession,
    catalog: str,
    settings: download.Settings,
    root: str,
    state: str,
    first_year: int = 2011,
    last_year: int = 2024,
    connections: int = 1,
) -> dict:
    """Every open task of the catalog: archives under root/dataset, what became of them to state, a manifest beside them.

    As many archives as connections are fetched at once, as one job with one commit: a run that is stopped
    loses these entries at most, and no archive that was stored. Failed tasks are tried again by the next run.
    """
    tasks = plan_downloads(spark, catalog, state, first_year, last_year)
    waiting: list[dict] = []
    done = 0

    def go() -> None:
        nonlocal done, waiting
        if waiting:
            download.store(download.downloads(spark, waiting, settings, root), state, root)
            done += len(waiting)
            log.info("%d tasks are done", done)
            waiting = []

    for task in tasks.toLocalIterator():
        waiting.append(task.asDict())
        if len(waiting) == max(1, connections):
            go()
    go()
    made = archives.manifest(archives.catalog(spark, catalog), archives.current_state(spark, state))
    tables.write_json(spark, made, f"{root}/dataset/_manifest")
    return made


def _cleaned(spark: SparkSession, dataset: str, output: str, params: Params) -> tuple[dict, DataFrame, DataFrame]:
    """Counts of the cleaning, files, and cleaned rows; the archives are unpacked once, and raw rows read once."""
    archives.read_archives(spark, dataset).write.mode("overwrite").parquet(f"{output}/_raw")
    found = spark.read.parquet(f"{output}/_raw")
    log.info("archives are read")
    rows, seen = stages.cleaned_and_counted(archives.measurements(found), params)
    rows.write.mode("overwrite").parquet(f"{output}/_clean")
    log.info("rows are cleaned: %s", seen.get)
    return dict(seen.get), archives.file_audit(found), spark.read.parquet(f"{output}/_clean")


def filter_measurements(spark: SparkSession, dataset: str, output: str, params: Params = DEFAULT, csv: bool = False) -> dict:
    """Archives under dataset to output/filtered (Parquet) and output/filter_summary (JSON).

    One job over the cleaned rows runs all stages, writes what they keep and counts for the audit. Rows with
    nulls in columns that may have none are left out at the end and counted.
    """
    cleaning, files, clean = _cleaned(spark, dataset, output, params)
    final, audit = stages.audited(clean, ORDER, params)
    tables.write_measurements(tables.complete_rows(final), f"{output}/filtered")
    written = spark.read.parquet(f"{output}/filtered")
    log.info("stages are written")
    if csv:
        tables.write_csv(written, f"{output}/filtered_csv")
    counts: dict[str, dict] = {}
    for r in _rows(stages.final_counts(written)):
        counts.setdefault(f"{r['part']}_counts", {})[str(r["name"])] = r["rows"]
    size = _rows(stages.final_summary(written))[0]
    by_stage = audit.rows()
    incomplete = by_stage[-1]["rows"] - size["total_rows"]
    if incomplete < 0 or (incomplete == 0 and by_stage[-1]["meshes"] != size["total_meshes"]):
        # An executor was lost and a part counted twice: count anew.
        log.warning("the counts of the stages don't agree with what was written; they are counted again")
        by_stage = _rows(stages.stage_audit(clean, ORDER, params))
        incomplete = by_stage[-1]["rows"] - size["total_rows"]
    summary = {
        "parameters": asdict(params),
        "file_discovery": {r["status"]: r["files"] for r in archives.status_counts(files).collect()},
        "cleaning": cleaning,
        "stages": by_stage,
        "final_output": size | counts | {"rows_incomplete": incomplete},
        "per_item_breakdown": _rows(stages.written_breakdown(clean, written, files)),
    }
    tables.write_json(spark, summary, f"{output}/filter_summary")
    return summary


def compare_thresholds(spark: SparkSession, dataset: str, output: str, params: Params = DEFAULT, low: float = 0.10, high: float = 0.15) -> dict:
    """What two dose thresholds keep, to output/sensitivity_comparison. The archives are read once."""
    _, _, clean = _cleaned(spark, dataset, output, params)
    found = stages.stage_2_detection(stages.deduplicate(stages.stage_1_distance(clean, params), ORDER))
    found.write.mode("overwrite").parquet(f"{output}/_detected")
    found = spark.read.parquet(f"{output}/_detected")
    parts = {n: _rows(stages.sensitivity_by(found, low, high, params.min_dates, by)) for n, by in (("per_class", F.col("source_class")), ("per_band", stages.band()))}
    summary = {"thresholds": [low, high], "comparison": _rows(stages.sensitivity(found, low, high, params.min_dates))[0]} | parts
    tables.write_json(spark, summary, f"{output}/sensitivity_comparison")
    return summary


def build_features(spark: SparkSession, measurements: str, output: str, params: Params = DEFAULT, csv: bool = False, expected_rows: int | None = None) -> dict:
    """Filtered measurements to output/feature_matrix (Parquet), output/feature_summary (JSON) and output/preparation (the fitted model)."""
    began, steps = time.perf_counter(), {}

    def done(name: str) -> None:
        nonlocal began
        now = time.perf_counter()
        steps[name], began = round(now - began, 2), now

    rows = tables.read_checked(spark, measurements)
    series.feature_matrix(rows, params).write.mode("overwrite").parquet(f"{output}/_features")
    raw = spark.read.parquet(f"{output}/_features")
    done("features")
    counts = _rows(series.imputation_counts(raw))
    model = preparation.fit_preparation(raw)
    model.write().overwrite().save(f"{output}/preparation")
    fitted = model.stages[1].fitted()
    done("fit")
    tables.write_features(model.transform(raw), f"{output}/feature_matrix")
    matrix = spark.read.parquet(f"{output}/feature_matrix")
    done("write")
    if csv:
        tables.write_csv(matrix, f"{output}/feature_matrix_csv")
    z = tuple(f"{c}_z" for c in FEATURES)
    summary = {
        "parameters": asdict(params),
        "output_rows": matrix.count(),
        "output_columns": len(matrix.columns),
        "per_feature_statistics": _rows(series.feature_stats(matrix)),
        "imputation_counts": counts,
        "normalization_params": {c: {"feature": c, "median": m, "q25": a, "q75": b, "iqr": iqr} for c, (m, a, b, iqr) in fitted.items()},
        "sanity_checks": _rows(series.sanity(matrix, expected_rows)),
        "correlations": _rows(series.correlations(matrix, z)),
        "high_correlation_pairs": _rows(series.close_pairs(matrix, z)),
    }
    done("summary")
    tables.write_json(spark, summary | {"step_timing_seconds": steps}, f"{output}/feature_summary")
    return summary


def cluster_features(
    spark: SparkSession,
    features: str,
    scaling: str,
    output: str,
    grids: tuple[som.Grid, ...] = som.GRIDS,
    seeds: tuple[int, ...] = som.SEEDS,
    how: som.Training = som.Training(20, (0.05, 0.01)),
    draws: int = 100,
    expected_rows: int | None = None,
) -> dict:
    """A scaled feature matrix to clusters, their tables and measures under output.

    Models are kept under output/models by their configuration, and found again by it. how: passes, rates and
    radius of their training, all of them in one job a pass.
    """
    matrix = spark.read.parquet(features)
    z = [f"{c}_z" for c in FEATURES]
    series.check_matrix(matrix, z)
    n = matrix.count()
    if expected_rows is not None and n != expected_rows:
        raise ValueError(f"{n} rows, not {expected_rows}")
    vectors = matrix.withColumn("vector", F.array(*[F.col(c).cast("double") for c in z]))
    config = {"features": features, "rows": n, "grids": [asdict(g) for g in grids], "seeds": seeds, "training": asdict(how)}
    runs = tables.read_runs(spark, f"{output}/models", config)
    if runs is None:
        runs = som.train_runs(cut(vectors.select("vector")), grids, seeds, how=how)
        tables.write_runs(spark, runs, f"{output}/models", config)
    table = som.runs_table(spark, runs)
    assigned = som.assign_runs(vectors.select("vector"), runs)
    same_grid = [[r.name for r in runs if r.grid == g] for g in grids]
    pairs = None
    for names in same_grid:
        if len(names) > 1:
            found = som.ari_matrix(assigned, names)
            pairs = found if pairs is None else pairs.unionByName(found)
    if pairs is None:
        pairs = spark.createDataFrame([], "a string, b string, ari double")
    pairs = spark.createDataFrame(pairs.collect(), "a string, b string, ari double")  # a row for each pair of runs
    summary_of_grids = som.grid_summary(table, pairs)
    chosen = cluster.select_model(table, summary_of_grids).first()
    run = next(r for r in runs if f"{r.grid.columns}x{r.grid.rows}" == chosen["grid"] and r.seed == chosen["seed"])

    mapped = som.assign(vectors, run.codebook).withColumnRenamed("bmu", "som_bmu")
    sizes = {r["neuron"]: r["n"] for r in som.node_counts(mapped.withColumnRenamed("som_bmu", "bmu"), run.grid).collect()}
    k = cluster.choose_k(run.codebook, sizes)
    of_neuron = cluster.cut_tree(cluster.ward(run.codebook), len(run.codebook), k)
    mapped = mapped.withColumn("som_cluster", F.element_at(F.array(*[F.lit(c) for c in of_neuron]), F.col("som_bmu")))
    means = {r["som_cluster"]: r for r in cluster.centroids(mapped, z, "som_cluster").collect()}
    order = sorted(means)
    labels = dict(zip(order, cluster.auto_labels([{c: means[i][f"{c}_z"] for c in FEATURES} for i in order]), strict=True))
    label = F.element_at(F.create_map(*[x for i, name in labels.items() for x in (F.lit(i), F.lit(name))]), F.col("som_cluster"))
    tables.write_clusters(mapped.withColumn("som_cluster_label", label).drop("vector", "bmu_distance", "second"), f"{output}/som_clusters")
    clustered = spark.read.parquet(f"{output}/som_clusters")

    fitted = tables.read_scaling(spark, scaling)
    table_1 = cluster.cluster_summary(clustered, fitted, labels, FEATURES, "som_cluster").orderBy("cluster_id")
    tables.write_table_csv(table_1, f"{output}/som_cluster_summary")
    columns = [F.col("mesh_id_250m").alias("mesh_id"), "latitude", "longitude", "som_cluster", "som_cluster_label"]
    tables.write_csv(clustered.select(*columns), f"{output}/som_cluster_assignments", mark=False)
    scores = _rows(figures.optimal_k(spark, run.codebook, 10, draws))
    metrics = {
        "input_file": features,
        "n_observations": n,
        "n_features": len(z),
        "training_config": {"rlen": how.rlen, "alpha": how.alpha, "mode": "sequential" if how.alpha else "batch", "shares": how.shares, "neighbourhood": "bubble" if how.bubble else "gaussian", "distance": "euclidean", "seeds": list(seeds), "grids": [f"{g.columns}x{g.rows}" for g in grids]},
        "all_runs": _rows(table.orderBy("run_id")),
        "grid_comparison": _rows(summary_of_grids.orderBy("grid")),
        "ari": _rows(pairs.orderBy("a", "b")),
        "selected_model": chosen.asDict() | {"n_neurons": len(run.codebook)},
        "hierarchical_clustering": {
            "method": "ward",
            "k_selected": k,
            "k_silhouette": max(scores, key=lambda r: (r["silhouette"], -r["k"]))["k"],
            "k_gap": cluster.gap_statistic(run.codebook, 10, draws)[2],
            "scores": scores,
        },
        "clusters": [r | {"centroid_z": {c: means[r["cluster_id"]][c] for c in z}, "neurons": [i + 1 for i, c in enumerate(of_neuron) if c == r["cluster_id"]]} for r in _rows(table_1)],
    }
    tables.write_json(spark, metrics, f"{output}/som_metrics")
    return metrics
