"""The phases from ZIP files to the feature and cluster tables, and the tables' checks."""

import json
import zipfile
from datetime import date, datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgeline import __main__ as command
from sedgeline import runs, streaming
from sedgeline.functions import scalars
from sedgeline.operators import cluster, figures, series, som, stages
from sedgeline.params import FEATURES, REQUIRED, Params
from sedgeline.sources import archives, tables


def _line(mesh, day, value, kind="Walk", distance="10", category="空間線量率", height="100", state=""):
    cells = [""] * 37
    for place, cell in ((0, category), (1, kind), (4, "37.5"), (5, "140.9"), (11, day), (12, value), (17, height), (25, state), (32, mesh), (36, distance)):
        cells[place] = cell
    return ",".join(cells)


@pytest.fixture(scope="module")
def dataset(tmp_path_factory):
    top = tmp_path_factory.mktemp("dataset")
    rng = np.random.default_rng(3)
    lines = []
    for m in range(60):
        start = date(2011, 6, 1) + timedelta(days=int(rng.integers(0, 300)))
        rate, level = rng.uniform(1e-4, 1.5e-3), rng.uniform(0.3, 3)
        for k in range(14):
            day = start + timedelta(days=150 * k + int(rng.integers(0, 30)))
            value = level * np.exp(-rate * (day - start).days) * rng.uniform(0.9, 1.1) * (1.9 if m % 9 == 0 and k in (5, 6) else 1)
            lines.append(_line(f"m{m}", day.isoformat(), f"{value:.4f}", "Car" if m % 5 == 0 and k < 3 else "Walk", str(5 + m), state="除染後" if m % 7 == 0 else ""))
    lines += [lines[0], _line("far", "2012-01-01", "1", distance="80.0001"), _line("soil", "2012-01-01", "1", category="soil"), _line("few", "2012-01-01", "1")]
    lines += [_line("　", "2012-01-01", "1"), _line("undated", "bad", "1")]
    header = ",".join(f"h{i}" for i in range(37))
    for item, part in (("item_001", lines[::2]), ("item_002", lines[1::2])):
        folder = top / "03_walk_survey" / item
        folder.mkdir(parents=True)
        with zipfile.ZipFile(folder / "2012.zip", "w") as z:
            z.writestr("a.csv", "\n".join([header, *part]).encode("shift_jis"))
    (top / "03_walk_survey" / "item_002" / "2013.zip").write_bytes(b"broken")
    return str(top)


@pytest.fixture(scope="module")
def output(spark, dataset, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("output"))
    filtered = runs.filter_measurements(spark, dataset, out, csv=True)
    features = runs.build_features(spark, f"{out}/filtered", out, csv=True, expected_rows=60)
    clustered = runs.cluster_features(spark, f"{out}/feature_matrix", f"{out}/feature_summary", out, (som.Grid(3, 3), som.Grid(4, 3)), (1, 2), som.Training(20, (0.05, 0.01)), draws=5, expected_rows=60)
    return out, filtered, features, clustered


def test_filter(spark, output):
    out, summary, _, _ = output
    by_stage = {r["stage"]: r for r in summary["stages"]}
    assert summary["file_discovery"] == {"ok": 2, "corrupt": 1}
    cleaning = summary["cleaning"]
    assert (cleaning["rows_loaded"], cleaning["dropped_category"], cleaning["dropped_date"], cleaning["dropped_mesh"], cleaning["rows_after"]) == (846, 1, 1, 1, 843)
    assert by_stage["1_distance"]["rows_dropped"] == 1 and by_stage["4_temporal"]["meshes_dropped"] >= 1 and by_stage["5_type"]["mixed_meshes"] == 12
    assert summary["final_output"]["total_meshes"] == 60 and summary["final_output"]["measurement_type_counts"].keys() == {"Walk"}
    items = {r["source_item"]: r for r in summary["per_item_breakdown"]}
    assert items["item_002"]["zips_processed"] == 2 and sum(r["rows_final"] for r in items.values()) == summary["final_output"]["total_rows"]
    found = spark.read.parquet(f"{out}/filtered")
    assert found.columns == list(tables.MEASUREMENTS) and dict(found.dtypes)["value"] == "float" and dict(found.dtypes)["correction_date"] == "date"
    assert tables.read_json(spark, f"{out}/filter_summary")["stages"] == json.loads(json.dumps(summary["stages"]))
    assert any(f.read_bytes().startswith("\ufeffcategory,".encode()) for f in Path(out, "filtered_csv").glob("part*"))


def test_features(spark, output):
    out, _, summary, _ = output
    matrix = spark.read.parquet(f"{out}/feature_matrix")
    assert summary["output_rows"] == 60 and matrix.columns == list(tables.FEATURE_COLUMNS)
    series.check_matrix(matrix, [f"{c}_z" for c in FEATURES])
    checks = {r["check"]: r for r in summary["sanity_checks"]}
    assert checks["row_count"]["outcome"] == "passed" and checks["decontaminated_cells"]["value"] == 9 and checks["positive_slope_pct"]["value"] < 20
    fitted = {r.feature: r for r in tables.read_scaling(spark, f"{out}/feature_summary").collect()}
    assert set(fitted) == set(FEATURES) and len(summary["correlations"]) == 36
    q = matrix.agg(F.percentile("residual_cv", [0.25, 0.5, 0.75])).first()[0]
    assert [fitted["residual_cv"].q25, fitted["residual_cv"].median, fitted["residual_cv"].q75] == pytest.approx(list(q))


def test_clusters(spark, output):
    out, _, _, metrics = output
    found = spark.read.parquet(f"{out}/som_clusters")
    k = metrics["hierarchical_clustering"]["k_selected"]
    assert {"som_bmu", "som_cluster", "som_cluster_label"} <= set(found.columns) and found.count() == 60
    assert sum(c["n_observations"] for c in metrics["clusters"]) == 60 and len(metrics["clusters"]) == k
    assert len(metrics["all_runs"]) == 4 and len(metrics["ari"]) == 2 and len(metrics["grid_comparison"]) == 2
    chosen = metrics["selected_model"]
    best = min((r for r in metrics["all_runs"] if r["grid"] == chosen["grid"]), key=lambda r: r["qe"])
    assert chosen["seed"] == best["seed"] and all(0 <= r["te"] <= 1 for r in metrics["all_runs"])
    table = spark.read.option("header", True).csv(f"{out}/som_cluster_summary")
    assert len(table.columns) == 4 + len(FEATURES) + 3 and table.count() == k
    config = {"features": f"{out}/feature_matrix", "rows": 60, "grids": [{"columns": 3, "rows": 3}, {"columns": 4, "rows": 3}], "seeds": (1, 2), "training": {"rlen": 20, "alpha": (0.05, 0.01), "shares": 1, "bubble": False}}
    kept = tables.read_runs(spark, f"{out}/models", config)
    assert len(kept) == 4 and tables.read_runs(spark, f"{out}/models", config | {"training": {"rlen": 21}}) is None
    neurons = kept[0].grid.columns * kept[0].grid.rows
    labels = cluster.cut_tree(cluster.ward(kept[0].codebook), neurons, 3)
    assert figures.component_planes(spark, kept[0]).count() == neurons * 9 and figures.convergence(spark, kept).count() == 80
    assert figures.umatrix_plane(spark, kept[0], labels).count() == neurons and figures.silhouettes(spark, kept[0].codebook, labels).count() == neurons
    tree = figures.dendrogram(spark, kept[0].codebook, 3)
    assert tree.count() == neurons - 1 and tree.filter("above_cut").count() == 2
    assert figures.mesh_map(found).count() == 60 and figures.centroid_heat(found).count() == k * 9 and figures.boxes(found).count() == k * 9
    bars = figures.size_bars(found).collect()
    assert sum(r.n for r in bars) == 60 and {r.least for r in bars} == {1}
    pairs = spark.createDataFrame([(r["a"], r["b"], r["ari"]) for r in metrics["ari"]], "a string, b string, ari double")
    assert figures.ari_heat(pairs).count() == 2 * 2 + 4
    assigned = som.assign(found.withColumn("vector", F.array(*[F.col(f"{c}_z").cast("double") for c in FEATURES])), kept[0].codebook)
    assert figures.node_plane(assigned, kept[0]).agg(F.sum("n")).first()[0] == 60
    scores = figures.optimal_k(spark, kept[0].codebook, 5, 3).collect()
    assert [r.k for r in scores] == [2, 3, 4, 5] and [r.wss for r in scores] == sorted((r.wss for r in scores), reverse=True)


def test_thresholds_and_inventory(spark, dataset, tmp_path):
    found = runs.compare_thresholds(spark, dataset, str(tmp_path), low=0.10, high=0.8)
    one = found["comparison"]
    assert one["only_high"] == 0 and one["meshes_both"] == one["meshes_high"] < one["meshes_low"] == 60
    assert sum(r["rows_low"] for r in found["per_band"]) == one["rows_low"] and found["per_class"][0]["rows_high"] == one["rows_high"]
    assert 0 < one["row_overlap"] < 1 and one["min_year_low"] == 2011
    files = {(r.source_class, r.source_item): (r.zips, r.csvs) for r in archives.inventory(spark, dataset).collect()}
    assert files[("03_walk_survey", "item_002")] == (2, 1) and files[(None, None)] == (3, 2)


def test_download_state(spark, tmp_path):
    (tmp_path / "catalog.json").write_text(json.dumps({"data": [{"item_code": 1, "class_code": 2, "content_code": 1}, {"item_code": 2, "class_code": 9, "content_code": 2}]}))
    state = str(tmp_path / "state")
    tasks = runs.plan_downloads(spark, str(tmp_path / "catalog.json"), None, 2011, 2013)
    paths = [r.output_path for r in tasks.collect()]
    assert paths == [f"dataset/02_drive_survey/item_001/{y}.zip" for y in (2011, 2012, 2013)]
    archives.record_state(spark.createDataFrame([(paths[0], "completed", None), (paths[1], "failed", "timeout")], "output_path string, status string, error string"), state)
    archives.record_state(spark.createDataFrame([(paths[2], "skipped_empty", None)], "output_path string, status string, error string"), state)
    assert [r.output_path for r in runs.plan_downloads(spark, str(tmp_path / "catalog.json"), state, 2011, 2013).collect()] == [paths[1]]
    archives.record_state(spark.createDataFrame([(paths[1], "completed", None)], "output_path string, status string, error string"), state)
    made = archives.manifest(archives.catalog(spark, str(tmp_path / "catalog.json")), archives.current_state(spark, state))
    assert (made["items_downloaded"], made["files_completed"], made["files_skipped_empty"], made["files_failed"]) == (1, 2, 1, 0)
    with pytest.raises(ValueError):
        runs.plan_downloads(spark, str(tmp_path / "catalog.json"), None, 2014, 2013)
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        archives.catalog(spark, str(tmp_path / "bad.json"))


def test_command_line(spark, dataset, output, tmp_path, capsys):
    assert command.main(["filter", "--dataset-dir", dataset, "--sensitivity", "--dose-threshold", "0.2"]) == 1
    assert command.main(["tasks", "--catalog", "x", "--year-start", "2014", "--year-end", "2013"]) == 1
    assert command.main(["filter", "--dataset-dir", dataset, "--dry-run"]) == 0 and "item_002" in capsys.readouterr().out
    assert command.main(["features", "--input", f"{output[0]}/filtered", "--dry-run"]) == 0 and "2011" in capsys.readouterr().out
    assert command.main(["filter", "--dataset-dir", dataset, "--output-dir", f"{tmp_path}/o", "--min-temporal-points", "20"]) == 0
    assert spark.read.parquet(f"{tmp_path}/o/filtered").count() == 0


def test_gates(spark, output, tmp_path):
    found = spark.read.parquet(f"{output[0]}/filtered")
    holes = found.withColumn("category", F.when(F.col("mesh_id_250m") != "m1", F.col("category")))
    with pytest.raises(ValueError, match="category"):
        tables.write_measurements(holes, f"{tmp_path}/x")
    assert 0 < tables.complete_rows(holes).count() < found.count()
    found.drop("year").write.parquet(f"{tmp_path}/y")
    with pytest.raises(ValueError, match="year"):
        tables.read_checked(spark, f"{tmp_path}/y")
    assert len(REQUIRED) == 12


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=20_000), np.repeat(0.25, 8000), rng.exponential(size=5001)])
    rows = [(float(v), float(i % 3), None if i % 2 else float(i), None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(6)
    got = series.exact_quantiles(df, ("a", "b", "c", "d"), (0.0, 0.25, 0.5, 0.9, 1.0), accuracy=200)
    for k, name in enumerate("abc"):
        column = [r[k] for r in rows if r[k] is not None]
        assert got[name] == pytest.approx(list(np.quantile(column, (0.0, 0.25, 0.5, 0.9, 1.0))))
    assert got["d"] == [None] * 5


def test_stream(spark, tmp_path):
    schema = "mesh_id_250m string, correction_date timestamp, value double, measurement_type string, source_item string, distance_from_fdnpp_km double, detection_lower_limit double"
    day = datetime(2012, 1, 1)
    rows = [("A", day, 1.0, "Walk", "i", 5.0, None), ("A", day, 1.0, "Walk", "i", 5.0, None), ("A", day, 1.0, "Car", "i", 5.0, None), ("A", day, 0.1, "Walk", "i", 5.0, 0.2), ("B", day, 1.0, "Walk", "i", 90.0, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = streaming.filtered(stream).writeStream.format("memory").queryName("kept").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.measurement_type for r in spark.table("kept").collect()) == ["Car", "Walk"]


#: A published clustering's mean z of each cluster, in the order of FEATURES, with its label.
PUBLISHED = (
    ("Slow Retention", (2.112, 1.1304, -0.8249, 0.7534, 0.7215, -0.432, -0.3754, -0.0855, -2.3741)),
    ("Rapid Decay", (0.3031, 0.8321, -1.5036, -0.7977, 0.8551, -0.2538, 2.1701, 1.9675, -1.2949)),
    ("Standard Decay", (0.1352, 0.0718, 0.0271, 0.0321, 0.1253, 0.2505, 0.0587, 0.0007, -0.0187)),
    ("Recontamination/Anomalous", (-0.4268, -0.619, 0.9483, -0.5707, -0.7334, 0.4619, 0.4005, 2.033, -1.2384)),
    ("Consistent Exponential Decay", (0.4103, -0.5514, 1.2681, 0.0677, -0.8769, -0.2827, 0.2461, -0.7705, -2.9484)),
    ("High Variability", (-0.5185, -0.8937, -0.9252, -0.449, -0.9316, 2.6675, 0.0534, -0.0351, -0.0161)),
)


def test_published_labels_and_selection(spark):
    assert cluster.auto_labels([dict(zip(FEATURES, z, strict=True)) for _, z in PUBLISHED]) == [name for name, _ in PUBLISHED]
    # Published measures of the runs, and how alike the runs of a grid are.
    qe = {"5x5": (1.1089, 1.1089, 1.111, 1.1116, 1.1092), "6x6": (1.0169, 1.0183, 1.0178, 1.0177, 1.0216)}
    te = {"5x5": (0.2468, 0.3342, 0.2393, 0.5131, 0.405), "6x6": (0.4666, 0.3837, 0.4982, 0.4592, 0.3729)}
    alike = {"5x5": (0.8773, 0.8038, 0.8967, 0.8722, 0.8437, 0.8666, 0.8764, 0.802, 0.8081, 0.883)}
    names = [f"5x5_seed{s}" for s in som.SEEDS]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    ari = spark.createDataFrame([(a, b, x) for (a, b), x in zip(pairs, alike["5x5"], strict=True)] + [("6x6_seed42", "6x6_seed123", 0.7263)], "a string, b string, ari double")
    table = spark.createDataFrame([(g, s, qe[g][i], te[g][i]) for g in qe for i, s in enumerate(som.SEEDS)], "grid string, seed int, qe double, te double")
    grids = som.grid_summary(table, ari)
    found = {r.grid: r for r in grids.collect()}
    assert found["5x5"].mean_ari == pytest.approx(0.853, abs=1e-3) and found["5x5"].min_ari == 0.802 and found["5x5"].stable and not found["6x6"].stable
    assert found["5x5"].mean_qe == pytest.approx(1.1099, abs=1e-3) and found["6x6"].mean_te == pytest.approx(0.4361, abs=1e-3)
    chosen = cluster.select_model(table, grids).first()
    assert chosen.grid == "5x5" and chosen.qe == 1.1089 and "no grid" in chosen.reason


def test_convergence_windows():
    changes = [1.0] * 2000
    assert som.converged(changes) == (True, 0.0, 1.0)
    changes = [2.0 if 1399 <= i <= 1499 else 1.0 for i in range(2000)]
    assert som.converged(changes) == (False, 0.5, 1.0)


def test_batch_map_quality(spark):
    """Trained maps are near the best quantization that as many means reach, and better than where they began."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 4)) * 4
    points = np.concatenate([c + rng.normal(size=(80, 4)) * 0.3 for c in centres])
    df = spark.createDataFrame([([float(x) for x in p],) for p in points], "vector array<double>").cache()
    run = som.train_runs(df, (som.Grid(4, 4),), (42,), passes=25)[0]
    assert run.qe < run.changes[0] and run.qe < 1.0 and run.te < 0.5
    assert all(b <= a * 1.05 for a, b in zip(run.changes[-6:], run.changes[-5:], strict=False))


def test_gap_statistic():
    rng = np.random.default_rng(2)
    groups = np.concatenate([rng.normal(size=(10, 3)) * 0.1 + c for c in ((0, 0, 0), (6, 0, 0), (0, 6, 0))])
    gaps, errors, best = cluster.gap_statistic(groups, 6, 20)
    assert best == 3 and gaps[2] > gaps[1] and all(e > 0 for e in errors)
    assert cluster._spread(np.array([[0.0], [2.0], [5.0]]), [1, 1, 2]) == pytest.approx(0.5 * (2 * 2 / 4))


def test_clean_rows_without_place(spark):
    rows = [("空間線量率", "2012-01-01", None, "140", None, "m"), (None, "2012-01-01", "37.5", "140.9", None, "m"), ("soil", "2012-01-01", "37", "140", "1", "m")]
    raw = spark.createDataFrame(rows, "category string, correction_date string, latitude string, longitude string, distance_from_fdnpp_km string, mesh_id_250m string")
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in ("value", "statistical_error", "detection_lower_limit", "measurement_height_cm", "sampling_point_state", "note")})
    found = stages.clean(raw, Params()).collect()
    assert len(found) == 1 and 10 < found[0].distance_from_fdnpp_km < 20
    audit = stages.cleaning_audit(raw).first()
    assert (audit.dropped_category, audit.dropped_place, audit.distances_computed, audit.rows_after) == (1, 1, 1, 1)


def test_rounding_and_back_transform(spark):
    df = spark.createDataFrame([(0.125, 123456.0), (0.375, -0.00012345), (2.5, 0.0)], "a double, b double")
    got = df.select(scalars.half_even(F.col("a"), 2), scalars.significant(F.col("b"), 4)).collect()
    assert [tuple(r) for r in got] == [(0.12, 123500.0), (0.38, -0.0001234), (2.5, 0.0)] or got[1][1] == -0.0001235
    z = spark.createDataFrame([(1, "a", 2.0), (1, "flat", 0.0)], "cluster int, feature string, z double")
    params = spark.createDataFrame([("a", 5.0, 3.0), ("flat", 7.0, None)], "feature string, median double, iqr double")
    assert {r.feature: r.value for r in cluster.back_transform(z, params).collect()} == {"a": 11.0, "flat": 7.0}
