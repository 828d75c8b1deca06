"""Estimators and their persistence, medians by cases, the audit that is counted while writing, and many maps trained at once."""

import os
import re

import numpy as np
import pytest
from pyarrow import parquet
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from sedgeline.operators import preparation, series, som, stages
from sedgeline.params import FEATURES, Params
from sedgeline.sources import tables


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(3000):
        values = [float(x) for x in rng.normal(size=len(FEATURES))]
        early = None if i % 7 == 0 else values[0]
        row = dict(zip(FEATURES, values, strict=True)) | {"early_slope": early, "slope_ratio": 2.0}
        if i % 11 == 0:
            row["residual_cv"] = None
        rows.append((f"m{i}", *[row[c] for c in FEATURES], i % 14 != 0))
    return spark.createDataFrame(rows, "mesh string, " + ", ".join(f"{c} double" for c in FEATURES) + ", has_early_data boolean").repartition(5).cache()


def plain_scaled(pdf):
    out = {}
    for c in FEATURES:
        x = pdf[c].astype(float).copy()
        if c == "early_slope":
            x[x.isna() & ~pdf["has_early_data"]] = 0.0
        x = x.fillna(pdf[c].median())
        a, m, b = np.quantile(x, [0.25, 0.5, 0.75])
        out[c] = np.clip((x - m) / (b - a), -3, 3) if b - a >= 1e-12 else x * 0
    return out


def test_a_saved_pipeline_gives_equal_scores(features, tmp_path):
    model = Pipeline(stages=[preparation.MedianImputer(), preparation.RobustScaler()]).fit(features)
    model.write().overwrite().save(f"{tmp_path}/m")
    loaded = PipelineModel.load(f"{tmp_path}/m")
    pdf = features.toPandas().set_index("mesh")
    want = plain_scaled(pdf)
    for fitted in (model, loaded, preparation.fit_preparation(features)):
        got = fitted.transform(features).toPandas().set_index("mesh").loc[pdf.index]
        for c in FEATURES:
            np.testing.assert_allclose(got[f"{c}_z"], want[c], atol=1e-12)
    assert loaded.stages[1].fitted() == model.stages[1].fitted() and model.stages[1].fitted()["slope_ratio"][3] is None
    scaler = loaded.stages[1]
    back = scaler.inverse_transform(loaded.transform(features).drop(*FEATURES)).toPandas().set_index("mesh").loc[pdf.index]
    inside = np.abs(want["residual_cv"]) < 3
    filled = pdf["residual_cv"].fillna(pdf["residual_cv"].median())
    np.testing.assert_allclose(back["residual_cv"][inside], filled[inside], atol=1e-9)
    assert (back["slope_ratio"] == 2.0).all()


def test_estimators_can_be_saved_and_set(features, tmp_path):
    scaler = preparation.RobustScaler(inputCols=["residual_cv"], suffix="_s", clip=1.0)
    scaler.save(f"{tmp_path}/e")
    got = preparation.RobustScaler.load(f"{tmp_path}/e").fit(features).transform(features)
    low, high = got.agg(F.min("residual_cv_s"), F.max("residual_cv_s")).first()
    assert (low, high) == (-1.0, 1.0) and got.filter("residual_cv is null and residual_cv_s is not null").count() == 0
    with pytest.raises(ValueError, match="empty"):
        preparation.MedianImputer(inputCols=["empty"], zeroCols=[], flagCols=[]).fit(features.withColumn("empty", F.lit(None).cast("double")))


def test_a_fit_reads_its_input_once(features, tmp_path):
    log = str(tmp_path / "reads")

    def noted(batches):
        with open(log, "a") as f:
            f.write("x")
        yield from batches

    counted = features.coalesce(1).mapInArrow(noted, features.schema)
    preparation.fit_preparation(counted)
    assert os.path.getsize(log) == 1
    Pipeline(stages=[preparation.MedianImputer(), preparation.RobustScaler()]).fit(counted)
    assert os.path.getsize(log) == 3


def test_daily_medians(spark):
    rng = np.random.default_rng(7)
    rows = [(f"m{rng.integers(0, 30)}" if i % 50 else None, f"2012-01-{rng.integers(1, 12):02d} 0{i % 9}:00:00", None if i % 17 == 0 else float(rng.integers(0, 40)) / 8) for i in range(900)]
    rows += [("only", "2012-01-01 00:00:00", None), ("none", None, 1.0), ("none", None, 2.0), ("none", None, 9.0)]
    df = spark.createDataFrame(rows, "mesh_id_250m string, correction_date string, value double").withColumn("correction_date", F.to_timestamp("correction_date")).cache()
    got = {(r.mesh_id_250m, r.date): r.median_value for r in series.daily_medians(df).collect()}
    want = {(r.mesh_id_250m, r.date): r.m for r in df.groupBy("mesh_id_250m", F.to_date("correction_date").alias("date")).agg(F.median("value").alias("m")).collect()}
    assert got == want and len(got) > 250
    plan = series.daily_medians(df)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"HashAggregate\(keys=\[mesh_id_250m", plan)


@pytest.fixture(scope="module")
def readings(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(4000):
        m = int(rng.integers(0, 120)) if i % 3 else 0  # one mesh has a third of the rows
        kind = ["Walk", "Car", "Air", None][int(rng.integers(0, 4 if m % 10 == 0 else 2))]
        rows.append((f"m{m}", f"2012-0{rng.integers(1, 9)}-1{rng.integers(0, 3)}", float(rng.integers(0, 30)) / 40, kind, f"item_{m % 4}", float(m), None if i % 5 else 0.2, f"p{i % 3}", i, "note"))
    rows += [(f"x{i}", "2012-01-01", None, None, "item_9", None, None, "p", i, "n") for i in range(5)]
    rows += rows[::9]
    schema = "mesh_id_250m string, correction_date string, value double, measurement_type string, source_item string, distance_from_fdnpp_km double, detection_lower_limit double, path string, row_no long, note string"
    path = str(tmp_path_factory.mktemp("readings"))
    spark.createDataFrame(rows, schema).withColumn("correction_date", F.to_timestamp("correction_date")).repartition(4).write.mode("overwrite").parquet(path)
    return path


def test_audit_while_writing(spark, readings, tmp_path):
    df, order = spark.read.parquet(readings), ["path", "row_no"]
    for k, params in enumerate((Params(distance_cutoff_km=80, dose_threshold=0.3, min_dates=6), Params(distance_cutoff_km=0, dose_threshold=5, min_dates=99), Params(distance_cutoff_km=999, dose_threshold=0, min_dates=1))):
        final, audit = stages.audited(df, order, params)
        final.write.parquet(f"{tmp_path}/{k}")
        assert audit.rows() == [r.asDict() for r in stages.stage_audit(df, order, params).collect()]
        written = sorted(map(str, spark.read.parquet(f"{tmp_path}/{k}").select(*df.columns).collect()))
        assert written == sorted(map(str, stages.run_stages(df, order, params).select(*df.columns).collect()))


def test_audit_reads_the_rows_once(spark, readings):
    final, audit = stages.audited(spark.read.parquet(readings), ["path", "row_no"], Params())
    final.collect()
    plan = final._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") >= 2
    assert audit.meshes_seen.get["loaded"] == audit.rows_seen.get["r0"] >= audit.meshes_seen.get["typed"]


def test_nulls_are_found_by_the_writing_job(spark, tmp_path):
    df = spark.createDataFrame([("a", None), (None, 1.0)], "category string, value double")
    with pytest.raises(ValueError, match="nulls in columns"):
        tables.write_measurements(df, f"{tmp_path}/n")
    tables.write_measurements(tables.complete_rows(df), f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c").count() == 0


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 4)) * 4
    found = np.concatenate([c + rng.normal(size=(150, 4)) * 0.5 for c in centres])
    return spark.createDataFrame([([float(x) for x in p],) for p in found], "vector array<double>").repartition(3).cache()


def test_sequential_maps_are_as_good_as_batch_ones(spark, points):
    grids, seeds = (som.Grid(4, 4), som.Grid(5, 4)), (1, 2, 3)
    batch = som.train_runs(points, grids, seeds, passes=30)
    for how in (som.Training(30, (0.05, 0.01)), som.Training(60, (0.05, 0.01), shares=4)):
        runs = som.train_runs(points, grids, seeds, how=how)
        assert [r.name for r in runs] == [r.name for r in batch] and all(len(r.changes) == how.rlen for r in runs)
        assert np.mean([r.qe for r in runs]) <= 1.02 * np.mean([r.qe for r in batch])
    slow = som.train_runs(points, grids[:1], seeds[:1], how=som.Training(3, (1e-6, 1e-6)))[0]
    start = np.array(som._first_vectors(points, (1,), 16, "vector")[1])
    assert 0 < np.abs(slow.codebook - start).max() < 1e-1  # a small rate moves little
    bubble = som.train_runs(points, grids[:1], seeds, how=som.Training(30, (0.05, 0.01), bubble=True))
    assert np.mean([r.qe for r in bubble]) < 1.1 * np.mean([r.qe for r in batch[:3]])


def test_maps_do_not_depend_on_partitions(points):
    for how in (som.Training(8), som.Training(8, (0.05, 0.01), shares=2)):
        books = [som.train_all(points.repartition(n), [(som.Grid(4, 4), 7)], how)[0][0] for n in (1, 4, 16)]
        assert all(np.allclose(books[0], b, rtol=0, atol=1e-9) for b in books[1:])


def test_a_pass_is_one_job_for_all_maps(spark, points):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("maps", "maps")
    som.train_all(points, [(som.Grid(3, 3), s) for s in (1, 2, 3, 4)], som.Training(5))
    jobs = len(tracker.getJobIdsForGroup("maps"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs <= 5 * 2 + 4  # an adaptive pass has a job for its shuffle and one for its result


def test_measures_and_best_neurons_against_plain_ones(spark, points):
    x = np.array([r[0] for r in points.collect()])
    grid, book = som.Grid(4, 3), x[:12].copy()
    book[5] = book[4]
    d = np.sqrt(((x[:, None] - book[None]) ** 2).sum(axis=2))
    order = np.argsort(d, axis=1, kind="stable")
    got = {tuple(r.vector): r for r in som.assign(points, book).collect()}
    for v, o, near in zip(x, order, d, strict=True):
        r = got[tuple(v)]
        assert (r.bmu, r.second) == (o[0] + 1, o[1] + 1) and r.bmu_distance == pytest.approx(near[o[0]])
    apart = [o[1] + 1 not in grid.neighbours()[o[0] + 1] for o in order]
    [(qe, te)] = som.qualities(points, [book], [grid])
    assert qe == pytest.approx(d.min(axis=1).mean()) and te == pytest.approx(np.mean(apart))
    row = som.quality(som.assign(points, book), grid).first()
    assert (row.qe, row.te) == (pytest.approx(qe), pytest.approx(te))
    odd = spark.createDataFrame([(None, 1), ([0.0] * 4, 2)], "vector array<double>, k int")
    assert [(r.k, r.bmu is None) for r in som.assign(odd, book).orderBy("k").collect()] == [(1, True), (2, False)]


def test_row_groups(spark, tmp_path, monkeypatch):
    """No row group of the measurements has more rows than the limit."""
    monkeypatch.setattr(tables, "GROUP_ROWS", 700)
    rows = spark.range(2000).select(F.lit("c").alias("category"), F.col("id").cast("double").alias("value"))
    tables.write_measurements(rows.coalesce(1), f"{tmp_path}/g")
    files = list((tmp_path / "g").glob("*.parquet"))
    assert len(files) == 1
    found = parquet.ParquetFile(files[0]).metadata
    assert [found.row_group(i).num_rows for i in range(found.num_row_groups)] == [700, 700, 600] and found.row_group(0).column(0).compression == "SNAPPY"
