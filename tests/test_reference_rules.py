"""Rules of the stages, series and clusters on hand-made rows."""

import io
import re
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgeline.functions import scalars
from sedgeline.operators import cluster, series, som, stages
from sedgeline.params import Params
from sedgeline.sources import archives


def readings(spark, rows):
    return spark.createDataFrame(
        [(m, datetime.fromisoformat(d) if d else None, v, t, "item") for m, d, v, t in rows],
        "mesh_id_250m string, correction_date timestamp_ntz, value double, measurement_type string, source_item string",
    )


def test_detection_limit(spark):
    df = spark.createDataFrame([(0.1, None), (0.1, 0.1), (0.2, 0.1), (None, None)], "value double, detection_lower_limit double")
    assert sorted(r.value for r in stages.stage_2_detection(df).collect()) == [0.1, 0.2]


def test_dose_is_strictly_above(spark):
    df = readings(spark, [("A", "2012-01-01", 0.05, "Walk"), ("A", "2012-01-01", 0.15, "Walk"), ("B", "2012-01-01", 0.2, "Car")])
    assert {r.mesh_id_250m for r in stages.stage_3_dose(df, 0.10).collect()} == {"B"}


def test_types(spark):
    rows = [("A", "2012-01-01", 1.0, t) for t in ("Car", "Car", "Walk", "Walk")] + [("B", "2012-01-01", 1.0, t) for t in ("Walk", "AirBorne", "AirBorne")] + [("C", "2012-01-01", 1.0, None)]
    assert {r.mesh_id_250m: r.measurement_type for r in stages.winning_types(readings(spark, rows)).collect()} == {"A": "Walk", "B": "AirBorne"}
    assert stages.stage_5_type(readings(spark, rows)).count() == 4


def test_dates_and_dedup(spark):
    rows = [("A", f"2012-01-0{d}", 1.0, "Walk") for d in (1, 2, 3, 3)]
    df = readings(spark, rows).withColumn("n", F.monotonically_increasing_id())
    assert stages.stage_4_temporal(df, 4).count() == 0
    assert stages.stage_4_temporal(df, 3).count() == 4
    single = stages.deduplicate(df, ["n"])
    assert single.count() == 3 == stages.deduplicate(single, ["n"]).count()


def test_scalars(spark):
    df = spark.createDataFrame([(x,) for x in (" 1.5 ", "1e3", "1,234", "NaN", "<0.1", "1.5d")], "x string")
    assert [r[0] for r in df.select(scalars.number(F.col("x"))).collect()] == [1.5, 1000.0, None, None, None, None]
    df = spark.createDataFrame([("2012/04/01",), ("2012-04-02",), ("bad",)], "x string")
    assert [r[0] for r in df.select(scalars.timestamp(F.col("x"))).collect()] == [datetime(2012, 4, 1), datetime(2012, 4, 2), None]
    df = spark.createDataFrame([("　abc ",), ("   ",), (None,)], "x string")
    assert [r[0] for r in df.select(scalars.mesh_id(F.col("x"))).collect()] == ["abc", None, None]
    df = spark.createDataFrame([(None,), (100.0,), (5.0,)], "x double")
    assert [r[0] for r in df.select(scalars.height_anomalous(F.col("x"))).collect()] == [False, False, True]


@pytest.mark.parametrize(
    "values, expected", [((1.0, 0.5, 0.9, 1.0), (2, True, 0, 300)), ((1.0, 0.5, 0.9, 0.8), (1, False, 0, 300))]
)
def test_series_shape(spark, values, expected):
    dates = ("2012-01-01", "2012-04-10", "2012-07-19", "2012-10-27")
    df = readings(spark, [("A", d, v, "Walk") for d, v in zip(dates, values, strict=True)])
    r = series.series_features(series.daily(df)).first()
    assert (r.n_increases, r.recontamination_flag, r.max_dose_timing_days, r.temporal_span_days) == expected


def test_exact_decay_and_single_point(spark):
    rows = [("A", d, float(np.exp(-0.001 * t)), "Walk") for d, t in (("2012-01-01", 0), ("2012-04-10", 100), ("2012-07-19", 200), ("2012-10-27", 300))]
    found = {r.mesh_id_250m: r for r in series.derived(series.series_features(series.daily(readings(spark, [*rows, ("B", "2012-01-01", 1.0, "Walk")])))).collect()}
    a, b = found["A"], found["B"]
    assert a.log_linear_slope == pytest.approx(-0.001) and a.log_linear_r2 == pytest.approx(1) and a.residual_cv == pytest.approx(0, abs=1e-6)
    assert a.ecological_half_life_y == pytest.approx(1.8977, abs=1e-4) and a.slope_ratio == 1.0
    assert b.log_linear_slope is None and b.log_linear_r2 is None and b.residual_cv is None


def test_scaling(spark):
    df = spark.createDataFrame([(float(x), 5.0) for x in (0, 1, 2, 3, 100)], "a double, flat double")
    scaled = series.robust_scale(df, ("a", "flat")).collect()
    assert max(r.a_z for r in scaled) == 3.0 and all(r.flat_z == 0 for r in scaled)
    assert {r.feature: r.iqr for r in series.scaling_params(df, ("a", "flat")).collect()}["flat"] is None
    with pytest.raises(ValueError):
        series.check_matrix(df, ["flat"])


def test_exchanges_of_series(spark):
    """Readings are reduced to medians of each mesh and date before the days are dealt by mesh, once; only dates of several readings gather values."""
    df = readings(spark, [("A", "2012-01-01", 1.0, "Walk")])
    plan = series.series_features(series.daily(df))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(mesh_id_250m#\d+, \d+\)", plan)) == 1
    assert "partial_percentile" in plan and "partial_min" in plan


def test_grid_and_ties(spark):
    near = som.Grid(5, 5).neighbours()
    assert (near[1], near[5], near[13]) == ([2, 6, 7], [4, 10], [8, 9, 12, 14, 18, 19])
    df = spark.createDataFrame([([1.0, 1.0],)], "vector array<double>")
    assert som.assign(df, np.array([[0.0, 0.0], [0.0, 0.0]])).first()[1:] == (1, pytest.approx(2**0.5), 2)
    labels = spark.createDataFrame([(1, 2), (1, 2), (2, 1)], "a int, b int")
    assert som.adjusted_rand(labels, "a", "b").first().ari == 1


def test_clusters():
    points = np.array([[0.0, 0], [0, 0.1], [5, 5], [5, 5.1], [9, 0]])
    merges = cluster.ward(points)
    assert cluster.cut_tree(merges, 5, 3) == [1, 1, 2, 2, 3]
    assert [m[2] for m in merges] == sorted(m[2] for m in merges)
    zero = {f: 0.0 for f in cluster.EXTREMES}
    labels = cluster.auto_labels([zero | {"total_decay_ratio": 2.0, "residual_cv": 1.0}, zero | {"early_slope": -1.0, "residual_cv": -1.0}, zero | {"n_increases": 2.0}, zero | {"log_linear_r2": 1.0}, zero, zero])
    assert labels == ["Slow Retention", "Rapid Decay", "Recontamination/Anomalous", "Consistent Exponential Decay", "Standard Decay 5", "Standard Decay 6"]


def _csv(rows, n=37):
    date, value, mesh = 11, 12, 32
    lines = [",".join(f"h{i}" for i in range(n))]
    for m, d, v in rows:
        cells = [""] * n
        cells[date], cells[value], cells[0] = d, v, "空間線量率"
        if n > mesh:
            cells[mesh] = m
        lines.append(",".join(cells))
    return "\n".join(lines)


def test_archives(spark, tmp_path):
    folder = tmp_path / "02_drive_survey" / "item_001"
    folder.mkdir(parents=True)
    good = _csv([("m1", "2012-04-01", "0.5"), ("m2", "2012/04/02", "x")])
    for name, members in {
        "2011": {"a.csv": good.encode("utf-8"), "b.CSV": good.encode("utf-8-sig"), "c.csv": good.encode("shift_jis")},
        "2012": {"a.csv": _csv([("m", "2012-01-01", "1")], 36).encode(), "b.csv": _csv([]).encode(), "c.csv": _csv([("m", "", "1")]).encode()},
        "2013": {"readme.txt": b"none"},
    }.items():
        with zipfile.ZipFile(folder / f"{name}.zip", "w") as z:
            for member, content in members.items():
                z.writestr(member, content)
    (folder / "2014.zip").write_bytes(io.BytesIO(b"not a zip").getvalue())
    found = archives.read_archives(spark, str(tmp_path)).cache()
    audit = sorted((r.path[-8:-4], r.member or "", r.status, r.rows) for r in archives.file_audit(found).collect())
    assert audit == [
        ("2011", "a.csv", "ok", 2), ("2011", "b.CSV", "ok", 2), ("2011", "c.csv", "ok", 2), ("2012", "a.csv", "wrong_columns", 0),
        ("2012", "b.csv", "empty", 0), ("2012", "c.csv", "undated", 0), ("2013", "", "no_csv", 0), ("2014", "", "corrupt", 0),
    ]
    rows = archives.measurements(found)
    assert {r.source_item for r in rows.collect()} == {"item_001"}
    typed = stages.clean(rows.withColumn("distance_from_fdnpp_km", F.lit("80.0")), Params())
    assert stages.stage_1_distance(typed).count() == 6 and typed.filter("value is null").count() == 3
