"""Tables that grow, dense keys, bucketed series, and samples by cluster."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgeline.operators import cluster, increments, keys, series, stages
from sedgeline.params import Params
from sedgeline.sources import tables

ORDER = ["path", "row_no"]
SCHEMA = "mesh_id_250m string, correction_date timestamp, value double, measurement_type string, source_item string, distance_from_fdnpp_km double, detection_lower_limit double, path string, row_no long, is_decontaminated boolean, height_anomalous boolean, latitude double, longitude double"


def make_rows(spark, seed, n, meshes, path):
    from datetime import datetime

    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        m = int(rng.integers(*meshes)) if i % 3 else meshes[0]
        kind = ["Walk", "Car", "Air", None][int(rng.integers(0, 4 if m % 5 == 0 else 2))]
        day = datetime(2012, int(rng.integers(1, 9)), int(rng.integers(10, 13)))
        value = None if i % 41 == 0 else float(rng.integers(0, 30)) / 40
        rows.append((f"m{m}", day, value, kind, f"item_{m % 4}", float(m), None if i % 5 else float(rng.integers(0, 3)) / 10, f"{path}{i % 3}", i, m % 2 == 0, False, 37.0, 140.0))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def batches(spark):
    first, second = make_rows(spark, 1, 900, (0, 60), "p"), make_rows(spark, 2, 500, (40, 100), "a")
    repeated = first.filter("row_no % 7 = 0").withColumn("path", F.lit("a0")).withColumn("detection_lower_limit", F.lit(9.0))  # sorts before, and fails
    return [first.cache(), second.unionByName(repeated).cache(), make_rows(spark, 3, 40, (99, 101), "z").cache()]


def told(df):
    return sorted(map(str, df.collect()))


def test_increments_equal_one_full_run(spark, batches, tmp_path):
    params = Params(distance_cutoff_km=80, dose_threshold=0.3, min_dates=4)
    state = increments.Increments(spark, str(tmp_path), ORDER, params)
    with pytest.raises(ValueError, match="no batch"):
        state.result()
    for k in range(len(batches)):
        assert state.add(batches[k]) == k + 1
        everything = batches[0]
        for b in batches[1 : k + 1]:
            everything = everything.unionByName(b)
        want = stages.run_stages(everything, ORDER, params)
        assert told(state.result().select(*want.columns)) == told(want)
        assert told(state.audit()) == told(stages.stage_audit(everything, ORDER, params))
    # The third batch has two meshes of the state, and writes no others.
    assert {r[0] for r in spark.read.parquet(f"{tmp_path}/facts/batch=3").select("mesh_id_250m").collect()} == {"m99", "m100"}
    before = told(state.result()), told(state.audit())
    assert state.compact() == 4 and (told(state.result()), told(state.audit())) == before
    with pytest.raises(ValueError, match="settings"):
        increments.Increments(spark, str(tmp_path), ORDER, Params(min_dates=5))


def test_a_batch_without_a_commit_does_not_count(spark, batches, tmp_path):
    state = increments.Increments(spark, str(tmp_path), ORDER)
    state.add(batches[0])
    before = told(state.result()), told(state.audit())
    spark.read.parquet(f"{tmp_path}/rows/batch=1").write.parquet(f"{tmp_path}/rows/batch=2")
    spark.read.parquet(f"{tmp_path}/facts/batch=1").withColumn("r6", F.lit(7).cast("long")).write.parquet(f"{tmp_path}/facts/batch=2")
    again = increments.Increments(spark, str(tmp_path), ORDER)
    assert (told(again.result()), told(again.audit())) == before
    assert again.add(batches[2]) == 2 and again.result().count() >= len(before[0])


def written_bytes(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_dense_keys(spark):
    names = [f"熊-{i * 7919 % 1000:04d}-a-long-name-of-a-mesh" for i in range(700)] * 3 + [None, ""]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "mesh_id_250m string, x int").repartition(5)
    known = keys.dictionary(df, "mesh_id_250m")
    assert {r.mesh_id_250m: r.number for r in known.collect()} == {n: i for i, n in enumerate(sorted({x for x in names if x is not None}))}
    coded = keys.encode(df, known, "mesh_id_250m")
    assert dict(coded.dtypes) == {"mesh_id_250m": "bigint", "x": "int"} and told(keys.decode(coded, known, "mesh_id_250m")) == told(df)
    assert keys.dictionary(df.limit(0), "mesh_id_250m").collect() == []


def test_features_by_dense_keys_are_equal_and_move_less(spark):
    df = make_rows(spark, 4, 3000, (0, 200), "p").withColumn("mesh_id_250m", F.concat(F.lit("a-long-prefix-of-every-mesh-"), F.md5("mesh_id_250m"))).cache()
    known = keys.dictionary(df, "mesh_id_250m")
    coded = keys.encode(df, known, "mesh_id_250m").cache()
    coded.count()

    def moved(rows):
        before = written_bytes(spark)
        found = series.feature_matrix(rows).toPandas().sort_values("initial_dose_rate")
        return found, written_bytes(spark) - before

    by_text, text_bytes = moved(df)
    by_number, number_bytes = moved(coded)
    names = {r.number: r.mesh_id_250m for r in known.collect()}
    by_number["mesh_id_250m"] = by_number["mesh_id_250m"].map(names)
    key = lambda f: f.sort_values("mesh_id_250m").reset_index(drop=True)
    a, b = key(by_text), key(by_number)
    for c in a.columns:
        if a[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c], b[c], rtol=1e-12, atol=1e-12)
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all()
    print(f"shuffle bytes by text {text_bytes}, by number {number_bytes}")
    assert number_bytes < 0.8 * text_bytes


def test_features_of_bucketed_series_need_no_exchange(spark, tmp_path):
    df = make_rows(spark, 5, 2000, (0, 150), "p").cache()
    tables.write_series(series.daily_medians(df), series.metadata(df), "grown", str(tmp_path), buckets=4)
    spark.sql("drop table grown_days")  # as another session, which doesn't know it
    days, about = tables.read_series(spark, "grown", str(tmp_path), buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = series.matrix_of_series(days, about)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SelectedBucketsCount" in plan
        assert told(found.select("mesh_id_250m", "n_increases", "n_measurement_dates", "measurement_type")) == told(series.feature_matrix(df).select("mesh_id_250m", "n_increases", "n_measurement_dates", "measurement_type"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for part in ("days", "about"):
            spark.sql(f"drop table if exists grown_{part}")


def test_sample_by_cluster(spark):
    rows = [(i, 0 if i % 3 else i % 7, f"x{i}") for i in range(2000)] + [(5, None, "n"), (6, None, None)] + [(0, 0, "again")] * 3
    df = spark.createDataFrame(rows, "mesh_id_250m long, cluster int, _row string").repartition(7)
    for k in (1, 5, 400):
        got = cluster.sample_by_cluster(df, k)
        hashed = {r.mesh_id_250m: r.h for r in df.select("mesh_id_250m", F.xxhash64(F.lit(42), "mesh_id_250m").alias("h")).collect()}
        want = []
        for c in {r[1] for r in rows}:
            want += sorted((hashed[i], i) for i, x, _ in rows if x == c)[:k]
        assert sorted((hashed[r.mesh_id_250m], r.mesh_id_250m) for r in got.collect()) == sorted(want) and got.columns == df.columns
    assert cluster.sample_by_cluster(df.limit(0), 3).collect() == []


def test_reasons_of_a_selection(spark):
    """No grid within the limits: least mean TE; one: that; several: least mean QE. Then the run of least QE."""
    runs = [("a", 1, 2.0, 0.05), ("a", 2, 1.5, 0.07), ("b", 1, 1.0, 0.02), ("b", 2, 1.2, 0.01)]
    for ari, te, want in (((0.9, 0.9), 0.0, ("b", 1, "within the limits: least mean QE")), ((0.9, 0.5), 0.0, ("a", 2, "the only grid within the limits")), ((0.9, 0.9), 0.5, ("b", 1, "no grid within the limits: least mean TE"))):
        table = spark.createDataFrame([(g, s, qe, e + te) for g, s, qe, e in runs], "grid string, seed int, qe double, te double")
        grids = table.groupBy("grid").agg(F.avg("qe").alias("mean_qe"), F.avg("te").alias("mean_te"))
        grids = grids.withColumn("mean_ari", F.when(F.col("grid") == "a", ari[0]).otherwise(ari[1]))
        chosen = cluster.select_model(table, grids).first()
        assert (chosen.grid, chosen.seed, chosen.reason) == want
