"""What queries hold in memory, move and write as their tables grow."""

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from sedgeline.functions import scalars
from sedgeline.operators import increments, stages
from sedgeline.params import Params
from sedgeline.plans import exported, queries
from sedgeline.sources import archives


def told(df):
    return sorted(map(str, df.collect()))


def test_a_state_of_tasks_is_not_broadcast(spark):
    items = spark.createDataFrame([(i, i % 5) for i in range(40)], "item_code long, class_code long")
    tasks = archives.task_list(items)
    state = tasks.withColumn("status", F.when(F.col("fiscal_year") % 3 == 0, "completed").when(F.col("fiscal_year") % 3 == 1, "skipped_empty").otherwise("failed"))
    again = state.unionByName(state).select("output_path", "status")
    found = archives.open_tasks(tasks, again)
    assert told(found.select(*tasks.columns)) == told(tasks.filter("fiscal_year % 3 = 2"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_archives_are_written_from_columns(spark, tmp_path):
    """Raw columns that the rows lack are blank; quotes are only in members that need them."""
    columns = "source_class string, source_item string, part int, year string, note string, category string, correction_date string"
    rows = [("c", "i", p, y, f"n{k}", "空間線量率", f"{y}-01-02") for p in (0, 3, 6) for y in ("1992", "1993") for k in range(3)] + [("c", "i", 0, "1994", 'a,"b"\nc', None, "1994-01-02")]
    exported.export(spark.createDataFrame(rows, columns), str(tmp_path))
    found = archives.read_archives(spark, str(tmp_path))
    audit = sorted((r.path.split("/")[-1], r.member, r.status, r.rows) for r in archives.file_audit(found).collect())
    ok = [("0.zip", "1992.csv", "ok", 3), ("0.zip", "1993.csv", "ok", 3), ("0.zip", "1994.csv", "ok", 1), ("3.zip", "1992.csv", "ok", 3), ("3.zip", "1993.csv", "ok", 3)]
    assert audit == [*ok, ("6.zip", "1992.csv", "wrong_columns", 0), ("6.zip", "1993.csv", "wrong_columns", 0)]
    read = archives.measurements(found).select("note", "category", "correction_date", "value").collect()
    assert sorted(map(tuple, read), key=str) == sorted([(r[4], r[5], r[6], None) for r in rows if r[2] != 6], key=str)
    with zipfile.ZipFile(tmp_path / "c" / "i" / "0.zip") as z:
        assert {n: b'"' in z.read(n) for n in z.namelist()} == {"1992.csv": False, "1993.csv": False, "1994.csv": True}


def member(lines, end="\n", encoding="utf-8"):
    rows = [[{0: "空間線量率", 1: "A", 11: f"2012-04-{k % 28 + 1:02d}", 12: str(k), 14: " ", 29: "x y"}.get(i, "") for i in range(37)] for k in range(lines)]
    return end.join(map(",".join, [["h"] * 37, *rows])).encode(encoding)


def test_plain_members_are_parsed_by_columns():
    """Just the rows of the reader of any member, or left to it."""
    good = member(50)
    plain = {"good": good, "mark": b"\xef\xbb\xbf" + good, "sjis": member(9, encoding="shift_jis"), "cr": member(9, "\r\n"), "ended": good + b"\n\n", "blanks": good.replace(b"\n", b"\n\n"), "one": member(1)}
    left = {
        "quoted": good.replace(b",x y,", b',"x,y",', 1), "narrow": good.replace(b",7,", b",", 1), "wide": good + b",", "header": good.replace(b"h,", b"", 1), "blank header": b"\n" + good, "cr only": member(9, "\r"),
        "empty": member(0), "nothing": b"", "bytes": b"\xff\xff" + good, "nul": good.replace(b"x", b"\0", 1), "long": good.replace(b"x y", b"x" * 140_000, 1), "a space": good + b"\n ",
    }
    left["undated"] = b"\n".join(b",".join(b"" if i == 11 else c for i, c in enumerate(line.split(b","))) for line in good.split(b"\n"))
    for name, raw in (plain | left).items():
        told = list(archives._rows(lambda raw=raw: io.BytesIO(raw)))
        want = [(status, len(rows), [[r[i] if r[i] not in ("", " ") else None for r in rows] for i, _ in archives._KEPT]) for status, rows in told]
        assert (archives._plain(raw) is not None) == (name in plain), name
        assert [(s, n, [c.to_pylist() for c in cells]) for s, n, cells in archives._parts(lambda raw=raw: io.BytesIO(raw), raw)] == want, name
        assert all(c.type == pa.string() for _, _, cells in archives._parts(lambda raw=raw: io.BytesIO(raw), raw) for c in cells)


def test_a_date_is_tried_in_the_formats_that_may_fit(spark):
    texts = ["2012-04-01 10:11:12", " 2012-04-01 ", "2012/4/1 1:02:03", "2012/4/1 1:02", "2012/4/1", "4/1/2012", "20120401", "2012-04-01 10:11", "20120401:", "1/2", "2012-04-01/", "2012-02-30", "", "bad", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    was = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d", "M/d/yyyy", "yyyyMMdd")
    every = F.coalesce(*[F.try_to_timestamp(F.trim("t"), F.lit(f)) for f in was]).cast("timestamp_ntz")
    got = df.select(every, scalars.timestamp(F.col("t"))).collect()
    assert [r[0] for r in got] == [r[1] for r in got] and sum(r[0] is not None for r in got) == 7
    assert all(len(formats) <= 2 for formats in scalars._DATES.values())


def test_a_batch_moves_its_rows_twice(spark, tmp_path):
    """Once to be grouped by their keys, once to meet the facts of their meshes; what stages keep stays as it is."""
    note = F.concat(*[F.md5(F.concat_ws("-", "id", F.lit(k))) for k in range(8)])  # what a row weighs, and doesn't compress
    mesh, kind = (F.col("id") % 97).cast("string"), F.when(F.col("id") % 31 == 0, None).when(F.col("id") % 4 == 0, "Walk").otherwise("Car")
    day = F.date_add(F.lit("2012-01-01").cast("date"), (F.col("id") % 50).cast("int")).cast("timestamp_ntz")
    value = F.when(F.col("id") % 41 != 0, F.col("id") / 10000)
    rows = spark.range(20_000).select(
        mesh.alias("mesh_id_250m"), day.alias("correction_date"), value.alias("value"), kind.alias("measurement_type"), F.lit("i").alias("source_item"),
        (F.col("id") % 90).cast("double").alias("distance_from_fdnpp_km"), F.when(F.col("id") % 5 == 0, 0.5).alias("detection_lower_limit"), F.col("id").alias("row_no"), note.alias("note"),
    )
    rows.write.parquet(f"{tmp_path}/in")
    rows, params = spark.read.parquet(f"{tmp_path}/in"), Params(distance_cutoff_km=80, dose_threshold=0.005, min_dates=4)
    near_bytes = 256 * rows.filter("distance_from_fdnpp_km <= 80").count()

    def moved():
        found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state, before = increments.Increments(spark, f"{tmp_path}/state", ["row_no"], params), moved()
        state.add(rows)
        shuffled = moved() - before
        assert told(state.result()) == told(stages.run_stages(rows, ["row_no"], params).select(*state.result().columns))
        assert told(state.audit()) == told(stages.stage_audit(rows, ["row_no"], params))
        assert shuffled < 2.4 * near_bytes, (shuffled, near_bytes)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_vectors_are_assigned_once_for_the_edges_of_a_grid(spark):
    plan = queries.hex_adjacency(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    edges = queries.GRID.edges(spark)
    assert edges.dtypes == [("src", "int"), ("dst", "int")] and "RDD" not in edges._jdf.queryExecution().analyzed().toString()
