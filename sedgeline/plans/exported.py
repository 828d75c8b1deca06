"""Queries over archives: readings written as ZIP files of CSV members, and read back by the library's own reader.

Archives are named <class>/<item>/<part>.zip, with a member for each year. Some parts are written as raw
archives are found: in another encoding, without dates, with a column too few, damaged, or without any CSV.
"""

from __future__ import annotations

import io
import math
import uuid
import zipfile

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.operators import stages
from sedgeline.operators.storage import checkpoint_dir
from sedgeline.plans.queries import HAVERSINE, M, PARAMS, measurements, query
from sedgeline.sources import archives, stores

#: Readings for each PARTS parts of an item, so that an archive holds a bounded number; and what is odd about some parts (by part modulo PARTS).
READINGS, PARTS = 1_000_000, 16
_ODD = {3: "shift_jis", 5: "undated", 6: "narrow", 7: "damaged", 8: "no_csv"}
_KEYS = ["source_class", "source_item", "part"]


def _lines(text: pa.Table) -> bytes:
    """CSV without a header; Arrow quotes all texts or none, so quotes are only where a text needs them."""
    for style in ("none", "needed"):
        out = io.BytesIO()
        try:
            csv.write_csv(text, out, csv.WriteOptions(include_header=False, quoting_style=style))
        except pa.ArrowInvalid:
            continue
        return out.getvalue()
    raise ValueError("texts that can't be written as CSV")


def _archive(rows: pa.Table, kind: str | None) -> bytes:
    """One archive with a member for each year; rows are in the order of the years."""
    columns = archives.RAW_COLUMNS[:-1] if kind == "narrow" else archives.RAW_COLUMNS
    blank = {None, "correction_date"} if kind == "undated" else {None}
    nothing = pa.nulls(rows.num_rows, pa.string())
    cells = [nothing if c in blank or c not in rows.column_names else rows.column(c) for c in columns]
    names = [c or f"unused_{i}" for i, c in enumerate(columns)]
    text, header = pa.Table.from_arrays(cells, names), ",".join(names).encode() + b"\n"
    out, first = io.BytesIO(), 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
        for run in pc.run_end_encode(rows.column("year").combine_chunks()).run_ends.to_pylist():
            year, content = rows.column("year")[first].as_py(), header + _lines(text.slice(first, run - first))
            content = content.decode().encode("shift_jis") if kind == "shift_jis" else content
            archive.writestr(f"{year}.txt" if kind == "no_csv" else f"{year}.csv", content)
            first = run
    content = out.getvalue()
    return content[: len(content) // 2] if kind == "damaged" else content


def export(rows: DataFrame, root: str) -> None:
    """rows: source_class, source_item, part, year and raw columns as text; those that it lacks are blank. A task writes the archives of its parts, each whole or not at all."""

    def write(table: pa.Table) -> pa.Table:
        if table.num_rows:
            keys = [table.column(k)[0].as_py() for k in _KEYS]
            found = table.sort_by([("year", "ascending"), ("note", "ascending")])
            stores.put(f"{root}/{keys[0]}/{keys[1]}/{keys[2]}.zip", _archive(found, _ODD.get(keys[2] % PARTS)))
        return pa.table({"rows": pa.array([table.num_rows], pa.int64())})

    rows.groupBy(*_KEYS).applyInArrow(write, "rows long").agg(F.sum("rows")).collect()


def _exported(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """The folder of archives of all readings, and how many parts an item has."""
    m = measurements(spark, sf_dir)
    parts = PARTS * max(1, math.ceil(m.count() / READINGS))
    texts = {
        "category": F.lit("空間線量率"),
        "correction_date": F.date_format("correction_date", "yyyy-MM-dd"),
        "note": F.concat_ws("-", "l_orderkey", "l_linenumber"),
    } | {c: F.col(c).cast("string") for c in ("measurement_type", "latitude", "longitude", "value", "detection_lower_limit", "measurement_height_cm", "sampling_point_state", "mesh_id_250m", "distance_from_fdnpp_km")}
    keys = [
        F.concat(F.lit("class_"), "measurement_type").alias("source_class"),
        F.concat(F.lit("item_"), "source_item").alias("source_item"),
        (F.col("l_orderkey") % parts).cast("int").alias("part"),
        F.year("correction_date").cast("string").alias("year"),
    ]
    root = stores.qualified(spark, f"{checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}")
    export(m.select(*keys, *[x.alias(c) for c, x in texts.items()]), root)
    return root, parts


_E = M + """, e as (select 'class_' || measurement_type as source_class, 'item_' || source_item as source_item, l_orderkey % (select 16 * greatest(1, ceil(count(*) / 1000000.0))::bigint from lineitem) as part, year(correction_date) as year, * exclude (source_item) from m),
members as (select source_class, source_item, part, year, count(*) as n from e group by all)"""
_READ = "part % 16 not in (5, 6, 7, 8)"


@query(_E + """, zips as (select source_class, source_item, part, sum(case when part % 16 in (7, 8) then 0 else 1 end) as csvs from members group by all)
select source_class, source_item, count(*) as zips, sum(csvs)::bigint as csvs from zips group by rollup (source_class, source_item)""")
def archive_inventory(spark, sf_dir):
    """Archives and CSV members of each class and item, from the archives' directories."""
    return archives.inventory(spark, _exported(spark, sf_dir)[0]).drop("bytes")


@query(_E + """, told as (select source_class, source_item, part, year, case part % 16 when 5 then 'undated' when 6 then 'wrong_columns' else 'ok' end as status, case when part % 16 in (5, 6) then 0 else n end as n from members where part % 16 not in (7, 8)
union all select distinct source_class, source_item, part, null, case part % 16 when 7 then 'corrupt' else 'no_csv' end, 0 from members where part % 16 in (7, 8))
select source_class, status, count(*) as files, sum(n)::bigint as rows from told group by all""")
def archive_audit(spark, sf_dir):
    """What became of every archive and member."""
    audit = archives.file_audit(archives.read_archives(spark, _exported(spark, sf_dir)[0]))
    by_class = audit.withColumn("source_class", F.element_at(F.split("path", "/"), -3))
    return by_class.groupBy("source_class", "status").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"))


@query(_E + f""", placed as (select * replace (coalesce(distance_from_fdnpp_km, {HAVERSINE}) as distance_from_fdnpp_km) from e where {_READ})
select source_class, source_item, year::smallint as year, count(*) as rows, count(distinct mesh_id_250m) as meshes, round(sum(value), 4) as total, round(sum(distance_from_fdnpp_km), 3) as far,
       count(*) filter (where coalesce(measurement_height_cm <> 100, false)) as odd_heights, count(*) filter (where sampling_point_state is not null) as cleaned, count(detection_lower_limit) as limits
from placed group by all""")
def archive_measurements(spark, sf_dir):
    """Readings typed, placed and flagged from the archives' text."""
    found = stages.clean(archives.measurements(archives.read_archives(spark, _exported(spark, sf_dir)[0])), PARAMS)
    return found.groupBy("source_class", "source_item", "year").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("mesh_id_250m").alias("meshes"), F.round(F.sum("value"), 4).alias("total"), F.round(F.sum("distance_from_fdnpp_km"), 3).alias("far"),
        F.count_if("height_anomalous").alias("odd_heights"), F.count_if("is_decontaminated").alias("cleaned"), F.count("detection_lower_limit").alias("limits"),
    )


@query(_E + f" select source_item, year, count(*) as rows from e where {_READ} and source_class = 'class_A' and part % 16 in (1, 3) group by all")
def archive_pruning(spark, sf_dir):
    """Readings of one class and two parts: no other archive is opened."""
    root, parts = _exported(spark, sf_dir)
    found = archives.measurements(archives.read_archives(spark, root, classes=["class_A"], years=[p for p in range(parts) if p % PARTS in (1, 3)]))
    return found.groupBy("source_item", F.regexp_extract("member", "^[0-9]+", 0).cast("long").alias("year")).agg(F.count(F.lit(1)).alias("rows"))
