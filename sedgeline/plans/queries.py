"""Every operator as a query over the test tables, which stand in for measurements, with SQL of the same result.

lineitem serves as the measurement table: a part is a mesh, a ship date a reading's date, a price its
value. Doubles are rounded on both sides where the order of sums may differ.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.functions import scalars
from sedgeline.operators import cluster, figures, increments, keys, preparation, series, som, stages
from sedgeline.operators.storage import checkpoint_dir, cut
from sedgeline.params import FEATURES, Params
from sedgeline.sources import archives, tables

PARAMS = Params(early_late_cutoff="1997-03-11", dose_threshold=0.3, min_dates=12)
ORDER = ["l_orderkey", "l_linenumber"]
GRID = som.Grid(5, 5)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

M = """
with m as (
  select l_orderkey, l_linenumber, l_partkey::varchar as mesh_id_250m, l_shipdate as correction_date, l_extendedprice / 100000 as value,
         l_returnflag as measurement_type, l_linestatus as source_item,
         37 + (l_suppkey % 100) / 100.0::double as latitude, 140.5::double + (l_partkey % 100) / 100.0::double as longitude,
         case when l_linenumber <> 7 then l_quantity * 2 end as distance_from_fdnpp_km,
         case when l_linenumber % 3 <> 0 then l_tax * 4 end as detection_lower_limit,
         case when l_linenumber = 2 then 5.0::double when l_linenumber <> 1 then 100.0::double end as measurement_height_cm,
         case when l_discount > 0.09 then '除染後' end as sampling_point_state
  from lineitem
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        *ORDER,
        F.col("l_partkey").cast("string").alias("mesh_id_250m"),
        F.col("l_shipdate").alias("correction_date"),
        (F.col("l_extendedprice") / 100000).alias("value"),
        F.col("l_returnflag").alias("measurement_type"),
        F.col("l_linestatus").alias("source_item"),
        (37 + (F.col("l_suppkey") % 100) / 100.0).alias("latitude"),
        (140.5 + (F.col("l_partkey") % 100) / 100.0).alias("longitude"),
        F.when(number != 7, F.col("l_quantity") * 2).alias("distance_from_fdnpp_km"),
        F.when(number % 3 != 0, F.col("l_tax") * 4).alias("detection_lower_limit"),
        F.when(number == 2, 5.0).when(number != 1, 100.0).alias("measurement_height_cm"),
        F.when(F.col("l_discount") > 0.09, "除染後").alias("sampling_point_state"),
        F.lit(None).cast("string").alias("note"),
    )
    return stages.with_flags(rows)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; minus zero is zero."""
    return df.select(*[(F.round(f.name, digits) + 0.0).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


DAILY = M + """, daily as (
  select mesh_id_250m, correction_date::date as date, median(value) as median_value from m group by all
), days as (
  select *, date_diff('day', min(date) over (partition by mesh_id_250m), date) as t, ln(greatest(median_value, 1e-6)) as y from daily
)"""
SERIES = DAILY + """, moved as (
  select *, median_value - lag(median_value) over w as step, lag(median_value) over w as before, max(median_value) over (partition by mesh_id_250m) as top,
         coalesce(median_value > lag(median_value) over w, false) as up
  from days window w as (partition by mesh_id_250m order by date)
), ahead as (
  select *, coalesce(lead(up) over (partition by mesh_id_250m order by date), false) as up_next from moved
), fits as (
  select mesh_id_250m, count(*) as n, regr_slope(y, t) as slope, regr_intercept(y, t) as cut, regr_r2(y, t) as r2,
         regr_slope(y, t) filter (where date < date '1997-03-11') as early, regr_slope(y, t) filter (where date >= date '1997-03-11') as late,
         arg_min(median_value, date) as first_value, arg_max(median_value, date) as last_value, max(median_value) as top,
         min(t) filter (where median_value = top) as top_day, count(*) filter (where up) as n_up,
         coalesce(bool_or(step / greatest(before, 1e-6) > 0.5 and step > 0.05 and up_next), false) as again,
         regr_syy(y, t) as syy, regr_sxy(y, t) as sxy, avg(y) as mean_y, min(date) as first_date, max(date) as last_date, max(t) as span
  from ahead group by mesh_id_250m
), features as (
  select mesh_id_250m, case when isfinite(slope) then slope end as log_linear_slope, case when isfinite(slope) then greatest(-1, least(1, r2)) end as log_linear_r2,
         case when isfinite(slope) then cut end as intercept, case when isfinite(early) then early end as early_slope, case when isfinite(late) then late end as late_slope,
         first_value as initial_dose_rate, last_value as final_dose_rate, top as max_dose_rate, top_day as max_dose_timing_days, n_up as n_increases,
         again as recontamination_flag,
         case when isfinite(slope) then sqrt(greatest(syy - slope * sxy, 0) / nullif(n - 1, 0)) / greatest(abs(mean_y), 1e-8) end as residual_cv,
         n as n_measurement_dates, first_date as first_measurement_date, last_date as last_measurement_date, span as temporal_span_days
  from fits
), derived as (
  select *, early_slope is not null as has_early_data, final_dose_rate / greatest(initial_dose_rate, 1e-6) as total_decay_ratio,
         case when log_linear_slope < 0 and abs(log_linear_slope) >= 1e-12 then least(0.6931471805599453 / abs(log_linear_slope) / 365.25, 100) end as ecological_half_life_y,
         case when abs(late_slope) > 5e-6 then early_slope / late_slope else 1.0 end as slope_ratio, temporal_span_days / 365.25::double as temporal_span_years
  from features
)"""


@query(DAILY + " select mesh_id_250m, date::varchar as date, round(median_value, 9) as median_value, t::int as days_since_first, round(y, 9) + 0.0 as ln_value from days")
def daily_median(spark, sf_dir):
    return rounded(series.daily(measurements(spark, sf_dir)).withColumn("date", F.col("date").cast("string")), 9)


def _numbers(names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 as {n}" for n in names.split())


_TREND = "log_linear_slope log_linear_r2 intercept early_slope late_slope"


@query(SERIES + f" select mesh_id_250m, {_numbers(_TREND)} from features")
def ols_trends(spark, sf_dir):
    return rounded(_features(spark, sf_dir).select("mesh_id_250m", *_TREND.split()))


@query(SERIES + f" select mesh_id_250m, round(initial_dose_rate, 9) as initial_dose_rate, round(final_dose_rate, 9) as final_dose_rate, round(max_dose_rate, 9) as max_dose_rate, max_dose_timing_days::int as max_dose_timing_days from features")
def level_features(spark, sf_dir):
    return rounded(_features(spark, sf_dir).select("mesh_id_250m", "initial_dose_rate", "final_dose_rate", "max_dose_rate", "max_dose_timing_days"), 9)


@query(SERIES + " select mesh_id_250m, n_increases, recontamination_flag, round(residual_cv, 6) + 0.0 as residual_cv from features")
def shape_features(spark, sf_dir):
    return rounded(_features(spark, sf_dir).select("mesh_id_250m", "n_increases", "recontamination_flag", "residual_cv"))


@query(SERIES + " select mesh_id_250m, n_measurement_dates, first_measurement_date::varchar as first_measurement_date, last_measurement_date::varchar as last_measurement_date, temporal_span_days::bigint as temporal_span_days from features")
def coverage_features(spark, sf_dir):
    dates = [F.col(c).cast("string").alias(c) for c in ("first_measurement_date", "last_measurement_date")]
    return _features(spark, sf_dir).select("mesh_id_250m", "n_measurement_dates", *dates, "temporal_span_days")


_DERIVED = "total_decay_ratio ecological_half_life_y slope_ratio temporal_span_years"


@query(SERIES + f" select mesh_id_250m, has_early_data, {_numbers(_DERIVED.replace('slope_ratio', ''))}, round(slope_ratio, 3) + 0.0 as slope_ratio from derived")
def derived_features(spark, sf_dir):
    found = series.derived(_features(spark, sf_dir), PARAMS).select("mesh_id_250m", "has_early_data", *_DERIVED.split())
    return rounded(found.withColumn("slope_ratio", F.round("slope_ratio", 3)))


@query(SERIES + f" select mesh_id_250m, {_numbers('log_linear_slope log_linear_r2 early_slope late_slope residual_cv total_decay_ratio temporal_span_years')}, n_increases, recontamination_flag, n_measurement_dates from derived")
def decay_features(spark, sf_dir):
    return _decay_of(_features(spark, sf_dir))


def _decay_of(features: DataFrame) -> DataFrame:
    names = ["log_linear_slope", "log_linear_r2", "early_slope", "late_slope", "residual_cv", "total_decay_ratio", "temporal_span_years"]
    return rounded(series.derived(features, PARAMS).select("mesh_id_250m", *names, "n_increases", "recontamination_flag", "n_measurement_dates"))


def _features(spark, sf_dir):
    return series.series_features(series.daily(measurements(spark, sf_dir), PARAMS), PARAMS)


def _derived(spark, sf_dir):
    return series.derived(_features(spark, sf_dir), PARAMS)


def _written(spark, sf_dir):
    """The features, one row for each mesh, computed once for all that reads them."""
    return cut(_derived(spark, sf_dir))


@query(M + """, counted as (select mesh_id_250m, measurement_type, count(*) as n from m group by all),
best as (select mesh_id_250m, measurement_type from counted qualify row_number() over (partition by mesh_id_250m order by n desc, measurement_type) = 1)
select mesh_id_250m, b.measurement_type, bool_or(sampling_point_state is not null) as is_decontaminated,
       round(100 * avg((coalesce(measurement_height_cm <> 100, false))::int), 6) + 0.0 as height_anomalous_pct, round(median(latitude), 6) as latitude,
       round(median(longitude), 6) as longitude, round(median(distance_from_fdnpp_km), 6) as distance_from_fdnpp_km
from m join best b using (mesh_id_250m) group by all""")
def metadata_features(spark, sf_dir):
    return rounded(series.metadata(measurements(spark, sf_dir)))


IMPUTED = SERIES + """, medians as (select median(slope_ratio) as r, median(log_linear_slope) as s, median(residual_cv) as c, median(late_slope) as l, median(log_linear_r2) as q from derived),
imputed as (select mesh_id_250m, coalesce(early_slope, 0.0) as early_slope, coalesce(late_slope, l) as late_slope, coalesce(log_linear_slope, s) as log_linear_slope,
  coalesce(residual_cv, c) as residual_cv, total_decay_ratio, n_increases::double as n_increases, temporal_span_years, coalesce(log_linear_r2, q) as log_linear_r2, coalesce(slope_ratio, r) as slope_ratio from derived, medians)"""
_SCALED = FEATURES
_Q = IMPUTED + ", long as (" + " union all ".join(f"select mesh_id_250m, '{c}' as feature, {c} as x from imputed" for c in _SCALED) + """),
fitted as (select feature, quantile_cont(x, 0.5) as median, quantile_cont(x, 0.25) as q25, quantile_cont(x, 0.75) as q75 from long group by feature)"""


_EACH = " ".join(c for c in FEATURES if c != "slope_ratio")


@query(IMPUTED + f" select mesh_id_250m, {_numbers(_EACH)}, round(slope_ratio, 3) + 0.0 as slope_ratio from imputed")
def impute(spark, sf_dir):
    return rounded(series.impute(_written(spark, sf_dir)).select("mesh_id_250m", *FEATURES).withColumn("slope_ratio", F.round("slope_ratio", 3)))


@query(SERIES + " select 'early_slope' as feature, count(*) filter (where early_slope is null) as n_missing, count(*) filter (where early_slope is null) as n_zero, 0::bigint as n_median from derived" + "".join(f" union all select '{c}', count(*) filter (where {c} is null), 0, count(*) filter (where {c} is null) from derived" for c in FEATURES if c != "early_slope"))
def imputation_counts(spark, sf_dir):
    return series.imputation_counts(_derived(spark, sf_dir))


@query(_Q + f" select feature, {_numbers('median q25 q75')}, round(case when q75 - q25 >= 1e-12 then q75 - q25 end, 6) + 0.0 as iqr from fitted")
def scaling_params(spark, sf_dir):
    return rounded(series.scaling_params(series.impute(_written(spark, sf_dir)), _SCALED))


@query(_Q + " select mesh_id_250m, feature, round(greatest(-3, least(3, case when q75 - q25 >= 1e-12 then (x - median) / (q75 - q25) else 0 end)), 4) + 0.0 as z from long join fitted using (feature)")
def robust_scale(spark, sf_dir):
    features = _written(spark, sf_dir)
    scaled = preparation.fit_preparation(features).transform(features)
    named = scaled.select("mesh_id_250m", *[F.col(f"{c}_z").alias(c) for c in _SCALED])
    return rounded(cluster.long_form(named, ["mesh_id_250m"], list(_SCALED)).withColumnRenamed("value", "z"), 4)


_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
_CORRELATED = IMPUTED + ", pairs as (" + " union all ".join(f"select '{a}' as feature_a, '{b}' as feature_b, corr({a}, {b}) as r from imputed" for a, b in _PAIRS) + ")"


@query(_CORRELATED + " select feature_a, feature_b, round(r, 4) + 0.0 as r from pairs")
def correlation_pairs(spark, sf_dir):
    return rounded(series.correlations(series.impute(_written(spark, sf_dir))), 4)


@query(_CORRELATED + " select feature_a, feature_b, round(r, 4) + 0.0 as r from pairs where abs(r) > 0.5")
def close_pairs(spark, sf_dir):
    return rounded(series.close_pairs(series.impute(_written(spark, sf_dir)), limit=0.5), 4)


@query(_Q + """, z as (select mesh_id_250m, feature, greatest(-3, least(3, case when q75 - q25 >= 1e-12 then (x - median) / (q75 - q25) else 0 end)) as z from long join fitted using (feature)),
decontaminated as (select count(distinct mesh_id_250m) as n from m where sampling_point_state is not null)
select 'row_count' as "check", count(*)::double as value, 'reported' as outcome from imputed union all
select 'positive_slope_pct', round(100.0::double * count(*) filter (where log_linear_slope > 0) / count(*), 2), 'reported' from imputed union all
select 'decontaminated_cells', n::double, case when n > 0 then 'passed' else 'failed' end from decontaminated union all
select 'mean ' || feature || '_z', round(avg(z), 3) + 0.0, case when abs(avg(z)) < 0.5 then 'passed' else 'failed' end from z group by feature union all
select 'std ' || feature || '_z', round(stddev_samp(z), 3) + 0.0, 'reported' from z group by feature""")
def sanity_checks(spark, sf_dir):
    matrix = cut(series.feature_matrix(measurements(spark, sf_dir), PARAMS))
    found = series.sanity(preparation.fit_preparation(matrix).transform(matrix))
    return found.withColumn("value", F.round("value", 3) + 0.0)


@query(SERIES + f""", counted as (select mesh_id_250m, measurement_type, count(*) as n from m group by all),
best as (select mesh_id_250m, measurement_type from counted qualify row_number() over (partition by mesh_id_250m order by n desc, measurement_type) = 1),
about as (select mesh_id_250m, b.measurement_type, bool_or(sampling_point_state is not null) as is_decontaminated, median(distance_from_fdnpp_km) as distance_from_fdnpp_km from m join best b using (mesh_id_250m) group by all)
select mesh_id_250m, {_numbers('log_linear_slope residual_cv total_decay_ratio distance_from_fdnpp_km')}, n_increases, n_measurement_dates, has_early_data, measurement_type, is_decontaminated from derived left join about using (mesh_id_250m)""")
def feature_matrix(spark, sf_dir):
    names = ["log_linear_slope", "residual_cv", "total_decay_ratio", "distance_from_fdnpp_km", "n_increases", "n_measurement_dates", "has_early_data", "measurement_type", "is_decontaminated"]
    return rounded(series.feature_matrix(measurements(spark, sf_dir), PARAMS).select("mesh_id_250m", *names))


@query(_Q + " select feature, round(avg(x), 6) + 0.0 as mean, round(stddev_samp(x), 6) + 0.0 as std, round(min(x), 6) + 0.0 as low, round(max(x), 6) + 0.0 as high, count(*) filter (where x is null) as nulls from long group by feature")
def feature_stats(spark, sf_dir):
    return rounded(series.feature_stats(series.impute(_written(spark, sf_dir)), _SCALED))


HAVERSINE = """2 * 6371.0::double * asin(least(1, sqrt(pow(sin((radians(latitude) - radians(37.421389)) / 2), 2)
  + cos(radians(37.421389)) * cos(radians(latitude)) * pow(sin((radians(longitude) - radians(141.032778)) / 2), 2))))"""
NEAR = M + f""", placed as (select * replace (coalesce(distance_from_fdnpp_km, {HAVERSINE}) as distance_from_fdnpp_km) from m),
near as (select * from placed where distance_from_fdnpp_km <= 80)"""
DEDUP = NEAR + """, single as (select * from near qualify row_number() over (partition by mesh_id_250m, correction_date, value, measurement_type, source_item order by l_orderkey, l_linenumber) = 1)"""
DETECT = DEDUP + ", found as (select * from single where value is not null and (detection_lower_limit is null or value > detection_lower_limit))"


def _dosed(name: str, source: str, threshold: float) -> str:
    return f""", {name}_dosed as (select * from {source} where mesh_id_250m in (select mesh_id_250m from (select *, min(correction_date) over (partition by mesh_id_250m) as first from {source})
  where correction_date = first group by mesh_id_250m having avg(value) > {threshold})),
{name}_dated as (select * from {name}_dosed where mesh_id_250m in (select mesh_id_250m from {name}_dosed group by 1 having count(distinct correction_date) >= 12)),
{name}_final as (select d.* from {name}_dated d join (select mesh_id_250m, measurement_type from (select mesh_id_250m, measurement_type, count(*) as n from {name}_dated group by all)
  qualify row_number() over (partition by mesh_id_250m order by n desc, measurement_type) = 1) using (mesh_id_250m, measurement_type))"""


ALL = DETECT + _dosed("all", "found", 0.3)


def _placed(spark, sf_dir):
    return stages.with_distance(measurements(spark, sf_dir), PARAMS)


def _found(spark, sf_dir):
    return stages.stage_2_detection(stages.deduplicate(stages.stage_1_distance(_placed(spark, sf_dir), PARAMS), ORDER))


@query(NEAR + " select l_orderkey, l_linenumber, round(distance_from_fdnpp_km, 6) + 0.0 as distance_from_fdnpp_km from near")
def stage1_distance(spark, sf_dir):
    return rounded(stages.stage_1_distance(_placed(spark, sf_dir), PARAMS).select(*ORDER, "distance_from_fdnpp_km"))


@query(DEDUP + " select l_orderkey, l_linenumber from single")
def dedup_keys(spark, sf_dir):
    return stages.deduplicate(stages.stage_1_distance(_placed(spark, sf_dir), PARAMS), ORDER).select(*ORDER)


@query(DETECT + " select l_orderkey, l_linenumber, value from found")
def stage2_detection(spark, sf_dir):
    return _found(spark, sf_dir).select(*ORDER, "value")


@query(ALL + " select l_orderkey, l_linenumber from all_dosed")
def stage3_dose(spark, sf_dir):
    return stages.stage_3_dose(_found(spark, sf_dir), 0.3).select(*ORDER)


@query(ALL + " select l_orderkey, l_linenumber from all_dated")
def stage4_temporal(spark, sf_dir):
    return stages.stage_4_temporal(stages.stage_3_dose(_found(spark, sf_dir), 0.3), 12).select(*ORDER)


@query(ALL + " select l_orderkey, l_linenumber, measurement_type from all_final")
def stage5_type(spark, sf_dir):
    return stages.run_stages(_placed(spark, sf_dir), ORDER, PARAMS).select(*ORDER, "measurement_type")


@query(M + " select mesh_id_250m, row_number() over (order by mesh_id_250m) - 1 as number from (select distinct mesh_id_250m from m)")
def mesh_numbers(spark, sf_dir):
    """Every mesh's dense number, in the order of the meshes."""
    return keys.dictionary(measurements(spark, sf_dir), "mesh_id_250m")


@query(SQL["decay_features"])
def decay_features_by_number(spark, sf_dir):
    """decay_features, computed over numbers in place of the meshes' names."""
    known = mesh_numbers(spark, sf_dir)
    rows = keys.encode(measurements(spark, sf_dir), known, "mesh_id_250m")
    return keys.decode(_decay_of(series.series_features(series.daily(rows, PARAMS), PARAMS)), known, "mesh_id_250m")


@query(SQL["decay_features"])
def decay_features_of_layout(spark, sf_dir):
    """decay_features from daily medians that are kept bucketed by mesh: the features themselves need no shuffle."""
    rows = measurements(spark, sf_dir)
    name = f"series_{uuid.uuid4().hex}"
    tables.write_series(series.daily_medians(rows), series.metadata(rows), name, f"{checkpoint_dir(spark)}/{name}", buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _decay_of(series.series_features(series.dated(spark.table(f"{name}_days"), PARAMS), PARAMS))


@query("with drawn as (select vec_id, label, md5('sample:' || vec_id) as draw from embeddings) select vec_id, label from drawn qualify row_number() over (partition by label order by draw, vec_id) <= 7")
def cluster_sample(spark, sf_dir):
    """Seven vectors of each label, the same in every run."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return cluster.sample_by_cluster(v, 7, "label", F.md5(F.concat(F.lit("sample:"), F.col("vec_id").cast("string"))), "vec_id")


@query(M + " select coalesce(measurement_height_cm <> 100, false) as height_anomalous, sampling_point_state is not null as is_decontaminated, year(correction_date)::smallint as year, count(*) as n from m group by all")
def stage6_flags(spark, sf_dir):
    return measurements(spark, sf_dir).groupBy("height_anomalous", "is_decontaminated", "year").agg(F.count(F.lit(1)).alias("n"))


_COUNTED = ALL + ", counted as (" + " union all ".join(f"select '{n}' as stage, count(*) as rows, count(distinct mesh_id_250m) as meshes from {t}" for n, t in (("0_loaded", "placed"), ("1_distance", "near"), ("1b_dedup", "single"), ("2_detection", "found"), ("3_dose", "all_dosed"), ("4_temporal", "all_dated"), ("5_type", "all_final"))) + """),
mixed as (select count(*) as n from (select mesh_id_250m from all_dated group by 1 having count(distinct measurement_type) > 1)),
before as (select *, coalesce(lag(rows) over (order by stage), rows) as rows_in, coalesce(lag(meshes) over (order by stage), meshes) as meshes_in from counted)"""


@query(_COUNTED + " select stage, rows, rows_in - rows as rows_dropped, round(100.0::double * (rows_in - rows) / greatest(rows_in, 1), 2) as pct_dropped, meshes, meshes_in - meshes as meshes_dropped, case when stage = '5_type' then n else 0 end as mixed_meshes from before, mixed")
def filter_audit(spark, sf_dir):
    return stages.stage_audit(_placed(spark, sf_dir), ORDER, PARAMS)


@query(SQL["filter_audit"])
def audit_while_writing(spark, sf_dir):
    """The audit as it is counted by the job that writes what the stages keep."""
    final, audit = stages.audited(_placed(spark, sf_dir), ORDER, PARAMS)
    final.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(audit.rows(), "stage string, rows long, rows_dropped long, pct_dropped double, meshes long, meshes_dropped long, mixed_meshes long")


def _grown(spark, sf_dir) -> increments.Increments:
    """The readings in two batches: those of even orders, then the others."""
    state = increments.Increments(spark, f"{checkpoint_dir(spark)}/increments-{uuid.uuid4().hex}", ORDER, PARAMS)
    placed = _placed(spark, sf_dir)
    for rest in (0, 1):
        state.add(placed.filter(F.col("l_orderkey") % 2 == rest))
    return state


@query(SQL["filter_audit"])
def incremental_audit(spark, sf_dir):
    return _grown(spark, sf_dir).audit()


@query(ALL + " select l_orderkey, l_linenumber, mesh_id_250m, measurement_type from all_final")
def incremental_result(spark, sf_dir):
    return _grown(spark, sf_dir).result().select("l_orderkey", "l_linenumber", "mesh_id_250m", "measurement_type")


@query(ALL + " select source_item, rows_loaded, coalesce(rows_final, 0)::bigint as rows_final, coalesce(meshes_final, 0)::bigint as meshes_final from (select source_item, count(*) as rows_loaded from placed group by 1) left join (select source_item, count(*) as rows_final, count(distinct mesh_id_250m) as meshes_final from all_final group by 1) using (source_item)")
def per_item_breakdown(spark, sf_dir):
    return stages.item_breakdown(_placed(spark, sf_dir), ORDER, PARAMS)


_BOTH = DETECT + _dosed("low", "found", 0.3) + _dosed("high", "found", 0.4)


@query(_BOTH + """, sides as (select coalesce(l.mesh_id_250m, h.mesh_id_250m) as mesh, l.n as low, h.n as high
  from (select mesh_id_250m, count(*) as n from low_final group by 1) l full join (select mesh_id_250m, count(*) as n from high_final group by 1) h using (mesh_id_250m)),
shared as (select count(*) as n from (select distinct mesh_id_250m, correction_date, value from low_final intersect select distinct mesh_id_250m, correction_date, value from high_final)),
years as (select (select min(year(correction_date)) from low_final) as a, (select max(year(correction_date)) from low_final) as b, (select min(year(correction_date)) from high_final) as c, (select max(year(correction_date)) from high_final) as d),
counts as (select count(low) as meshes_low, count(high) as meshes_high, count(*) filter (where low is not null and high is not null) as meshes_both, count(*) filter (where high is null) as only_low,
  count(*) filter (where low is null) as only_high, coalesce(sum(low), 0)::bigint as rows_low, coalesce(sum(high), 0)::bigint as rows_high from sides)
select counts.*, a::int as min_year_low, b::int as max_year_low, c::int as min_year_high, d::int as max_year_high, round(n::double / greatest(rows_low, 1), 4) as row_overlap, round(meshes_both::double / greatest(meshes_low, 1), 4) as mesh_overlap from counts, shared, years""")
def sensitivity(spark, sf_dir):
    return stages.sensitivity(_found(spark, sf_dir), 0.3, 0.4, 12)


def _by(part: str) -> str:
    return _BOTH + f""" select coalesce(l.part, h.part) as part, coalesce(l.n, 0)::bigint as rows_low, coalesce(h.n, 0)::bigint as rows_high
  from (select {part} as part, count(*) as n from low_final group by 1) l full join (select {part} as part, count(*) as n from high_final group by 1) h using (part)"""


@query(_by("source_item"))
def sensitivity_classes(spark, sf_dir):
    return stages.sensitivity_by(_found(spark, sf_dir), 0.3, 0.4, 12, F.col("source_item"))


@query(_by("least(floor(distance_from_fdnpp_km / 20) * 20, 60)::bigint"))
def sensitivity_bands(spark, sf_dir):
    return stages.sensitivity_by(_found(spark, sf_dir), 0.3, 0.4, 12, stages.band())


@query(ALL + """ select count(*) as total_rows, count(distinct mesh_id_250m) as total_meshes, count(distinct source_item) as total_items, min(year(correction_date))::smallint as year_min,
  max(year(correction_date))::smallint as year_max, round(min(distance_from_fdnpp_km), 6) as distance_min, round(max(distance_from_fdnpp_km), 6) as distance_max, round(min(value), 6) as value_min,
  round(max(value), 6) as value_max, count(*) filter (where sampling_point_state is not null) as is_decontaminated_true, count(*) filter (where measurement_height_cm <> 100) as height_anomalous_true from all_final""")
def final_summary(spark, sf_dir):
    return rounded(stages.final_summary(stages.run_stages(_placed(spark, sf_dir), ORDER, PARAMS)))


@query(ALL + " select 'measurement_type' as part, measurement_type as name, count(*) as rows from all_final group by 2 union all select 'source_item', source_item, count(*) from all_final group by 2")
def final_counts(spark, sf_dir):
    return stages.final_counts(stages.run_stages(_placed(spark, sf_dir), ORDER, PARAMS), ("measurement_type", "source_item"))


@query(M + " select count(*) as rows, count(distinct mesh_id_250m) as meshes, min(correction_date)::date::varchar as first_date, max(correction_date)::date::varchar as last_date from m")
def input_profile(spark, sf_dir):
    found = stages.profile(measurements(spark, sf_dir)).drop("columns")
    return found.withColumns({c: F.to_date(c).cast("string") for c in ("first_date", "last_date")})


_GATES = """with raw as (select event_id, case when event_id % 7 = 0 then null when event_id % 7 = 1 then 'soil' else 'Spatial dose rate' end as category,
  case when event_id % 11 = 0 then 'bad' else ts::date::varchar end as correction_date, case when event_id % 5 = 0 then null else '37.5' end as latitude,
  case when event_id % 3 = 0 then null else '10' end as distance, case when event_id % 13 = 0 then '　' else user_id::varchar end as mesh from events),
gated as (select *, case when category = 'soil' then 'category' when correction_date = 'bad' then 'date' when latitude is null and distance is null then 'place' when mesh = '　' then 'mesh' else 'kept' end as gate from raw)"""


@query(_GATES + """ select count(*) as rows_loaded, count(*) filter (where gate = 'category') as dropped_category, count(*) filter (where gate = 'date') as dropped_date, count(*) filter (where gate = 'place') as dropped_place,
  count(*) filter (where gate = 'mesh') as dropped_mesh, count(*) filter (where gate in ('kept', 'mesh') and latitude is not null and distance is null) as distances_computed, count(*) filter (where gate = 'kept') as rows_after from gated""")
def cleaning_audit(spark, sf_dir):
    n = F.col("event_id")
    raw = table(spark, sf_dir, "events").select(
        F.when(n % 7 == 0, None).when(n % 7 == 1, "soil").otherwise("Spatial dose rate").alias("category"),
        F.when(n % 11 == 0, "bad").otherwise(F.to_date("ts").cast("string")).alias("correction_date"),
        F.when(n % 5 != 0, "37.5").alias("latitude"),
        F.lit("140.5").alias("longitude"),
        F.when(n % 3 != 0, "10").alias("distance_from_fdnpp_km"),
        F.when(n % 13 == 0, "　").otherwise(F.col("user_id").cast("string")).alias("mesh_id_250m"),
    )
    return stages.cleaning_audit(raw, PARAMS)


@query(NEAR + " select least(floor(distance_from_fdnpp_km / 20) * 20, 60)::bigint as band, count(*) as rows, count(distinct mesh_id_250m) as meshes from near group by 1")
def distance_bands(spark, sf_dir):
    return stages.distance_bands(stages.stage_1_distance(_placed(spark, sf_dir), PARAMS))


@query(M + ", a as (select distinct mesh_id_250m from m where measurement_type = 'R'), b as (select distinct mesh_id_250m from m where value > 0.9) select 'both' as part, count(*) as n from (from a intersect from b) union all select 'only_a', count(*) from (from a except from b) union all select 'either', count(*) from (from a union from b)")
def set_ops_mesh(spark, sf_dir):
    m = measurements(spark, sf_dir)
    a, b = m.filter("measurement_type = 'R'").select("mesh_id_250m").distinct(), m.filter("value > 0.9").select("mesh_id_250m").distinct()
    parts = (("both", a.intersect(b)), ("only_a", a.subtract(b)), ("either", a.union(b).distinct()))
    return parts[0][1].agg(F.lit("both").alias("part"), F.count(F.lit(1)).alias("n")).unionByName(
        parts[1][1].agg(F.lit("only_a").alias("part"), F.count(F.lit(1)).alias("n"))
    ).unionByName(parts[2][1].agg(F.lit("either").alias("part"), F.count(F.lit(1)).alias("n")))


_DIRTY = "case event_id % 6 when 0 then value::varchar when 1 then ' ' || event_id::varchar || ' ' when 2 then '1,234' when 3 then 'NaN' when 4 then '<0.1' else '1.5d' end"


@query(f"select event_id, case when regexp_full_match({_DIRTY}, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') then try_cast(trim({_DIRTY}) as double) end as number from events")
def numeric_coerce(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    part = F.col("event_id") % 6
    text = F.when(part == 0, F.col("value").cast("string")).when(part == 1, F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(" ")))
    text = text.when(part == 2, "1,234").when(part == 3, "NaN").when(part == 4, "<0.1").otherwise("1.5d")
    return e.select("event_id", scalars.number(text).alias("number"))


@query("select event_id, case event_id % 4 when 3 then null else (ts::date::timestamp)::varchar end as parsed from events")
def date_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    part = F.col("event_id") % 4
    text = F.when(part == 0, F.date_format("ts", "yyyy-MM-dd")).when(part == 1, F.date_format("ts", "yyyy/M/d")).when(part == 2, F.date_format("ts", "M/d/yyyy")).otherwise("bad")
    return e.select("event_id", scalars.timestamp(text).cast("string").alias("parsed"))


@query("select doc_id, regexp_matches(coalesce(text, ''), '(?i)license|除染') as flagged, nullif(regexp_replace(source || '　', '^[\\s　]+|[\\s　]+$', '', 'g'), '') as source from documents")
def text_flags(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    flagged = F.coalesce(F.col("text").rlike("(?i)license|除染"), F.lit(False))
    return d.select("doc_id", flagged.alias("flagged"), scalars.mesh_id(F.concat("source", F.lit("　"))).alias("source"))


_ITEMS = "select p_partkey as item_code, (p_partkey % 5)::bigint as class_code from part"
_TASKS = f"""with tasks as (select item_code, class_code, fiscal_year::int as fiscal_year, printf('dataset/%s/item_%03d/%d.zip',
  case class_code when 2 then '02_drive_survey' when 3 then '03_walk_survey' when 4 then '04_survey_meter' else printf('%02d_unknown', class_code) end, item_code, fiscal_year) as output_path
  from ({_ITEMS}), (select unnest(range(2011, 2025)) as fiscal_year))"""


def _tasks(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_code"), (F.col("p_partkey") % 5).alias("class_code"))
    return archives.task_list(items)


@query(_TASKS + " select * from tasks")
def task_list(spark, sf_dir):
    return _tasks(spark, sf_dir)


@query(_TASKS + " select * from tasks where fiscal_year % 3 <> 0")
def task_anti_join(spark, sf_dir):
    tasks = _tasks(spark, sf_dir)
    state = tasks.withColumn("status", F.when(F.col("fiscal_year") % 3 == 0, "completed").otherwise("failed")).select("output_path", "status")
    return archives.open_tasks(tasks, state)


@query("select source as source_class, lang as source_item, count(*) as zips, sum(n_chars)::bigint as bytes from documents group by rollup (source, lang)")
def inventory_rollup(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("source_class"), F.col("lang").alias("source_item"), "n_chars")
    return archives.rolled_up(files, F.sum("n_chars").alias("bytes"))


@query(_TASKS + " select case when fiscal_year % 3 = 0 then 'completed' else 'failed' end as status, count(*) as files from tasks group by 1")
def status_counts(spark, sf_dir):
    state = _tasks(spark, sf_dir).select("output_path", F.when(F.col("fiscal_year") % 3 == 0, "completed").otherwise("failed").alias("status"))
    return archives.status_counts(state)


BMU = """with book as (select row_number() over (order by vec_id) as neuron, embedding::double[] as w from embeddings order by vec_id limit 25),
ranked as (select vec_id, label, neuron, sqrt(list_sum(list_transform(list_zip(embedding::double[], w), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) as distance,
  row_number() over (partition by vec_id order by list_sum(list_transform(list_zip(embedding::double[], w), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), neuron) as place from embeddings, book),
bmus as (select a.vec_id, a.label, a.neuron as bmu, a.distance, b.neuron as second from ranked a join ranked b using (vec_id) where a.place = 1 and b.place = 2),
points as (select i + 1 as neuron, i % 5 + 1 + 0.5 * ((i // 5 + 1) % 2) as x, (i // 5 + 1) * sqrt(3) / 2 as y from (select unnest(range(25)) as i)),
edges as (select a.neuron as src, b.neuron as dst from points a, points b where a.neuron <> b.neuron and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 1.1)"""


def _book(spark, sf_dir) -> np.ndarray:
    rows = table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(25).select(F.col("embedding").cast("array<double>").alias("w")).collect()
    return np.array([r["w"] for r in rows])


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))


def _assigned(spark, sf_dir):
    return som.assign(_vectors(spark, sf_dir), _book(spark, sf_dir))


@query(BMU + " select vec_id, bmu::int as bmu, second::int as second, round(distance, 6) as bmu_distance from bmus")
def bmu_assign(spark, sf_dir):
    return rounded(_assigned(spark, sf_dir).select("vec_id", "bmu", "second", "bmu_distance"))


@query(BMU + " select round(avg(distance), 6) as qe, round(avg(((bmu, second) not in (select (src, dst) from edges))::int), 6) as te from bmus")
def map_quality(spark, sf_dir):
    return rounded(som.quality(_assigned(spark, sf_dir), GRID))


@query(BMU + " select neuron::int as neuron, count(bmu) as n from points left join bmus on neuron = bmu group by 1")
def node_counts(spark, sf_dir):
    return som.node_counts(_assigned(spark, sf_dir), GRID)


@query(BMU + ", counts as (select bmu, count(*) as n from bmus group by 1) select src::int as src, dst::int as dst, coalesce(a.n, 0)::bigint as n_src, coalesce(b.n, 0)::bigint as n_dst from edges left join counts a on src = a.bmu left join counts b on dst = b.bmu")
def hex_adjacency(spark, sf_dir):
    """Neighbours on the grid, with the vectors that are mapped to either."""
    # One map of all counts, as many as the grid has neurons: the vectors are assigned once, not once for either end.
    counts = som.node_counts(_assigned(spark, sf_dir), GRID).agg(F.map_from_entries(F.collect_list(F.struct("neuron", "n"))).alias("of"))
    ends = [F.element_at("of", F.col(c)).alias(f"n_{c}") for c in ("src", "dst")]
    return GRID.edges(spark).crossJoin(F.broadcast(counts)).select("src", "dst", *ends)


def _means_of_neurons(spark, sf_dir) -> np.ndarray:
    """The codebook after each neuron became the mean of its vectors; a row for each neuron comes back."""
    book, width = _book(spark, sf_dir).copy(), len(_book(spark, sf_dir)[0])
    means = _assigned(spark, sf_dir).groupBy("bmu").agg(*[F.avg(F.col("vector")[i]).alias(f"s{i}") for i in range(width)]).collect()
    for r in means:
        book[r["bmu"] - 1] = [r[f"s{i}"] for i in range(width)]
    return book


@query(BMU + """, dims as (select unnest(range(1, 65)) as i),
means as (select b.neuron, i, coalesce(avg(e.embedding[i]::double), any_value(b.w[i])) as v from book b join dims on true left join bmus m on m.bmu = b.neuron left join embeddings e on e.vec_id = m.vec_id group by b.neuron, i),
pairs as (select src, dst, sqrt(sum((a.v - c.v) ** 2)) as d from edges join means a on a.neuron = src join means c on c.neuron = dst and c.i = a.i group by src, dst)
select src::int as neuron, round(avg(d), 6) as distance from pairs group by 1""")
def umatrix(spark, sf_dir):
    return rounded(som.umatrix(spark, _means_of_neurons(spark, sf_dir), GRID))


@query(BMU + """, cells as (select label, bmu, count(*) as n from bmus group by all), s as (select (select sum(n * (n - 1) / 2) from cells) as c,
  (select sum(n * (n - 1) / 2) from (select sum(n) as n from cells group by label)) as r, (select sum(n * (n - 1) / 2) from (select sum(n) as n from cells group by bmu)) as k, (select sum(n) from cells) as t)
select round((c - r * k / (t * (t - 1) / 2)) / ((r + k) / 2 - r * k / (t * (t - 1) / 2)), 6) + 0.0 as ari from s""")
def adjusted_rand(spark, sf_dir):
    return rounded(som.adjusted_rand(_assigned(spark, sf_dir), "label", "bmu"))


@query("select label as cluster, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 6) as pct from embeddings group by 1")
def cluster_sizes(spark, sf_dir):
    return rounded(cluster.cluster_sizes(_vectors(spark, sf_dir).withColumnRenamed("label", "cluster")))


_WIDTH = 64
_LONG = "with long as (select vec_id, label as cluster, 'v' || i::varchar as feature, embedding[i + 1]::double as value from (select *, unnest(range(64)) as i from embeddings))"


def _wide(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return v.select("vec_id", F.col("label").alias("cluster"), *[F.col("vector")[i].alias(f"v{i}") for i in range(_WIDTH)])


@query(_LONG + " select cluster, feature, round(avg(value), 6) + 0.0 as value from long group by all")
def cluster_centroids(spark, sf_dir):
    names = [f"v{i}" for i in range(_WIDTH)]
    return rounded(cluster.long_form(cluster.centroids(_wide(spark, sf_dir), names), ["cluster"], names))


@query(_LONG + " select cluster, feature, round(min(value), 6) + 0.0 as low, round(quantile_cont(value, 0.25), 6) + 0.0 as q25, round(quantile_cont(value, 0.5), 6) + 0.0 as median, round(quantile_cont(value, 0.75), 6) + 0.0 as q75, round(max(value), 6) + 0.0 as high from long group by all")
def boxplot_quartiles(spark, sf_dir):
    names = [f"v{i}" for i in range(_WIDTH)]
    return rounded(cluster.box_quartiles(cluster.long_form(_wide(spark, sf_dir).drop("vec_id"), ["cluster"], names), ["cluster", "feature"]))


@query("select label as cluster, " + ", ".join(f"round(avg(case when vec_id % {k % 3 + 2} <> 0 then embedding[{k + 1}]::double end), 6) + 0.0 as mean_v{k}" for k in range(64)) + " from embeddings group by 1")
def context_means(spark, sf_dir):
    """Means of all numbers by label; some are missing."""
    names = [f"v{k}" for k in range(_WIDTH)]
    v = _wide(spark, sf_dir).select("cluster", *[F.when(F.col("vec_id") % (k % 3 + 2) != 0, F.col(n)).alias(n) for k, n in enumerate(names)])
    return rounded(cluster.context_means(v, tuple(names)))


@query(BMU + ", cells as (select label, bmu, count(*) as n from bmus group by all) select bmu::int as cluster, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 6) as pct, ceil(sum(count(*)) over () * 0.01)::bigint as least from bmus group by 1")
def size_bars(spark, sf_dir):
    found = figures.size_bars(_assigned(spark, sf_dir).withColumnRenamed("bmu", "som_cluster"), 0.01)
    return rounded(found.withColumnRenamed("som_cluster", "cluster"))


def _ari_sql(a: str, b: str) -> str:
    n, two = "sum(n * (n - 1) / 2)", "(t * (t - 1) / 2)"
    cells = f"(select {a} as a, {b} as b, count(*) as n from labelled group by all)"
    one = f"(select (select {n} from {cells}) as c, (select {n} from (select sum(n) as n from {cells} group by a)) as r, (select {n} from (select sum(n) as n from {cells} group by b)) as k, (select sum(n) from {cells}) as t)"
    return f"select '{a}' as a, '{b}' as b, round((c - r * k / {two}) / ((r + k) / 2 - r * k / {two}), 6) + 0.0 as ari from {one}"


@query(BMU + ", labelled as (select label, bmu, second from bmus) " + " union all ".join(_ari_sql(a, b) for a, b in (("label", "bmu"), ("label", "second"), ("bmu", "second"))))
def ari_matrix(spark, sf_dir):
    return rounded(som.ari_matrix(_assigned(spark, sf_dir), ["label", "bmu", "second"]))


@query(BMU + """, labelled as (select b.label as c, e.embedding::double[] as v from bmus b join embeddings e using (vec_id)),
means as (select label as c, i, avg(embedding[i + 1]::double) as mean from (select *, unnest(range(64)) as i from embeddings) group by all)
select c as cluster, round(sum((v[i + 1] - mean) ** 2), 4) as wss from labelled join means using (c) group by 1""")
def within_squares(spark, sf_dir):
    return rounded(cluster.within_squares(_wide(spark, sf_dir), [f"v{i}" for i in range(_WIDTH)]), 4)


#: Maps to compare: grid, seed, columns, neurons, and the vector that their codebook begins with.
_MAPS = (("5x5", 1, 5, 25, 0), ("5x5", 2, 5, 25, 25), ("4x4", 1, 4, 16, 50), ("4x4", 2, 4, 16, 66))
_RUNS = f"""with maps(grid, seed, columns, size, first) as (values {", ".join(map(str, _MAPS))}),
places as (select distinct grid, columns, size from maps),
points as (select grid, i + 1 as neuron, i % columns + 1 + 0.5 * ((i // columns + 1) % 2) as x, (i // columns + 1) * sqrt(3) / 2 as y from (select grid, columns, unnest(range(size)) as i from places)),
edges as (select a.grid, a.neuron as src, b.neuron as dst from points a join points b using (grid) where a.neuron <> b.neuron and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 1.1),
books as (select grid, seed, vec_id - first + 1 as neuron, embedding::double[] as w from embeddings join maps on vec_id between first and first + size - 1),
near as (select vec_id, grid, seed, neuron, list_sum(list_transform(list_zip(embedding::double[], w), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) as d from embeddings, books),
ranked as (select *, row_number() over (partition by grid, seed, vec_id order by d, neuron) as place from near),
best as (select a.vec_id, a.grid, a.seed, a.neuron as bmu, sqrt(a.d) as distance, b.neuron as second from ranked a join ranked b using (vec_id, grid, seed) where a.place = 1 and b.place = 2),
runs as (select grid, seed, avg(distance) as qe, avg((not exists (select 1 from edges e where e.grid = best.grid and e.src = bmu and e.dst = second))::int) as te from best group by all),
cells as (select a.grid, a.bmu as x, b.bmu as y, count(*) as n from best a join best b using (vec_id, grid) where a.seed = 1 and b.seed = 2 group by all),
two as (select grid, sum(n * (n - 1) / 2) as c, sum(n) as t, (select sum(m * (m - 1) / 2) from (select sum(n) as m from cells i where i.grid = cells.grid group by x)) as r, (select sum(m * (m - 1) / 2) from (select sum(n) as m from cells i where i.grid = cells.grid group by y)) as k from cells group by grid),
alike as (select grid, (c - r * k / (t * (t - 1) / 2)) / ((r + k) / 2 - r * k / (t * (t - 1) / 2)) as ari from two),
grids as (select grid, avg(qe) as mean_qe, avg(te) as mean_te, any_value(ari) as mean_ari, any_value(ari) as min_ari, any_value(ari) > 0.8 as stable from runs join alike using (grid) group by grid)"""


def _compared_maps(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """som.runs_table of the maps, and how alike those of one grid are."""
    vectors = _vectors(spark, sf_dir).select("vec_id", "vector")
    last = max(first + size for *_, size, first in _MAPS)
    found = {r["vec_id"]: r["vector"] for r in vectors.filter(F.col("vec_id") < last).collect()}  # the codebooks
    grids = [som.Grid(columns, size // columns) for _, _, columns, size, _ in _MAPS]
    books = [np.array([found[i] for i in range(first, first + size)]) for *_, size, first in _MAPS]
    measured = som.qualities(vectors, books, grids)
    runs = [som.Run(g, seed, book, [qe], qe, te) for g, (_, seed, *_), book, (qe, te) in zip(grids, _MAPS, books, measured, strict=True)]
    assigned = som.assign_runs(vectors, runs)
    names = [[r.name for r in runs if r.grid == g] for g in dict.fromkeys(grids)]
    pairs = som.ari_matrix(assigned, names[0]).unionByName(som.ari_matrix(assigned, names[1]))
    return som.runs_table(spark, runs), pairs


@query(_RUNS + " select grid || '_seed' || seed as run_id, round(qe, 6) + 0.0 as qe, round(te, 6) + 0.0 as te from runs")
def run_measures(spark, sf_dir):
    """Quantization and topographic errors of several maps in one job."""
    return rounded(_compared_maps(spark, sf_dir)[0].select("run_id", "qe", "te"))


@query(_RUNS + " select grid, round(mean_qe, 6) + 0.0 as mean_qe, round(mean_te, 6) + 0.0 as mean_te, round(mean_ari, 6) + 0.0 as mean_ari, round(min_ari, 6) + 0.0 as min_ari, stable from grids")
def grid_summary(spark, sf_dir):
    """Means over the maps of each grid, and how alike their best neurons are."""
    return rounded(som.grid_summary(*_compared_maps(spark, sf_dir)))


@query(_RUNS + """, judged as (select *, mean_te < 0.10 and mean_ari > 0.80 as good from grids),
chosen as (select grid, case when good then 0 else 1 end as bad, case when good then mean_qe else mean_te end as by_mean, (select count(*) from judged where good) as n_good from judged order by bad, by_mean, grid limit 1)
select grid, seed, round(qe, 6) + 0.0 as qe, round(te, 6) + 0.0 as te,
       case n_good when 0 then 'no grid within the limits: least mean TE' when 1 then 'the only grid within the limits' else 'within the limits: least mean QE' end as reason
from runs join chosen using (grid) order by qe, seed limit 1""")
def model_selection(spark, sf_dir):
    """The map to use, by the errors and the agreement of all of them."""
    runs, pairs = _compared_maps(spark, sf_dir)
    return rounded(cluster.select_model(runs, som.grid_summary(runs, pairs)))


@query()
def som_train(spark, sf_dir):
    """neuron and weights of a map trained on the embeddings."""
    v = cut(_vectors(spark, sf_dir).select("vector"))  # read once a pass
    book, _ = som.train(v, GRID, passes=5)
    return spark.createDataFrame([(i + 1, [float(x) for x in w]) for i, w in enumerate(book)], "neuron int, w array<double>")


@query()
def ward_clusters(spark, sf_dir):
    """Every vector's neuron and cluster, by Ward's method over the neurons' means, with the height of the merges' cut."""
    book = _means_of_neurons(spark, sf_dir)
    merges = cluster.ward(book)
    of_neuron = F.array(*[F.lit(c) for c in cluster.cut_tree(merges, len(book), 6)])
    found = som.assign(_vectors(spark, sf_dir), book)
    return found.select("vec_id", F.col("bmu").alias("neuron"), F.element_at(of_neuron, F.col("bmu")).alias("cluster"), F.lit(float(merges[-5][2])).alias("cut"))


@query()
def regimes(spark, sf_dir):
    """mesh, neuron and regime: features scaled, mapped, cut into clusters and labelled."""
    features = _written(spark, sf_dir)
    scaled = cut(preparation.fit_preparation(features).transform(features))  # read once a pass
    vectors = scaled.select("mesh_id_250m", F.array(*[F.col(f"{c}_z") for c in FEATURES]).alias("vector"))
    book, _ = som.train(vectors, GRID, passes=5)
    assigned = som.assign(vectors, book)
    sizes = {r["neuron"]: r["n"] for r in som.node_counts(assigned, GRID).collect()}
    labels = cluster.cut_tree(cluster.ward(book), len(book), cluster.choose_k(book, sizes))
    of_neuron = F.array(*[F.lit(c) for c in labels])
    found = assigned.withColumn("cluster", F.element_at(of_neuron, F.col("bmu")))
    means = found.groupBy("cluster").agg(*[F.avg(F.col("vector")[i]).alias(c) for i, c in enumerate(FEATURES)]).orderBy("cluster").collect()
    names = dict(zip([r["cluster"] for r in means], cluster.auto_labels([{c: r[c] for c in FEATURES} for r in means]), strict=True))
    label = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return found.select("mesh_id_250m", F.col("bmu").alias("neuron"), F.element_at(label, F.col("cluster")).alias("regime"))
