"""Features of irregular series: one daily frame, one window pass, one aggregation per mesh.

Readings are first reduced to a median of each mesh and date, so that a mesh with very many readings is
spread over its dates; the days, far fewer, are then dealt by mesh once for the windows and the
aggregation. A plan has these two exchanges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.operators.storage import cut
from sedgeline.operators.stages import DATE, MESH, TYPE, VALUE
from sedgeline.params import DEFAULT, FEATURES, Params


def daily_medians(df: DataFrame) -> DataFrame:
    """mesh, date, median_value.

    One or two readings of a date have their median from count, least and greatest, which aggregate in
    fixed memory; only dates of three and more readings gather values.
    """
    rows = df.select(MESH, F.to_date(DATE).alias("date"), VALUE)
    ends = rows.groupBy(MESH, "date").agg(F.count(VALUE).alias("n"), F.min(VALUE).alias("low"), F.max(VALUE).alias("high"))
    # Two readings apart by more than a double can hold don't occur; halves keep the sum in range all the same.
    few = ends.filter("n < 3").select(MESH, "date", (F.col("low") / 2 + F.col("high") / 2).alias("median_value"))
    many = ends.filter("n >= 3").select(F.col(MESH).alias("_mesh"), F.col("date").alias("_date"))
    rest = rows.join(many, rows[MESH].eqNullSafe(many["_mesh"]) & rows["date"].eqNullSafe(many["_date"]), "left_semi")
    return few.unionByName(rest.groupBy(MESH, "date").agg(F.median(VALUE).alias("median_value")))


def daily(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """mesh, date, median_value, days_since_first, ln_value."""
    return dated(daily_medians(df), params)


def dated(median: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """daily from mesh, date, median_value."""
    first = F.min("date").over(Window.partitionBy(MESH))
    return median.withColumn("days_since_first", F.datediff("date", first)).withColumn("ln_value", F.log(F.greatest("median_value", F.lit(params.log_floor))))


def _changes(days: DataFrame) -> DataFrame:
    order = Window.partitionBy(MESH).orderBy("date")
    v = F.col("median_value")
    before = F.lag(v).over(order)
    moved = days.withColumns({"up": F.coalesce(v > before, F.lit(False)), "step": v - before, "before": before, "top": F.max(v).over(Window.partitionBy(MESH))})
    return moved.withColumn("up_next", F.coalesce(F.lead("up").over(order), F.lit(False)))


def _fit(y: Column, t: Column) -> tuple[Column, Column, Column]:
    return F.regr_slope(y, t), F.regr_intercept(y, t), F.regr_r2(y, t)


def series_features(days: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Trend in all, early and late days, level, shape and coverage of each mesh."""
    t, y, v = F.col("days_since_first").cast("double"), F.col("ln_value"), F.col("median_value")
    early = F.col("date") < F.lit(params.early_late_cutoff).cast("date")
    slope, intercept, r2 = _fit(y, t)
    rises = (F.col("step") / F.greatest("before", F.lit(params.log_floor)) > params.rise_ratio) & (F.col("step") > params.rise_step) & F.col("up_next")
    n = F.count(y)
    # The residuals' spread in closed form: no second pass over the days.
    spread = F.sqrt(F.greatest(F.regr_syy(y, t) - F.coalesce(slope, F.lit(0.0)) * F.coalesce(F.regr_sxy(y, t), F.lit(0.0)), F.lit(0.0)) / F.nullif(n - 1, F.lit(0)))
    return _changes(days).groupBy(MESH).agg(
        slope.alias("log_linear_slope"),
        F.when(r2.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r2))).alias("log_linear_r2"),
        intercept.alias("intercept"),
        F.regr_slope(F.when(early, y), F.when(early, t)).alias("early_slope"),
        F.regr_slope(F.when(~early, y), F.when(~early, t)).alias("late_slope"),
        F.min_by(v, "date").alias("initial_dose_rate"),
        F.max_by(v, "date").alias("final_dose_rate"),
        F.max(v).alias("max_dose_rate"),
        F.min(F.when(v == F.col("top"), F.col("days_since_first"))).alias("max_dose_timing_days"),
        F.count_if("up").alias("n_increases"),
        F.coalesce(F.bool_or(rises), F.lit(False)).alias("recontamination_flag"),
        F.when(slope.isNotNull(), spread / F.greatest(F.abs(F.avg(y)), F.lit(1e-8))).alias("residual_cv"),
        F.count(F.lit(1)).alias("n_measurement_dates"),
        F.min("date").alias("first_measurement_date"),
        F.max("date").alias("last_measurement_date"),
        F.max("days_since_first").cast("long").alias("temporal_span_days"),
    )


def derived(features: DataFrame, params: Params = DEFAULT) -> DataFrame:
    slope, early, late = F.col("log_linear_slope"), F.col("early_slope"), F.col("late_slope")
    half_life = F.least(F.lit(0.6931471805599453) / F.abs(slope) / 365.25, F.lit(params.half_life_cap))
    return features.withColumns({
        "has_early_data": early.isNotNull(),
        "total_decay_ratio": F.col("final_dose_rate") / F.greatest("initial_dose_rate", F.lit(params.log_floor)),
        "ecological_half_life_y": F.when((slope < 0) & (F.abs(slope) >= 1e-12), half_life),
        "slope_ratio": F.when(F.abs(late) > params.slope_guard, early / late).otherwise(1.0),
        "temporal_span_years": F.col("temporal_span_days") / 365.25,
    })


def metadata(df: DataFrame) -> DataFrame:
    return df.groupBy(MESH).agg(
        F.mode(TYPE, True).alias(TYPE),
        F.bool_or("is_decontaminated").alias("is_decontaminated"),
        (F.avg(F.col("height_anomalous").cast("double")) * 100).alias("height_anomalous_pct"),
        *[F.median(c).alias(c) for c in ("latitude", "longitude", "distance_from_fdnpp_km")],
    )


def feature_matrix(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Every feature of every mesh, before imputation and scaling."""
    return derived(series_features(daily(df, params), params), params).join(metadata(df), MESH, "left")


def matrix_of_series(medians: DataFrame, about: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """feature_matrix from daily_medians and metadata; where both are bucketed by mesh (tables.write_series), nothing is shuffled."""
    return derived(series_features(dated(medians, params), params), params).join(about, MESH, "left")


def exact_quantiles(df: DataFrame, columns: tuple[str, ...], shares: tuple[float, ...] = (0.25, 0.5, 0.75), accuracy: int = 1000) -> dict[str, list[float | None]]:
    """The quantiles of each column, interpolated as percentile() does, without all values in one task.

    Approximate quantiles a little below and above each one bracket it; a second pass counts what lies
    under the bracket and gathers the values in it, about four in accuracy of all. The columns are written
    first, so that df is computed once, however often they are read.
    """
    df = cut(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    wide = [min(max(q + d, 0.0), 1.0) for q in shares for d in (-2 / accuracy, 2 / accuracy)]
    number = {c: F.col(c).cast("double") for c in columns}
    near = df.agg(
        *[F.percentile_approx(x, wide, 10 * accuracy).alias(f"q{i}") for i, x in enumerate(number.values())],
        *[F.struct(F.count(x), F.min(x), F.max(x)).alias(f"m{i}") for i, x in enumerate(number.values())],
    ).first()
    wanted = []
    for i, c in enumerate(columns):
        n, least, most = near[f"m{i}"]
        for k, q in enumerate(shares):
            if n:
                low = near[f"q{i}"][2 * k] if wide[2 * k] > 0 else least
                high = near[f"q{i}"][2 * k + 1] if wide[2 * k + 1] < 1 else most
                wanted.append((i, k, c, low, high, (n - 1) * q))
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    if not wanted:
        return out
    inside = [F.when((number[c] >= low) & (number[c] <= high), F.struct(F.lit(j).alias("j"), number[c].alias("x"))) for j, (_, _, c, low, high, _) in enumerate(wanted)]
    under = df.agg(*[F.count_if(number[c] < low).alias(f"u{j}") for j, (_, _, c, low, _, _) in enumerate(wanted)]).first()
    values = df.select(F.explode(F.array_compact(F.array(*inside))).alias("v")).groupBy("v.j", "v.x").agg(F.count(F.lit(1)).alias("n"))
    ends = F.sum("n").over(Window.partitionBy("j").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    start = F.element_at(F.array(*[F.lit(under[f"u{j}"]) for j in range(len(wanted))]), F.col("j") + 1)
    rank = F.element_at(F.array(*[F.lit(float(r)) for *_, r in wanted]), F.col("j") + 1)
    placed = values.withColumn("end", start + ends)
    # The values at the ranks below and above: the first whose end is beyond.
    at = [F.min(F.when(F.col("end") > f(rank), F.col("x"))) for f in (F.floor, F.ceil)]
    for r in placed.groupBy("j").agg(at[0].alias("low"), at[1].alias("high")).collect():
        i, k, c, _, _, place = wanted[r["j"]]
        out[c][k] = r["low"] + (r["high"] - r["low"]) * (place - math.floor(place))
    return out


def impute(features: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Missing early slopes are 0 where there are no early data; all else gets its column's median."""
    from sedgeline.operators.preparation import ZEROS, MedianImputer

    zeros = {c: f for c, f in ZEROS.items() if c in columns}
    return MedianImputer(inputCols=list(columns), zeroCols=list(zeros), flagCols=list(zeros.values())).fit(features).transform(features)


def imputation_counts(features: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """feature, n_missing, n_zero (of early slopes, without early data), n_median: what impute will fill."""
    zero = F.count_if(F.col("early_slope").isNull() & ~F.coalesce(F.col("has_early_data"), F.lit(False))) if "early_slope" in columns else F.lit(0).cast("long")
    one = []
    for c in columns:
        missing = F.count_if(F.col(c).isNull())
        zeros = zero if c == "early_slope" else F.lit(0).cast("long")
        one.append(F.struct(F.lit(c).alias("feature"), missing.alias("n_missing"), zeros.alias("n_zero"), (missing - zeros).alias("n_median")))
    return features.agg(F.array(*one).alias("all")).select(F.inline("all"))


def scaling_params(features: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """feature, median, q25, q75, iqr (null if flat), by exact quantiles. One row for each column."""
    rows = []
    for c, (q25, median, q75) in exact_quantiles(features, columns).items():
        iqr = None if q25 is None or q75 - q25 < 1e-12 else q75 - q25
        rows.append((c, median, q25, q75, iqr))
    return features.sparkSession.createDataFrame(rows, "feature string, median double, q25 double, q75 double, iqr double")


def robust_scale(features: DataFrame, columns: tuple[str, ...] = FEATURES, params: Params = DEFAULT, fitted: DataFrame | None = None) -> DataFrame:
    """<column>_z = (x - median) / IQR in [-clip, clip]; 0 for a flat column. fitted: scaling_params, where they are known."""
    known = {r["feature"]: r for r in (fitted if fitted is not None else scaling_params(features, columns)).collect()}
    scaled = {}
    for c in columns:
        z = (F.col(c) - F.lit(known[c]["median"])) / F.lit(known[c]["iqr"]) if known[c]["iqr"] else F.lit(0.0)
        scaled[f"{c}_z"] = F.when(F.col(c).isNotNull(), F.greatest(F.lit(-params.clip), F.least(F.lit(params.clip), z)))
    return features.withColumns(scaled)


def correlations(features: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """feature_a, feature_b, r for each pair, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = features.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    each = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs])
    return row.select(F.inline(each))


def close_pairs(features: DataFrame, columns: tuple[str, ...] = FEATURES, limit: float = 0.95) -> DataFrame:
    """Of the pairs of features, those whose correlation is beyond the limit."""
    return correlations(features, columns).filter(F.abs("r") > limit)


def sanity(features: DataFrame, expected_rows: int | None = None, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """check, value, outcome (passed, failed, or reported only) over a scaled feature matrix, in one aggregation."""
    rows = F.count(F.lit(1))
    positive = 100.0 * F.count_if(F.col("log_linear_slope") > 0) / F.greatest(rows, F.lit(1))
    decontaminated = F.count_if("is_decontaminated")
    reported = F.lit(None).cast("boolean")
    as_expected = reported if expected_rows is None else rows == expected_rows
    checks = [
        ("row_count", rows.cast("double"), as_expected),
        ("positive_slope_pct", F.round(positive, 2), reported),
        ("decontaminated_cells", decontaminated.cast("double"), decontaminated > 0),
    ]
    for c in columns:
        mean = F.avg(f"{c}_z")
        checks += [(f"mean {c}_z", mean, F.abs(mean) < 0.5), (f"std {c}_z", F.stddev_samp(f"{c}_z"), reported)]
    each = [F.struct(F.lit(n).alias("check"), v.alias("value"), F.when(ok.isNull(), "reported").when(ok, "passed").otherwise("failed").alias("outcome")) for n, v, ok in checks]
    return features.agg(F.array(*each).alias("all")).select(F.inline("all"))


def feature_stats(features: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """feature, mean, std, low, high, nulls."""
    one = [
        F.struct(
            F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(F.col(c).cast("double")).alias("low"),
            F.max(F.col(c).cast("double")).alias("high"), F.count_if(F.col(c).isNull()).alias("nulls"),
        )
        for c in columns
    ]
    return features.agg(F.array(*one).alias("all")).select(F.inline("all"))


def check_matrix(features: DataFrame, columns: list[str], clip: float = 3.0) -> None:
    """Raise unless every column is complete, varies, and lies in [-clip, clip]."""
    row = features.agg(*[F.struct(F.count_if(F.col(c).isNull()), F.stddev_samp(c), F.min(c), F.max(c)).alias(c) for c in columns]).first()
    for c in columns:
        nulls, std, low, high = row[c]
        if nulls or not std or low < -clip or high > clip:
            raise ValueError(f"{c}: {nulls} nulls, standard deviation {std}, range {low} to {high}")
