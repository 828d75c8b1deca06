"""Filter stages over streams: the stages that look at single rows, and daily counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.operators.stages import DATE, KEYS, MESH, VALUE, stage_1_distance, stage_2_detection
from sedgeline.params import DEFAULT, Params


def filtered(stream: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Stage 1, one of each set of repeated readings (equal in all five keys, within the watermark's day), stage 2."""
    near = stage_1_distance(stream, params)
    single = near.withWatermark(DATE, "1 day").dropDuplicatesWithinWatermark(list(KEYS))
    return stage_2_detection(single)


def daily_means(stream: DataFrame) -> DataFrame:
    """mesh, day, readings, mean: a day is closed one day after its end."""
    return stream.groupBy(MESH, F.window(DATE, "1 day").alias("day")).agg(F.count(F.lit(1)).alias("readings"), F.avg(VALUE).alias("mean"))
