"""Text keys as dense numbers: joins, windows and sorts then move and compare eight bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.operators.storage import cut

#: monotonically_increasing_id has the row's place in its partition in so many bits.
_PLACE = (1 << 33) - 1


def dictionary(df: DataFrame, key: str, number: str = "number") -> DataFrame:
    """key, number: every key that isn't null once, numbered from 0 in the keys' order, without gaps.

    Keys are range-partitioned and sorted; a partition's first number is how many keys the ones before
    have. Only these counts, one for each partition, reach the driver.
    """
    distinct = df.select(key).filter(F.col(key).isNotNull()).distinct()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_keys = cut(distinct.repartitionByRange(parts, key).sortWithinPartitions(key))
    placed = sorted_keys.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))})
    counts = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    before, total = [], 0
    for k in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(k, 0)
    first = F.array(*[F.lit(x).cast("long") for x in before]) if before else F.array(F.lit(0).cast("long"))
    return placed.select(key, (F.get(first, F.col("_part")) + F.col("_place")).alias(number))


def encode(df: DataFrame, known: DataFrame, key: str, number: str = "number") -> DataFrame:
    """df with the key's number in the key's column; null stays null. A key that known lacks is an error of the caller: it becomes null."""
    pairs = known.select(F.col(key).alias("_key"), F.col(number).alias("_number"))
    joined = df.join(pairs, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.col("_number").alias(c) if c == key else F.col(c) for c in df.columns])


def decode(df: DataFrame, known: DataFrame, key: str, number: str = "number") -> DataFrame:
    """encode undone: df's column key has numbers, and gets the keys."""
    pairs = known.select(F.col(key).alias("_key"), F.col(number).alias("_number"))
    joined = df.join(pairs, F.col(key) == F.col("_number"), "left")
    return joined.select(*[F.col("_key").alias(c) if c == key else F.col(c) for c in df.columns])
