"""Helpers that the operators share: identity of rows, checkpoints, native text expressions."""

from __future__ import annotations

import math
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of a few numbers each that one task takes at once.
TASK_ROWS = 1 << 18
#: Rows of the table of bits by which rows are told that a list of keys can't hold; each has 64 bits.
FILTER_WORDS = 1 << 17


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one of its own only on a single machine (tests), where all is shared."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there: short lineage, no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def compact(df: DataFrame, rows: int = TASK_ROWS) -> tuple[DataFrame, int]:
    """The frame, cut, and how many partitions of about so many rows it has: as many as its size needs, not as shuffles have."""
    done = cut(df)
    parts = max(1, math.ceil(done.count() / rows))
    return done.coalesce(parts), parts


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names for columns that df doesn't have, whatever its own are called."""
    taken = {c.lower() for c in df.columns}
    found = []
    for stem in stems:
        name, k = f"__{stem}", 0
        while name.lower() in taken:
            name, k = f"__{stem}_{k}", k + 1
        taken.add(name.lower())
        found.append(name)
    return found


def with_possible(df: DataFrame, keys: DataFrame, key: str, flag: str, words: int = FILTER_WORDS) -> DataFrame:
    """df with flag: false where keys (a column of hashes of that name) surely doesn't hold the row's key.

    A table of bits with words rows at most is broadcast, whatever the number of keys; with very many
    of them it fills up, and all rows are possible. Only possible rows need a join, and a shuffle.
    """
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))
    place, bits = fresh(df, "place", "bits")
    table = keys.select(F.pmod(F.col(key), F.lit(words)).alias(place), bit(F.col(key)).alias(bits)).groupBy(place).agg(F.bit_or(bits).alias(bits))
    marked = df.withColumn(place, F.pmod(F.col(key), F.lit(words))).join(F.broadcast(table), place, "left")
    return marked.withColumn(flag, F.coalesce(F.col(bits).bitwiseAND(bit(F.col(key))) != 0, F.lit(False))).drop(place, bits)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast path of lower(), which is the same there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(doc_id: str, text: str) -> Column:
    """With doc_id it names a document where ids repeat or are null: a hash of the text."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def without(docs: DataFrame, gone: DataFrame, doc_id: str, text: str, once: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose (doc_id, text_hash) gone has; of rows that are in once, one of each stays.

    gone and once are cut. Rows that surely are in neither aren't shuffled.
    """
    key, flag = fresh(docs, "key", "flag")
    listed = gone.select(F.col("text_hash").alias(key))
    if once is not None:
        listed = listed.unionByName(once.select(F.col("text_hash").alias(key)))
    marked = with_possible(docs.withColumn(key, row_key(doc_id, text)), listed, key, flag)

    def on(other: DataFrame) -> Column:
        return doubtful[doc_id].eqNullSafe(other["doc_id"]) & (doubtful[key] == other["text_hash"])

    doubtful = marked.filter(F.col(flag))
    doubtful = doubtful.join(gone, on(gone), "left_anti")
    if once is not None:
        single = doubtful.join(once, on(once), "left_anti")
        doubtful = single.unionByName(doubtful.join(once, on(once), "left_semi").dropDuplicates([doc_id, key]))
    return marked.filter(~F.col(flag)).unionByName(doubtful).drop(key, flag)


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality of the named columns in which null equals null."""
    on = F.lit(True)
    for name in names:
        on = on & left[name].eqNullSafe(right[name])
    return on


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
