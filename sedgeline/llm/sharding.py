"""Sharding by a permutation-filled lookup table, with DataFrame functions only.

Each shard has a preference order of the slots of a table of prime size (offset + j * skip); shards
take turns, each claiming its first free slot, until the table is full. A key's slot is its hash
modulo the table, so that placement is one lookup in a broadcast table of fixed size, and a change of
the list of shards moves few other keys.

Results for odd input: a null key is placed by its text; null both, by the hash of null. Repeated
rows go to one shard. An empty table gives an empty result. Extra columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots. Its square root is far above the number of shards, so that shares differ by under 1 %.
TABLE = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: Sequence[str], size: int = TABLE) -> list[int]:
    """The shard number of each slot. size: a prime, at least the number of shards."""
    if len(set(shards)) != len(shards) or not 0 < len(shards) <= size:
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime")
    place = [_number(s, "offset") % size for s in shards]
    step = [_number(s, "skip") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while free:
        for shard in range(len(shards)):
            while table[place[shard]] >= 0:
                place[shard] = (place[shard] + step[shard]) % size
            table[place[shard]] = shard
            free -= 1
            if not free:
                break
    return table


def slots(spark: SparkSession, shards: Sequence[str], size: int = TABLE) -> DataFrame:
    """slot, shard: size rows, whatever the data."""
    table = F.array(*[F.lit(s) for s in shards])
    numbers = spark.createDataFrame(list(enumerate(lookup_table(shards, size))), "slot long, number int")
    return numbers.select("slot", F.element_at(table, F.col("number") + 1).alias("shard"))


def shard(docs: DataFrame, shards: Sequence[str] = SHARDS, size: int = TABLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the columns slot and shard; columns of those names are replaced."""
    key = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), F.col(text))))
    placed = docs.drop("slot", "shard").withColumn("slot", F.pmod(key, F.lit(size)))
    return placed.join(F.broadcast(slots(docs.sparkSession, shards, size)), "slot", "left").select(
        *[placed[c] for c in docs.columns if c not in ("slot", "shard")], "slot", "shard"
    )
