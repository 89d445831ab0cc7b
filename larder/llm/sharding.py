"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a table of prime size, given by a start and a step
from the hash of its name. The shards take turns: each claims the first slot of its permutation
that is still free, until the table is full. Shares differ by one slot at most, and when a shard
comes or goes few of the other slots change hands. A weight lets a shard take as many turns a round.

The table has `slots` rows whatever the data, so filling it on the driver and broadcasting it are
bounded. A row's slot is a digest of its key, and an equality join with the broadcast table places
it: no shuffle and no Python on the executors, so hot keys and sources cost nothing.

A null key has a slot of its own kind (that of the empty digest text), repeated keys go to one
shard, an empty table gives no rows, and all columns are kept. `slot` and `shard` must not be
columns of the table already (an error says so).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537


def _number(text: str) -> int:
    """60 bits of the digest of a text."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> list[int]:
    """The index of the shard that owns each slot."""
    if slots < 2 or any(slots % x == 0 for x in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must have distinct names, one at least and no more than slots")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("every shard needs a weight of at least 1")
    place = [_number(f"start:{s}") % slots for s in shards]
    step = [_number(f"step:{s}") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    free = slots
    while free:
        for shard, turns in enumerate(weights):
            for _ in range(min(turns, free)):
                at = place[shard]
                while owner[at] >= 0:
                    at = (at + step[shard]) % slots
                owner[at] = shard
                place[shard] = (at + step[shard]) % slots
                free -= 1
    return owner


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> DataFrame:
    """(slot, shard): one row per slot."""
    owners = F.split(F.lit(",".join(map(str, fill(shards, slots, weights)))), ",")
    names = F.array(*(F.lit(s) for s in shards))
    return spark.range(1).select(F.posexplode(owners).alias("slot", "owner")).select(
        "slot", F.get(names, F.col("owner").cast("int")).alias("shard")
    )


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: 60 bits of its digest, modulo the number of slots."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % slots).cast("int")


def place(
    df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, weights: list[int] | None = None
) -> DataFrame:
    """The rows with the `slot` of their key and the `shard` that owns it."""
    clash = {"slot", "shard"} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    # `slots` rows of a number and a name: bounded, whatever the data
    table = F.broadcast(lookup_table(df.sparkSession, shards, slots, weights))
    return df.withColumn("slot", slot_of(F.col(f"`{key}`"), slots)).join(table, "slot").select(*(f"`{c}`" for c in df.columns), "slot", "shard")


def shares(placed: DataFrame) -> DataFrame:
    """Rows of each shard."""
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"))


def write(placed: DataFrame, path: str, files: int = 16) -> None:
    """One folder per shard; each shard's rows are spread over up to `files` tasks by their slot, so
    a large shard is not one task."""
    spread = placed.repartition("shard", F.pmod("slot", F.lit(files)))
    spread.write.mode("overwrite").partitionBy("shard").parquet(path)
