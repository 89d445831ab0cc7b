"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters and projections must not evaluate again.

    A plain projection would be merged into every filter above it; the rows of a generator are
    computed once and read from there on.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of a table that comes in fewer splits than there are cores, for work that
    costs much more than moving the row. A table of many splits is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """The rows in shares of about `rows`, however few splits the table comes in, for work that gives a
    task many rows for each of them. A table of one share is left as it is."""
    shares = -(-df.count() // rows)
    if shares < 2:
        return df
    # by a number of their own: neither sorted first, as by turns, nor together where they are equal
    return df.withColumn("_at", F.monotonically_increasing_id()).repartition(shares, "_at").drop("_at")


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every group.

    The filter on the row number lets Spark keep one row per group before the shuffle
    (WindowGroupLimit), so a group of any size sends at most one row per input partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str) -> DataFrame:
    """The first n rows of every group, numbered from 1; trimmed before the shuffle as above."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def attach(facts: DataFrame, dim: DataFrame, keys: list[str], spread: int = 64) -> DataFrame:
    """Left join of any number of fact rows to a table that holds each key once.

    Fact rows with a missing key match nothing; they are spread over `spread` partitions instead
    of meeting in one. Hot keys are left to the adaptive skew join, which splits the fact side of
    a left join, or disappear where the dimension turns out small enough to broadcast.
    """
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    others = [F.col(c) for c in facts.columns if c not in keys] or [F.lit(0)]
    salt = F.when(missing, F.pmod(F.xxhash64(*others), F.lit(spread))).otherwise(F.lit(0))
    left = facts.withColumn("_salt", salt.cast("int"))
    right = dim.withColumn("_salt", F.lit(0))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")


def prefer(df: DataFrame, keys: list[str], keep: Column) -> DataFrame:
    """Filter inside every group, but leave a group whole when none of its rows pass.

    Whether a group has a passing row is a partial aggregate, one bit per group and partition.
    """
    flagged = df.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    groups = flagged.groupBy(*keys).agg(F.max("_keep").alias("_any"))
    return flagged.join(groups, keys).filter("_keep OR NOT _any").drop("_keep", "_any")


def list_parts(
    df: DataFrame, keys: list[str], position: str, entry: Column, width: int = 1000
) -> DataFrame:
    """Ordered lists of entries per group, cut into parts of at most `width` positions.

    Positions are unique within a group, so no part grows with the data; a group of ordinary size
    is the one row with part 0.
    """
    return (
        df.withColumn("part", F.floor(F.col(position) / width).cast("bigint"))
        .groupBy(*keys, "part")
        .agg(F.sort_array(F.collect_list(F.struct(F.col(position), entry.alias("e")))).alias("_l"))
        .withColumn("entries", F.col("_l.e"))
        .drop("_l")
    )
