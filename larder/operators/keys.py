"""Access key records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import canonical_email, is_email
from larder.operators.shaping import first_per


def key_rows(requests: DataFrame) -> DataFrame:
    """Key records of `requests(id, email, raw_key, created_at)` with a valid e-mail address."""
    return requests.filter(is_email("email")).select(
        "id",
        F.sha2("raw_key", 256).alias("key_hash"),
        F.col("email").alias("owner_name"),
        canonical_email("email").alias("owner_email"),
        "created_at",
    )


def activate_latest(keys: DataFrame) -> DataFrame:
    """`is_active` on the newest key of every owner only.

    The newest keys are found by a trimmed ranking and joined back on the unique key id, so the
    rows of an owner with very many keys never meet in one task.
    """
    newest = first_per(
        keys.filter(F.col("owner_email").isNotNull()).select("id", "owner_email", "created_at"),
        ["owner_email"],
        [F.desc("created_at"), F.desc("id")],
    ).select("id", F.lit(True).alias("_newest"))
    return (
        keys.drop("is_active").join(newest, "id", "left")
        .withColumn("is_active", F.col("_newest").isNotNull() | F.col("owner_email").isNull())
        .drop("_newest")
    )


def authorised(requests: DataFrame, keys: DataFrame, raw_key: str = "raw_key") -> DataFrame:
    """Requests whose key is on record and active."""
    active = keys.filter("is_active").select(F.col("key_hash").alias("_hash"))
    hashed = requests.withColumn("_hash", F.sha2(F.col(raw_key), 256))
    return hashed.join(active, "_hash", "left_semi").drop("_hash")


def last_used(uses: DataFrame, key: str, at: str) -> DataFrame:
    return uses.groupBy(key).agg(F.max(at).alias("last_used_at"))


def record_use(keys: DataFrame, uses: DataFrame, at: str = "used_at") -> DataFrame:
    """Key records with the time of their last use, `uses(id, used_at)`."""
    newest = last_used(uses, "id", at).withColumnRenamed("last_used_at", "_used")
    return (
        keys.join(newest, "id", "left")
        .withColumn("last_used_at", F.greatest("last_used_at", "_used"))
        .select(*keys.columns)
    )


def several_active(keys: DataFrame) -> DataFrame:
    """Owners with more than one active key; keys without an owner do not count."""
    return (
        keys.filter(F.col("is_active") & F.col("owner_email").isNotNull())
        .groupBy("owner_email")
        .agg(F.count(F.lit(1)).alias("active_keys"))
        .filter("active_keys > 1")
    )
