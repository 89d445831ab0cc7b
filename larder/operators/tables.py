"""Writes on keyed tables, expressed as the next state of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.shaping import first_per


def keep_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Deduplicate: one row per key, the first by the order given.

    Keys are compared by their digest, so a long key (a whole text) is not sorted or shuffled
    unless the result needs it.
    """
    # equal structs have equal JSON, nulls and absent values included
    digest = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    return first_per(df.withColumn("_digest", digest), ["_digest"], order).drop("_digest")


def upsert(
    old: DataFrame,
    new: DataFrame,
    key: str,
    *,
    order: list[Column] | None = None,
    overwrite: list[str] | None = None,
    keep: list[str] | None = None,
    defaults: dict[str, Column] | None = None,
) -> DataFrame:
    """Insert new keys, update known ones.

    Of several new rows with one key the first by `order` counts. A new null leaves the old value,
    except in `overwrite` columns; `keep` columns are set on insert only. Rows without a key never
    collide: old ones stay, new ones are inserted, and neither takes part in the join.
    """
    overwrite, keep, defaults = overwrite or [], keep or [], defaults or {}
    keyed = new.filter(F.col(key).isNotNull())
    if order:
        keyed = first_per(keyed, [key], order)

    def filled(c: str, value: Column) -> Column:
        return F.coalesce(value, defaults[c]) if c in defaults else value

    def merged(c: str) -> Column:
        if c == key:
            return F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(c)
        was = F.col(f"o.{c}")
        if c not in new.columns:
            return F.when(F.col(f"o.{key}").isNotNull(), was).otherwise(
                filled(c, F.lit(None).cast(old.schema[c].dataType))
            ).alias(c)
        now = F.col(f"n.{c}")
        if c in keep:
            changed = was
        elif c in overwrite:
            changed = now
        else:
            changed = F.coalesce(now, was)
        return (
            F.when(F.col(f"n.{key}").isNull(), was)
            .when(F.col(f"o.{key}").isNull(), filled(c, now))
            .otherwise(changed)
            .alias(c)
        )

    joined = old.filter(F.col(key).isNotNull()).alias("o").join(
        keyed.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer"
    )
    out = joined.select(*[merged(c) for c in old.columns])
    loose = new.filter(F.col(key).isNull()).select(
        *[
            filled(c, F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType))
            .alias(c)
            for c in old.columns
        ]
    )
    return out.unionByName(old.filter(F.col(key).isNull())).unionByName(loose)


def update_by_key(
    df: DataFrame, changes: DataFrame, key: str, columns: list[str], order: list[Column] | None = None
) -> DataFrame:
    """Set columns from a change table. Keys unknown to the table are ignored; of several changes
    of one key the first by `order` counts; a change may set null."""
    if order:
        changes = first_per(changes, [key], order)
    renamed = changes.select(
        F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns]
    )
    joined = df.join(renamed, key, "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in df.columns
        ]
    )


def payload_rows(df: DataFrame, payload: str, item: str) -> DataFrame:
    """Unnest a JSON list of objects, numbered by place. `item` is the DDL of one object."""
    parsed = F.from_json(F.col(payload), f"array<struct<{item}>>")
    return df.select("*", F.posexplode(parsed).alias("place", "item")).select(
        *df.columns, "place", "item.*"
    )


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Set columns on the rows that meet a condition; all values read the old row."""
    hit = F.coalesce(condition, F.lit(False))
    return df.select(
        *[
            F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
            for c in df.columns
        ]
    )


def insertable(
    df: DataFrame, required: list[str], defaults: dict[str, Column]
) -> tuple[DataFrame, DataFrame]:
    """Split rows to insert into (accepted with defaults filled, rejected)."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.coalesce(F.col(c) != "", F.lit(False))
    good = df.filter(ok)
    for c, value in defaults.items():
        good = good.withColumn(c, F.coalesce(F.col(c), value) if c in df.columns else value)
    return good, df.filter(~ok)


def fold_changes(
    changes: DataFrame,
    key: str,
    order: Column,
    *,
    overwrite: list[str] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """The table that upserting all changes in order would give.

    Per column the last value that is not null, the last value at all (`overwrite`) or the first
    one (`keep`). Only one row per key and partition is shuffled, however often a key changed.
    """
    overwrite, keep = overwrite or [], keep or []
    ranked = changes.filter(F.col(key).isNotNull()).withColumn("_at", order)

    def folded(c: str) -> Column:
        if c in keep:
            return F.min_by(c, "_at").alias(c)
        if c in overwrite:
            return F.max_by(c, "_at").alias(c)
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c)

    return ranked.groupBy(key).agg(*[folded(c) for c in changes.columns if c != key])
