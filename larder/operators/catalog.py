"""Listing, lookup, paging and health figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import fixed


def visible(df: DataFrame, status: str = "qa_status", hidden: list[str] | None = None) -> DataFrame:
    """Rows that are not hidden. Rows without a status are dropped, as in SQL."""
    return df.filter(~F.col(status).isin(hidden or fixed.HIDDEN_STATUSES))


def fields(df: DataFrame, full: bool = False, light: list[str] | None = None) -> DataFrame:
    """All columns, or the short listing."""
    return df if full else df.select(*(light or fixed.LIGHT_FIELDS))


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """One page of an ordered listing. Spark keeps offset + size rows per partition only."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_with_count(
    df: DataFrame, order: list[Column], number: int = 1, size: int = 50, count: str = "total"
) -> DataFrame:
    """A page beside the number of all rows (which ignores the page limits).

    The count is a scalar subquery beside the page.
    """
    total = df.agg(F.count(F.lit(1)))
    return page(df, order, number, size).select("*", total.scalar().alias(count))


def newest(df: DataFrame, by: list[Column], n: int) -> DataFrame:
    return df.orderBy(*by).limit(n)


def one_row(df: DataFrame, condition: Column) -> DataFrame:
    """The single row meeting a condition; none or several is an error."""
    rows = df.filter(condition)
    found = len(rows.take(2))
    if found != 1:
        raise LookupError("no row found" if found == 0 else "more than one row found")
    return rows


def with_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed; `ids` may be of any size."""
    return df.join(ids.select(key), key, "left_semi")


def name_like(df: DataFrame, name: str, part: str, order: list[Column]) -> DataFrame:
    """Case-insensitive substring match, ordered."""
    return df.filter(F.col(name).ilike(f"%{part}%")).orderBy(*order)


def health(
    df: DataFrame,
    status: Column,
    score: Column,
    counted: dict[str, str],
    sample: tuple[int, list[Column]] | None = None,
) -> DataFrame:
    """Total, one count per named status, and the mean score (0 when no row has one).

    With `sample=(n, order)` the mean is taken over the first n scored rows.
    """
    mean = F.coalesce(F.avg(score), F.lit(0.0)).alias("avg_score")
    counts = [F.count(F.lit(1)).alias("total")] + [
        F.count_if(status == value).alias(name) for name, value in counted.items()
    ]
    if sample is None:
        return df.agg(*counts, mean)
    n, order = sample
    first = df.filter(score.isNotNull()).orderBy(*order).limit(n).agg(mean)
    return df.agg(*counts).select("*", first.scalar().alias("avg_score"))


def recent_audits(df: DataFrame, n: int = 10) -> DataFrame:
    return (
        df.filter(F.col("last_audited_at").isNotNull())
        .select("id", "name", "qa_status", "quality_score", "audit_log", "last_audited_at")
        .orderBy(F.desc("last_audited_at"), "id")
        .limit(n)
    )


def needs_audit(df: DataFrame) -> DataFrame:
    return df.filter((F.col("qa_status") == "pending") | F.col("last_audited_at").isNull())
