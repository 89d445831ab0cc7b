"""Crawl job tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import fixed
from larder.functions.text import retry_time, with_scheme
from larder.operators.shaping import list_parts
from larder.operators.tables import update_where

def new_jobs(urls: DataFrame, now: Column) -> DataFrame:
    """Pending jobs for bare or full urls."""
    full = with_scheme("url")
    return urls.filter(F.coalesce(F.col("url") != "", F.lit(False))).select(
        F.sha2(F.concat_ws("|", full, now.cast("string")), 256).alias("id"),
        full.alias("url"),
        F.lit("pending").alias("status"),
        F.lit(0).alias("recipes_found"),
        F.lit(None).cast("string").alias("log"),
        now.alias("created_at"),
        now.alias("updated_at"),
        F.lit(False).alias("is_archived"),
        F.lit(None).cast("timestamp").alias("next_retry_at"),
        F.lit(0).alias("retry_count"),
    )


def is_due(now: Column) -> Column:
    """Pending, or cooled down by now; not archived."""
    ready = (F.col("status") == "pending") | (
        (F.col("status") == "cooling_down") & (F.col("next_retry_at") <= now)
    )
    return F.coalesce(ready & ~F.col("is_archived"), F.lit(False))


def due(jobs: DataFrame, now: Column, n: int | None = 1) -> DataFrame:
    """Due jobs, oldest first."""
    ordered = jobs.filter(is_due(now)).orderBy("created_at", "id")
    return ordered.limit(n) if n else ordered


def claim(jobs: DataFrame, claimed: DataFrame, now: Column) -> DataFrame:
    """The job table with the jobs of `claimed(id)` set to processing."""
    marked = jobs.join(
        claimed.select("id").withColumn("_claimed", F.lit(True)), "id", "left"
    )
    taken = update_where(
        marked,
        F.col("_claimed"),
        {
            "status": F.lit("processing"),
            "next_retry_at": F.lit(None).cast(jobs.schema["next_retry_at"].dataType),
            "retry_count": F.col("retry_count")
            + F.when(F.col("status") == "cooling_down", 1).otherwise(0),
            "updated_at": now,
        },
    )
    return taken.select(*jobs.columns)


def active(jobs: DataFrame, n: int = 20) -> DataFrame:
    return jobs.filter(~F.col("is_archived")).orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def archived(jobs: DataFrame, n: int = 5) -> DataFrame:
    return jobs.filter("is_archived").orderBy(F.desc("updated_at"), F.desc("id")).limit(n)


def archive(jobs: DataFrame, now: Column, job_id: Column | None = None) -> DataFrame:
    """Archive one job, or every job not archived yet."""
    which = ~F.col("is_archived") if job_id is None else F.col("id") == job_id
    return update_where(
        jobs,
        which,
        {
            "is_archived": F.lit(True),
            "status": F.lit("failed"),
            "log": F.lit(fixed.ARCHIVE_LOG),
            "updated_at": now,
        },
    )


def cancel(jobs: DataFrame, statuses: list[str], to: str = "failed", log: str | None = None) -> DataFrame:
    """Set the status of all jobs in the given states."""
    values = {"status": F.lit(to)}
    if log is not None:
        values["log"] = F.lit(log)
    return update_where(jobs, F.col("status").isin(statuses), values)


def cool_down(jobs: DataFrame, blocked: Column, now: Column) -> DataFrame:
    """Blocked jobs wait a day longer for every attempt made."""
    return update_where(
        jobs,
        blocked,
        {
            "status": F.lit("cooling_down"),
            "next_retry_at": retry_time(now, "retry_count"),
            "updated_at": now,
        },
    )


def block_reason(http_status: Column, url: Column) -> Column:
    """Why a request was refused: its status where that is one of a block, else an anti-bot page."""
    plain = F.concat(F.lit("Anti-bot page at "), url)
    refused = F.concat(F.lit("HTTP "), http_status.cast("string"), F.lit(" at "), url)
    return F.when(http_status.isin(fixed.BLOCK_STATUSES), refused).otherwise(plain)


def crawl_results(requests: DataFrame) -> DataFrame:
    """Outcome per job of `requests(job_id, request_no, found, blocked, error)`: `recipes_found`,
    `errors`, `status`, and `reason`, the cause of a block or a failure.

    Two further columns are read where they are there: `reason`, why a request was blocked (see
    `block_reason`), and `failure`, the message of an error that ended the crawl. A block wins over a
    failure, and that over completion; of several causes the last request's counts. All figures are
    partial aggregates.
    """
    for name in ("reason", "failure"):
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast("string"))

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("request_no"))).alias(f"_{name}")

    return requests.groupBy("job_id").agg(
        F.sum("found").cast("bigint").alias("recipes_found"),
        F.count("error").alias("errors"),
        F.coalesce(F.max("blocked"), F.lit(False)).alias("_blocked"), last("reason"), last("failure"),
    ).select(
        "job_id", "recipes_found", "errors",
        F.when(F.col("_blocked"), "cooling_down").when(F.col("_failure").isNotNull(), "failed")
        .otherwise("completed").alias("status"),
        F.when(F.col("_blocked"), F.col("_reason")).otherwise(F.col("_failure")).alias("reason"),
    )


def crawl_logs(requests: DataFrame, width: int = 50) -> DataFrame:
    """Error messages per job joined by newlines, in request order.

    One row per `width` requests (a crawl makes at most 50), so no log grows with the data. Jobs
    without an error have no row, which reads as a null log.
    """
    failed = requests.filter(F.col("error").isNotNull())
    parts = list_parts(failed, ["job_id"], "request_no", F.col("error"), width)
    return parts.select("job_id", "part", F.array_join("entries", "\n").alias("log"))


def job_logs(requests: DataFrame) -> DataFrame:
    """`(job_id, log)`: the whole log of every job with an error, as its record holds it. A log has at
    most as many lines as a crawl has requests; `crawl_logs` cuts longer ones into parts."""
    return crawl_logs(requests).groupBy("job_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "log"))), lambda p: p["log"]), "\n").alias("log")
    )


def record_results(jobs: DataFrame, results: DataFrame, now: Column, logs: DataFrame | None = None) -> DataFrame:
    """Write crawl results into the job table. Blocked jobs get their retry time and the text of the
    block, failed ones the message, completed ones their errors from `logs(job_id, log)`; where there is
    none of these, the log stays as it was."""
    renamed = results.select(
        F.col("job_id").alias("id"),
        F.col("status").alias("_status"),
        F.col("recipes_found").alias("_found"),
        F.col("reason").alias("_reason"),
    )
    joined = jobs.join(renamed, "id", "left")
    if logs is None:
        joined = joined.withColumn("_errors", F.lit(None).cast("string"))
    else:
        joined = joined.join(logs.select(F.col("job_id").alias("id"), F.col("log").alias("_errors")), "id", "left")
    hours = ((F.coalesce("retry_count", F.lit(0)) + 1) * 24).cast("string")
    block = F.concat(F.lit("Blocked: "), F.col("_reason"), F.lit(". Retrying in "), hours, F.lit(" hours."))
    message = (
        F.when(F.col("_status") == "cooling_down", block)
        .when(F.col("_status") == "failed", F.col("_reason"))
        .otherwise(F.col("_errors"))
    )
    done = update_where(
        joined,
        F.col("_status").isNotNull(),
        {
            "status": F.col("_status"),
            "recipes_found": F.col("_found").cast("int"),
            "log": F.coalesce(F.when(message != "", message), F.col("log")),
            "next_retry_at": F.when(
                F.col("_status") == "cooling_down", retry_time(now, "retry_count")
            ).otherwise(F.col("next_retry_at")),
            "updated_at": now,
        },
    )
    return done.select(*jobs.columns)
