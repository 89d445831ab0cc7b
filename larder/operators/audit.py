"""Quality audit: repair, verdicts, quarantine and re-crawl scheduling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import fixed, variants
from larder.functions.scoring import NUTRITION_POINTS, recipe_score
from larder.functions.text import truthy
from larder.operators.shaping import attach, first_per
from larder.operators.tables import update_by_key


def repair_images(df: DataFrame, column: str = "image", drop_bad: bool = False) -> DataFrame:
    """Replace image fields that hold a JSON object by the URL inside.

    Without a URL inside the field stays as it is, or becomes null with `drop_bad`.
    """
    image = F.col(column)
    fallback = F.lit(None).cast("string") if drop_bad else image
    return df.withColumn(column, variants.repaired_image(image, fallback))


def with_image_check(df: DataFrame, checks: DataFrame, image: str = "image") -> DataFrame:
    """Add `image_ok` from a table of checked URLs; an unchecked URL counts as failed."""
    dim = checks.groupBy("url").agg(F.max("ok").alias("_ok")).withColumnRenamed("url", image)
    joined = attach(df, dim, [image])
    return joined.withColumn("image_ok", F.coalesce("_ok", F.lit(False))).drop("_ok")


def backfill(df: DataFrame, table: DataFrame, key: str, column: str) -> DataFrame:
    """Fill a missing column from a table that holds one value per key; adds `backfilled`."""
    dim = table.select(F.col(key), F.col(column).alias("_found"))
    joined = attach(df, dim, [key])
    missing = F.col(column).isNull() & F.col("_found").isNotNull()
    return (
        joined.withColumn("backfilled", missing)
        .withColumn(column, F.coalesce(column, "_found"))
        .drop("_found")
    )


def job_state(jobs: DataFrame) -> DataFrame:
    """Per url: whether a job is open, and the retry count of the last job that is not pending.

    One partial aggregate; no url's jobs meet in a list.
    """
    return jobs.filter(F.col("url").isNotNull()).groupBy("url").agg(
        F.max(F.col("status").isin(fixed.OPEN_JOB_STATUSES)).alias("job_open"),
        F.coalesce(
            F.max_by(
                F.when(F.col("status") != "pending", F.col("retry_count")),
                F.when(F.col("status") != "pending", F.struct("updated_at", "id")),
            ),
            F.lit(0),
        ).alias("retries"),
    )


def last_jobs(jobs: DataFrame) -> DataFrame:
    """The newest job of every url that is not pending."""
    return first_per(
        jobs.filter(F.col("status") != "pending"), ["url"], [F.desc("updated_at"), F.desc("id")]
    )


def verdict(
    image: Column,
    image_ok: Column,
    no_steps: Column,
    score: Column,
    has_url: Column,
    job_open: Column,
    retries: Column,
) -> Column:
    """Status after an audit."""
    low = score < fixed.AUDIT_SCORE
    exhausted = ~F.coalesce(job_open, F.lit(False)) & (
        F.coalesce(retries, F.lit(0)) >= fixed.MAX_RETRIES
    )
    flagged = (
        ~truthy(image)
        | ~F.coalesce(image_ok, F.lit(False))
        | no_steps
    )
    return (
        F.when(low & (~has_url | exhausted), "rejected")
        .when(low, "quarantined")
        .when(flagged, "flagged")
        .otherwise("verified")
    )


def messages(entries: list[tuple[Column, str, Column | None]]) -> Column:
    """The texts whose condition holds, in order; a value fills the gap of its text."""
    made = []
    for condition, name, value in entries:
        before, _, after = fixed.AUDIT_TEXTS[name].partition("{}")
        words = F.lit(before)
        if value is not None:
            words = F.concat(words, value.cast("string"), F.lit(after))
        made.append(F.when(condition, words))
    return F.filter(F.array(*made), lambda m: m.isNotNull())


def brief(recipes: DataFrame) -> DataFrame:
    """Recipes with their long columns cut to what `measured` looks at; what is null stays null, so an
    upsert of brief rows is the brief upsert."""
    def some(c: str) -> Column:
        element = recipes.schema[c].dataType.elementType
        return F.transform(F.slice(c, 1, 1), lambda x: F.lit(None).cast(element))

    return recipes.withColumns({
        "description": F.left("description", F.lit(11)),
        "recipe_ingredients": some("recipe_ingredients"), "recipe_instructions": some("recipe_instructions"),
    })


def measured(recipes: DataFrame) -> DataFrame:
    """Recipes with what an audit takes from their long columns: the score without nutrition, over the
    image as it is stored, and `no_steps`. `judged` needs no others but url, name, image and nutrition."""
    none = F.col("recipe_instructions").isNull() | (F.size("recipe_instructions") == 0)
    return recipes.withColumns({"quality_score": recipe_score(F.lit(False)), "no_steps": none})


def audit(
    recipes: DataFrame,
    url_checks: DataFrame,
    nutrition_by_name: DataFrame,
    jobs: DataFrame,
    now: Column,
) -> DataFrame:
    """Audit every row given; the result has the recipe columns with the audit written in, plus
    `schedule` and `retries` for `recrawl_jobs`."""
    done = judged(measured(recipes), url_checks, nutrition_by_name, jobs, now)
    return done.select(*recipes.columns, "schedule", "retries")


def judged(
    recipes: DataFrame,
    url_checks: DataFrame,
    nutrition_by_name: DataFrame,
    jobs: DataFrame,
    now: Column,
) -> DataFrame:
    """The audit of `measured` recipes; columns it does not need are kept."""
    repaired = recipes.withColumn("_image_was", F.col("image"))
    repaired = repair_images(repaired)
    checked = with_image_check(repaired, url_checks)
    filled = backfill(checked, nutrition_by_name, "name", "nutrition")
    points = F.when(F.col("nutrition").isNotNull(), NUTRITION_POINTS).otherwise(0)
    filled = filled.withColumn("quality_score", (F.col("quality_score") + points).cast("int"))
    scored = attach(filled, job_state(jobs), ["url"])

    image = F.col("image")
    has_url = truthy("url")
    low = F.col("quality_score") < fixed.AUDIT_SCORE
    free = low & has_url & ~F.coalesce(F.col("job_open"), F.lit(False))
    retries = F.coalesce(F.col("retries"), F.lit(0))
    log = messages(
        [
            (~F.col("_image_was").eqNullSafe(image), "repaired", None),
            (truthy(image) & ~F.col("image_ok"), "bad image", image),
            (~truthy(image), "no image", None),
            (F.col("no_steps"), "no instructions", None),
            (F.col("backfilled"), "enriched", None),
            (F.col("nutrition").isNull(), "no nutrition", None),
            (low, "low score", F.col("quality_score")),
            (free & (retries < fixed.MAX_RETRIES), "scheduled", retries + 1),
            (free & (retries >= fixed.MAX_RETRIES), "exhausted", None),
            (low & ~has_url, "no url", None),
        ]
    )
    status = verdict(
        image, F.col("image_ok"), F.col("no_steps"), F.col("quality_score"), has_url,
        F.col("job_open"), F.col("retries"),
    )
    return (
        scored.withColumn("qa_status", status)
        .withColumn("audit_log", log)
        .withColumn("last_audited_at", now)
        .withColumn("schedule", free & (retries < fixed.MAX_RETRIES))
        .withColumn("retries", retries)
    )


def recrawl_jobs(audited: DataFrame, now: Column) -> DataFrame:
    """One pending job per url to crawl again."""
    due = audited.filter("schedule").groupBy("url").agg(F.max("retries").alias("retries"))
    return due.select(
        F.sha2(F.concat_ws("|", "url", now.cast("string")), 256).alias("id"),
        "url",
        F.lit("pending").alias("status"),
        F.lit(0).alias("recipes_found"),
        F.lit(fixed.RECRAWL_LOG).alias("log"),
        now.alias("created_at"),
        now.alias("updated_at"),
        F.lit(False).alias("is_archived"),
        F.lit(None).cast("timestamp").alias("next_retry_at"),
        (F.col("retries") + 1).cast("int").alias("retry_count"),
    )


def write_back(recipes: DataFrame, audited: DataFrame) -> DataFrame:
    """The recipe table with the audited rows' columns set."""
    return update_by_key(
        recipes,
        audited,
        "id",
        ["qa_status", "quality_score", "last_audited_at", "audit_log", "nutrition", "image"],
    )
