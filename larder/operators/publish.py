"""Sitemaps, schema.org documents and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions import fixed, text, variants
from larder.operators.catalog import visible
from larder.session import written


def static_lines(spark: SparkSession, site: str) -> DataFrame:
    rows = [(fixed.STATIC_LINE.format(site=site, page=p),) for p in fixed.SITE_PAGES]
    return spark.createDataFrame(rows, "line string")


def recipe_lines(recipes: DataFrame, site: str, now: Column, id_col: str = "id") -> DataFrame:
    """One sitemap line per visible row, last modified now where no time is known."""
    stamp = text.iso_millis(F.coalesce(F.col("updated_at"), now))
    return visible(recipes).select(
        F.format_string(
            fixed.RECIPE_LINE.format(site=site.replace("%", "%%")),
            F.col(id_col).cast("string"), stamp,
        ).alias("line")
    )


def sitemap_lines(recipes: DataFrame, site: str, now: Column, id_col: str = "id") -> DataFrame:
    return static_lines(recipes.sparkSession, site).unionByName(
        recipe_lines(recipes, site, now, id_col)
    )


def in_shards(lines: DataFrame, per_file: int = fixed.URLS_PER_SITEMAP) -> DataFrame:
    """`lines` with `shard` and `place`: numbered without gaps in the order of the line, `per_file` to a shard.

    The lines are dealt by ranges and written with the number of their range, so a lost task finds the
    same ranges again. A window numbers the lines of a range; the ranges before it are counted
    in a table of one row per range.
    """
    dealt = written(lines.select("line").repartitionByRange("line").withColumn("_range", F.spark_partition_id()), "sitemap-lines")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    bases = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("line"))
    place = (F.col("_base") + F.col("_in") - 1).cast("bigint")
    numbered = dealt.withColumn("_in", inside).join(bases, "_range").select("line", place.alias("place"))
    return numbered.withColumn("shard", F.floor(F.col("place") / per_file).cast("bigint"))


def whole_files(rows: DataFrame, key: str, order: str, value: str, head: list[str], foot: str) -> DataFrame:
    """`(key, _at, value)`: the rows of every file by `_at`, between the lines of its head and its foot."""
    body = rows.select(key, F.struct(F.lit(1).alias("a"), F.col(order).cast("bigint").alias("b")).alias("_at"), F.col(value).alias("value"))
    keys = rows.select(key).distinct()
    frame = [(0, i, line) for i, line in enumerate(head)] + [(2, 0, foot)]
    around = F.explode(F.array(*(
        F.struct(F.struct(F.lit(a).alias("a"), F.lit(b).cast("bigint").alias("b")).alias("_at"), F.lit(v).alias("value"))
        for a, b, v in frame
    )))
    return body.unionByName(keys.select(key, around.alias("f")).select(key, "f._at", "f.value"))


def rating(score: Column) -> Column:
    """Score over 20, kept within 1 and 5, with one decimal."""
    bounded = F.least(F.lit(5.0), F.greatest(F.lit(1.0), score / F.lit(20.0)))
    return F.format_string("%.1f", text.one_decimal(bounded))


def _amount(value: Column, unit: str) -> Column:
    return F.when(value != 0, F.concat(text.half_up(value).cast("bigint").cast("string"),
                                       F.lit(f" {unit}")))


def schema_org(
    recipes: DataFrame, publisher: str, id_col: str = "id", carbs: list[str] | None = None
) -> DataFrame:
    """(id, document): one schema.org JSON text per recipe. Unset optional keys are left out.

    Instructions may be plain texts or JSON objects with `text` or `name`. Carbohydrates are read
    from the first present of `carbohydrate` and `carbs`.
    """
    has = set(recipes.columns)

    def optional(c: str) -> Column:
        return F.nullif(F.col(c), F.lit("")) if c in has else F.lit(None).cast("string")

    name = F.col("name")
    image = F.when(text.truthy("image"), F.array("image")).otherwise(
        F.array().cast("array<string>")
    )
    no_texts = F.array().cast("array<string>")
    steps = F.transform(
        F.coalesce(F.col("recipe_instructions"), no_texts),
        lambda s: F.struct(F.lit("HowToStep").alias("@type"), s.alias("text")),
    )
    parts = [
        F.lit("https://schema.org/").alias("@context"),
        F.lit("Recipe").alias("@type"),
        name.alias("name"),
        image.alias("image"),
        F.struct(F.lit("Organization").alias("@type"), F.lit(publisher).alias("name"))
        .alias("author"),
        text.iso_millis("created_at").alias("datePublished"),
        text.or_default("description",
                        F.format_string(fixed.DEFAULT_DESCRIPTION.format("%s"), name))
        .alias("description"),
        F.coalesce(F.col("recipe_ingredients"), no_texts).alias("recipeIngredient"),
        steps.alias("recipeInstructions"),
        optional("prep_time").alias("prepTime"),
        optional("cook_time").alias("cookTime"),
        optional("total_time").alias("totalTime"),
        optional("recipe_yield").alias("recipeYield"),
        optional("recipe_category").alias("recipeCategory"),
        optional("recipe_cuisine").alias("recipeCuisine"),
    ]
    if "nutrition" in has:
        known = recipes.schema["nutrition"].dataType.names
        n = F.col("nutrition")
        carb = [n[c] for c in (carbs or ["carbohydrate", "carbs"]) if c in known]
        values = [
            _amount(n["calories"], "calories").alias("calories"),
            _amount(n["protein"], "g").alias("proteinContent"),
            _amount(n["fat"], "g").alias("fatContent"),
            _amount(F.coalesce(*carb), "g").alias("carbohydrateContent"),
        ]
        some = F.coalesce(n["calories"] != 0, F.lit(False))
        for v in (n["protein"], n["fat"], F.coalesce(*carb)):
            some = some | F.coalesce(v != 0, F.lit(False))
        parts.append(
            F.when(some, F.struct(F.lit("NutritionInformation").alias("@type"), *values))
            .alias("nutrition")
        )
    if "quality_score" in has:
        score = F.col("quality_score")
        parts.append(
            F.when(
                score != 0,
                F.struct(
                    F.lit("AggregateRating").alias("@type"),
                    rating(score).alias("ratingValue"),
                    F.lit(1).alias("reviewCount"),
                ),
            ).alias("aggregateRating")
        )
    return recipes.select(F.col(id_col), F.to_json(F.struct(*parts)).alias("document"))


def step_texts(recipes: DataFrame, column: str = "instructions_json") -> DataFrame:
    """Stored JSON steps (texts or objects) to the text list `recipe_instructions`."""
    steps = variants.items(F.try_parse_json(F.col(column)))
    return recipes.withColumn("recipe_instructions", F.transform(steps, variants.step_text))


def audit_report(recipes: DataFrame, totals: DataFrame, key: str = "id") -> DataFrame:
    """id, name, ingredients and four totals, as nested columns for a JSON sink."""
    four = F.struct("calories", "protein", "fat", "carbs").alias("system_nutrition")
    return recipes.filter(F.size("recipe_ingredients") > 0).join(totals, key).select(
        key, "name", F.col("recipe_ingredients").alias("ingredients"), four
    )
