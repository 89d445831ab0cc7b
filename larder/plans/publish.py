"""Publishing queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import fixed
from larder.operators import publish as pub
from larder.plans import sql
from larder.session import table

_SITE = "https://catalogue.example"
_NOW = "2024-06-01 12:30:45.678"


def sitemap_shards(spark, d):
    """Every line of the sitemap with its place and the file of 500 lines that holds it."""
    return pub.in_shards(sitemap_lines(spark, d), per_file=500)


def sitemap_lines(spark, d):
    docs = table(spark, d, "documents", ["doc_id", "lang", "n_chars"])
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = docs.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("lang") == "de", "quarantined").when(F.col("lang") == "es", "rejected")
        .otherwise("verified").alias("qa_status"),
        F.when(F.col("n_chars") > 500,
               start + F.make_dt_interval(F.lit(0), F.lit(0), F.col("n_chars").cast("int")))
        .alias("updated_at"),
    )
    return pub.sitemap_lines(rows, _SITE, F.lit(_NOW).cast("timestamp_ntz"))


def schema_org_json(spark, d):
    part = table(spark, d, "part", ["p_partkey", "p_name", "p_type", "p_brand", "p_size", "p_retailprice"])
    size = F.col("p_size")
    created = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    recipes = part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.when(size > 5, F.concat(F.lit("https://img.example/"), F.col("p_partkey").cast("string")))
        .alias("image"),
        (created + F.make_dt_interval(size)).alias("created_at"),
        F.when(size > 20, F.concat(F.lit("The \"best\" "), "p_brand")).otherwise("").alias("description"),
        F.split("p_name", " ").alias("recipe_ingredients"),
        F.concat(
            F.lit('["Mix",{"text":"Bake '), "p_name", F.lit('"},{"name":"Serve '),
            size.cast("string"), F.lit('"}]'),
        ).alias("steps"),
        F.when(size > 30, F.lit("PT5M")).alias("prep_time"),
        F.when(size > 40, F.lit("")).alias("cook_time"),
        F.col("p_type").alias("recipe_category"),
        F.when(
            size > 10,
            F.struct(
                F.col("p_retailprice").alias("calories"), size.cast("double").alias("protein"),
                F.lit(0.0).alias("fat"), (size / 8).alias("carbs"),
            ),
        ).alias("nutrition"),
        F.when(size > 2, size * 2).otherwise(0).alias("quality_score"),
    )
    recipes = pub.step_texts(recipes, "steps")
    return pub.schema_org(recipes, "Larder Kitchen")


_LINES_SQL = f"""SELECT '  <url><loc>{_SITE}' || unnest(['{"', '".join(fixed.SITE_PAGES)}'])
          || '</loc><changefreq>daily</changefreq></url>' AS line
        UNION ALL
        SELECT '  <url><loc>{_SITE}/recipe/' || doc_id || '</loc><lastmod>' ||
          strftime(CASE WHEN n_chars > 500 THEN TIMESTAMP '2024-01-01' + to_minutes(n_chars)
            ELSE TIMESTAMP '{_NOW}' END, '%Y-%m-%dT%H:%M:%S.%g') || 'Z</lastmod></url>'
        FROM documents WHERE lang NOT IN ('de', 'es')"""

QUERIES = {
    "sitemap_lines": (sitemap_lines, _LINES_SQL),
    "sitemap_shards": (
        sitemap_shards,
        f"""SELECT line, place, place // 500 AS shard
        FROM (SELECT line, row_number() OVER (ORDER BY line) - 1 AS place FROM ({_LINES_SQL}))""",
    ),
    "schema_org_json": (
        schema_org_json,
        f"""
        WITH s AS (SELECT *, least(5.0::DOUBLE, greatest(1.0::DOUBLE,
            (p_size * 2) / 20.0::DOUBLE)) AS bounded FROM part)
        SELECT p_partkey AS id,
          '{{"@context":"https://schema.org/","@type":"Recipe","name":"' || p_name || '","image":['
          || CASE WHEN p_size > 5 THEN '"https://img.example/' || p_partkey || '"' ELSE '' END
          || '],"author":{{"@type":"Organization","name":"Larder Kitchen"}},"datePublished":"'
          || strftime(TIMESTAMP '2024-01-01' + to_days(p_size), '%Y-%m-%dT%H:%M:%S.%g') || 'Z"'
          || ',"description":"' || CASE WHEN p_size > 20 THEN 'The \\"best\\" ' || p_brand
            ELSE 'A delicious recipe for ' || p_name || '.' END
          || '","recipeIngredient":["' || replace(p_name, ' ', '","')
          || '"],"recipeInstructions":[{{"@type":"HowToStep","text":"Mix"}},'
          || '{{"@type":"HowToStep","text":"Bake ' || p_name || '"}},'
          || '{{"@type":"HowToStep","text":"Serve ' || p_size || '"}}]'
          || CASE WHEN p_size > 30 THEN ',"prepTime":"PT5M"' ELSE '' END
          || ',"recipeCategory":"' || p_type || '"'
          || CASE WHEN p_size > 10 THEN ',"nutrition":{{"@type":"NutritionInformation","calories":"'
            || CAST(floor(p_retailprice + 0.5::DOUBLE) AS BIGINT) || ' calories","proteinContent":"'
            || p_size || ' g","carbohydrateContent":"'
            || CAST(floor(p_size / 8::DOUBLE + 0.5::DOUBLE) AS BIGINT) || ' g"}}' ELSE '' END
          || CASE WHEN p_size > 2 THEN ',"aggregateRating":{{"@type":"AggregateRating","ratingValue":"'
            || printf('%.1f', {sql.one_decimal('bounded')}) || '","reviewCount":1}}' ELSE '' END
          || '}}' AS document
        FROM s""",
    ),
}
