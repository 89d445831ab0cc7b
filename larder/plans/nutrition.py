"""Nutrition queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import fixed, text
from larder.operators import foods as fd
from larder.operators import nutrition as n
from larder.operators.shaping import spread
from larder.plans import sql
from larder.session import table

_FOOD = {
    "STANDARD": "brown sugar", "PROMO": "olive oil", "MEDIUM": "egg, beaten",
    "LARGE": "chicken breast", "ECONOMY": "flour", "SMALL": "pineapple",
}
_NOW = "2024-06-01 00:00:00"


def _food(kind):
    out = None
    for k, v in _FOOD.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out


_FOOD_SQL = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FOOD.items()) + " END"


def term_clean(spark, d):
    part = table(spark, d, "part", ["p_partkey", "p_name", "p_type", "p_brand"])
    raw = F.concat(
        F.lit("Melted "), "p_name", F.lit(", ("), F.lower("p_type"), F.lit(") all-purpose; "), "p_brand"
    )
    single = (
        F.when(F.col("p_type") == "SMALL", F.lit("EGGS (beaten)"))
        .when(F.col("p_type") == "LARGE", F.lit("White rice, steamed!"))
        .when(F.col("p_type") == "PROMO", F.lit("room temperature Butter"))
        .when(F.col("p_type") == "MEDIUM", F.lit("hot-chopped"))
        .otherwise(F.lit("all purpose  flour"))
    )
    return part.select(
        "p_partkey", text.clean_term(raw).alias("term"), text.clean_term(single).alias("mapped"),
        text.cache_key(text.clean_term(single)).alias("term_key"),
    )


def _lines(spark, d):
    """Ingredient lines: a line item is a quantity of a part, whose type names the food."""
    items = table(
        spark, d, "lineitem",
        ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"],
    )
    part = table(spark, d, "part", ["p_partkey", "p_name", "p_type"])
    qty = F.col("l_quantity").cast("int").cast("string")
    amount = (
        F.when(F.col("l_linestatus") == "F", F.concat(qty, F.lit(" 1/2")))
        .when(F.col("l_linenumber") == 1, F.concat(qty, F.lit("/4")))
        .when(F.col("l_linenumber") == 2, F.concat(qty, F.lit(".25")))
        .otherwise(qty)
    )
    unit = (
        F.when(F.col("l_returnflag") == "A", F.lit(" Cups "))
        .when(F.col("l_returnflag") == "N", F.lit(" T "))
        .when(F.col("l_linenumber") == 3, F.lit("g "))
        .otherwise(F.lit(" "))
    )
    name = F.concat("p_name", F.lit(" "), _food(F.col("p_type")))
    line = F.when(F.col("l_linenumber") == 7, name).otherwise(F.concat(amount, unit, name))
    return spread(items).join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", F.col("l_linenumber").alias("pos"), "l_partkey", line.alias("line")
    )


_LINES_SQL = f"""
    q AS (SELECT l_orderkey, l_linenumber AS pos, l_partkey, l_returnflag, l_linestatus, l_linenumber,
      CAST(l_quantity AS INTEGER) AS whole, p_name || ' ' || {_FOOD_SQL} AS food
      FROM lineitem JOIN part ON l_partkey = p_partkey),
    l AS (SELECT l_orderkey, pos, l_partkey,
      CASE WHEN l_linenumber = 7 THEN food ELSE
        whole || CASE WHEN l_linestatus = 'F' THEN ' 1/2' WHEN l_linenumber = 1 THEN '/4'
          WHEN l_linenumber = 2 THEN '.25' ELSE '' END
        || CASE WHEN l_returnflag = 'A' THEN ' Cups ' WHEN l_returnflag = 'N' THEN ' T '
          WHEN l_linenumber = 3 THEN 'g ' ELSE ' ' END || food END AS line,
      CASE WHEN l_linenumber = 7 THEN 1.0::DOUBLE
        WHEN l_linestatus = 'F' THEN whole + 0.5::DOUBLE
        WHEN l_linenumber = 1 THEN whole / 4.0::DOUBLE
        WHEN l_linenumber = 2 THEN whole + 0.25::DOUBLE ELSE CAST(whole AS DOUBLE) END AS qty,
      CASE WHEN l_linenumber = 7 THEN '' WHEN l_returnflag = 'A' THEN 'Cups'
        WHEN l_returnflag = 'N' THEN 'T' WHEN l_linenumber = 3 THEN 'g'
        ELSE split_part(food, ' ', 1) END AS unit,
      CASE WHEN l_linenumber <> 7 AND l_returnflag = 'R' AND l_linenumber <> 3
        THEN substr(food, length(split_part(food, ' ', 1)) + 2) ELSE food END AS name
      FROM q),
    t AS (SELECT *, 'v9:' || lower({sql.clean_term('name')}) AS term_key,
      {sql.grams('unit', 'qty', 'name')} AS weight FROM l)"""


def quantity_parse(spark, d):
    return n.parsed(_lines(spark, d)).select("l_orderkey", "pos", "l_partkey", "line", "qty", "unit", "name")


def unit_grams(spark, d):
    rows = n.parsed(_lines(spark, d))
    return n.weighed(rows, weight="weight").select("l_orderkey", "pos", "l_partkey", "weight")


def _records(spark, d, kinds):
    """Nutrition per term, from the parts of some types."""
    part = table(spark, d, "part", ["p_partkey", "p_name", "p_type", "p_size", "p_retailprice"])
    chosen = part.filter(F.col("p_type").isin(kinds))
    name = F.concat("p_name", F.lit(" "), _food(F.col("p_type")))
    short = F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" "), _food(F.col("p_type")))
    both = chosen.select(
        F.explode(F.array(name, short)).alias("name"), "p_size", "p_retailprice", "p_type"
    )
    values = {
        "calories": F.max("p_retailprice"),
        "protein": F.max("p_size").cast("double"),
        "fat": F.min("p_size").cast("double") / 8,
        "carbs": F.count(F.lit(1)).cast("double"),
        "fiber": F.max("p_size").cast("double"),
        "sugar": F.min("p_size").cast("double"),
        "calcium_mg": F.lit(12.0),
        "iron_mg": F.min("p_size").cast("double") / 16,
        "vitamin_a_mcg": F.lit(0.0),
        "vitamin_c_mg": F.lit(None).cast("double"),
    }
    serving = F.when(F.max("p_type") == "MEDIUM", F.lit(50.0)).otherwise(F.lit(None))
    return (
        both.groupBy(text.cache_key(text.clean_term("name")).alias("term_key"))
        .agg(
            F.struct(
                *[values[x].alias(x) for x in fixed.NUTRIENTS], serving.alias("serving_size_g")
            ).alias("nutrition")
        )
    )


_RECORDS_SQL = f"""
    b AS (SELECT p_type, p_size, p_retailprice, p_name || ' ' || {_FOOD_SQL} AS name FROM part
      UNION ALL
      SELECT p_type, p_size, p_retailprice, split_part(p_name, ' ', 2) || ' ' || {_FOOD_SQL} FROM part),
    r AS (SELECT 'v9:' || lower({sql.clean_term('name')}) AS term_key, p_type,
      max(p_retailprice) AS calories, CAST(max(p_size) AS DOUBLE) AS protein,
      CAST(min(p_size) AS DOUBLE) / 8::DOUBLE AS fat, CAST(count(*) AS DOUBLE) AS carbs,
      CAST(max(p_size) AS DOUBLE) AS fiber, CAST(min(p_size) AS DOUBLE) AS sugar,
      12.0::DOUBLE AS calcium_mg, CAST(min(p_size) AS DOUBLE) / 16::DOUBLE AS iron_mg,
      0.0::DOUBLE AS vitamin_a_mcg, CAST(NULL AS DOUBLE) AS vitamin_c_mg,
      CASE WHEN p_type = 'MEDIUM' THEN 50.0::DOUBLE ELSE 100.0::DOUBLE END AS serving,
      CASE p_type WHEN 'STANDARD' THEN 'usda' WHEN 'PROMO' THEN 'usda' WHEN 'MEDIUM' THEN 'usda'
        WHEN 'LARGE' THEN 'usda' WHEN 'ECONOMY' THEN 'second' END AS source,
      p_type IN ('STANDARD', 'PROMO') AS cached
      FROM b WHERE p_type <> 'SMALL' GROUP BY ALL)"""


def _known(spark, d):
    cache = _records(spark, d, ["STANDARD", "PROMO"]).withColumn("source", F.lit("usda"))
    sources = [
        ("usda", _records(spark, d, ["MEDIUM", "LARGE"])),
        ("second", _records(spark, d, ["ECONOMY", "LARGE"])),
    ]
    return cache, sources


def _analysed(spark, d):
    return n.analyse_lines(_lines(spark, d), *_known(spark, d))


def _resolved(spark, d):
    return n.resolve_terms(n.line_terms(_lines(spark, d)), *_known(spark, d))


def nutrition_totals(spark, d):
    stats = _analysed(spark, d)
    return n.totals(stats, "l_orderkey")


def nutrition_lookup(spark, d):
    resolved = _resolved(spark, d)
    return resolved.select("term_key", "source", "cached", F.col("nutrition.calories").alias("calories"))


def nutrition_cache_rows(spark, d):
    resolved = _resolved(spark, d)
    return n.new_cache_rows(resolved, F.lit(_NOW).cast("timestamp_ntz")).select(
        "term_key", "source", F.col("nutrition.protein").alias("protein"), "created_at"
    )


def nutrition_breakdown(spark, d):
    stats = _analysed(spark, d)
    rows = n.breakdown(stats, "l_orderkey")
    return rows.select(
        "l_orderkey", "pos", "ingredient", "status", "unit", "qty", "source",
        "weight_grams", "calories", "iron_mg",
    )


def _part_recipes(spark, d):
    part = spread(table(spark, d, "part", ["p_partkey", "p_name", "p_type", "p_size"]))
    size = F.col("p_size").cast("string")
    food = _food(F.col("p_type"))
    return part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.array(
            F.concat(size, F.lit(" g "), "p_name", F.lit(" "), food),
            F.concat(size, F.lit("/2 tbsp "), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" "), food),
            F.lit("a pinch of salt"),
        ).alias("recipe_ingredients"),
    )


def _part_analysis(spark, d):
    return n.analyse(_part_recipes(spark, d), *_known(spark, d))


def breakdown_lists(spark, d):
    lists = n.breakdown_lists(_part_analysis(spark, d), "id")
    shown = F.transform(
        "entries",
        lambda e: F.concat_ws(
            ":", e["ingredient"], e["status"], e["source"],
            F.round(e["weight_grams"], 6).cast("decimal(16,6)").cast("string"),
        ),
    )
    return lists.select("id", "part", F.array_join(shown, "|").alias("entries"))


def audit_report(spark, d):
    from larder.operators.publish import audit_report as report

    totals = n.totals(_part_analysis(spark, d), "id")
    out = report(_part_recipes(spark, d), totals)
    return out.select(
        "id", "name", F.array_join("ingredients", "|").alias("ingredients"),
        *[F.col(f"system_nutrition.{x}").alias(x) for x in ("calories", "protein", "fat", "carbs")],
    )


def food_records(spark, d):
    """Nutrients and all portions per user of the events."""
    events = table(spark, d, "events", ["event_id", "user_id", "event_type", "value"])
    amounts = events.select(
        F.col("user_id").alias("fdc_id"), F.col("event_id").alias("seq"),
        _nutrient(F.col("event_type")).alias("nutrient_id"), F.col("value").alias("amount"),
    )
    out = fd.food_records(amounts, _portions(spark, d))
    shown = F.transform("nutrition.portions", lambda p: F.concat(
        p["measure"], F.lit("="), p["gramWeight"].cast("decimal(12,2)").cast("string")))
    return out.select(
        "fdc_id", "part", F.col("nutrition.calories").alias("calories"),
        F.col("nutrition.iron_mg").alias("iron_mg"), F.col("nutrition.fat").alias("fat"),
        F.col("nutrition.serving_size_g").alias("serving_size_g"),
        F.array_join(shown, "|").alias("portions"),
    )


def nutrition_portions(spark, d):
    """Recipes of two lines, weighed by the portions of their foods where one fits."""
    part = spread(table(spark, d, "part", ["p_partkey", "p_name", "p_type", "p_size"]))
    size = F.col("p_size").cast("string")
    food = F.concat("p_name", F.lit(" pie"))
    unit = (
        F.when(F.col("p_type") == "SMALL", F.lit(" cups "))
        .when(F.col("p_type") == "LARGE", F.lit(" tablespoons "))
        .when(F.col("p_type") == "PROMO", F.lit(" oz "))
        .otherwise(F.lit(" slices "))
    )
    recipes = part.select(
        F.col("p_partkey").alias("id"),
        F.array(F.concat(size, unit, food), food).alias("recipe_ingredients"),
    )
    portions = F.array(
        *[
            F.struct(F.lit(m).alias("measure"), F.lit(g).alias("gramWeight"))
            for m, g in [("1 Tablespoon", 7.5), ("cup, packed", 80.25), ("cup, loose", 60.0),
                         ("Large slice", 33.0)]
        ]
    )
    known = table(spark, d, "part", ["p_name", "p_size"]).groupBy(
        text.cache_key(text.clean_term(F.concat("p_name", F.lit(" pie")))).alias("term_key")
    ).agg(
        F.struct(
            *[F.max("p_size").cast("double").alias(x) for x in fixed.NUTRIENTS],
            F.lit(0.0).alias("serving_size_g"), portions.alias("portions"),
        ).alias("nutrition")
    )
    none = known.limit(0).withColumn("source", F.lit("usda"))
    stats = n.analyse(recipes, none, [("usda", known)])
    return n.totals(stats, "id").select("id", "calories", "iron_mg", "sugar")


def _foods(spark, d):
    part = table(spark, d, "part", ["p_partkey", "p_name", "p_type", "p_brand", "p_size"])
    kind = (
        F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), "Branded")
        .when(F.col("p_brand").isin("Brand#3", "Brand#4", "Brand#5"), "SR Legacy")
        .when(F.col("p_brand").isin("Brand#6", "Brand#7"), "Foundation")
        .otherwise("Survey (FNDDS)")
    )
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    return part.select(
        F.col("p_partkey").alias("fdc_id"),
        F.when(F.col("p_size") > 25, F.concat(F.initcap(second), F.lit(", "), first))
        .when(F.col("p_size") > 10, F.concat(F.col("p_name"), F.lit(" "), F.lower("p_type"), F.lit(" dried")))
        .otherwise(F.concat(F.col("p_name"), F.lit(", "), F.lower("p_type"))).alias("description"),
        kind.alias("data_type"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("double")).otherwise(0.0).alias("energy"),
    )


def _terms(spark, d):
    part = table(spark, d, "part", ["p_name", "p_type"])
    words = F.split("p_name", " ")
    return part.select(
        F.explode(F.array(
            "p_name", words[0], words[1],
            F.concat(words[1], F.lit(" dried")), F.concat(words[1], F.lit(" tea")),
            F.concat("p_name", F.lit(" "), F.lower("p_type")),
        )).alias("term")
    )


def food_pick(spark, d):
    best = fd.best_foods(_terms(spark, d), _foods(spark, d))
    return best.select("term", "fdc_id", "description", "data_type", "energy", "score")


_FOODS_SQL = """
    f AS (SELECT p_partkey AS fdc_id,
      CASE WHEN p_size > 25 THEN upper(left(w2, 1)) || substr(w2, 2) || ', ' || w1
        WHEN p_size > 10 THEN p_name || ' ' || lower(p_type) || ' dried'
        ELSE p_name || ', ' || lower(p_type) END AS description,
      CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'Branded'
        WHEN p_brand IN ('Brand#3', 'Brand#4', 'Brand#5') THEN 'SR Legacy'
        WHEN p_brand IN ('Brand#6', 'Brand#7') THEN 'Foundation' ELSE 'Survey (FNDDS)' END
        AS data_type,
      CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE 0.0::DOUBLE END AS energy
      FROM (SELECT *, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2
        FROM part)),
    t AS (SELECT DISTINCT unnest([p_name, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2),
      split_part(p_name, ' ', 2) || ' dried', split_part(p_name, ' ', 2) || ' tea',
      p_name || ' ' || lower(p_type)]) AS term FROM part)"""


def _pick_sql() -> str:
    words = sql.word_list
    low = f"regexp_matches(term, '(?i){fixed.LOW_CALORIE_QUERY}')"
    return f"""
    WITH {_FOODS_SQL},
    fw AS (SELECT *, list_distinct({words('description')}) AS fw FROM f),
    tw AS (SELECT *, list_distinct({words('term')}) AS tw FROM t),
    c AS (SELECT term, fdc_id, description, data_type, energy, len(fw) AS words
      FROM tw JOIN fw ON len(list_intersect(tw, fw)) = len(tw)),
    s AS (SELECT *, lower(description) AS low_d,
      data_type = 'Branded' AS branded,
      NOT regexp_matches(term, '(?i){fixed.PROCESSED_FOOD}')
        AND regexp_matches(description, '(?i){fixed.PROCESSED_FOOD}') AS unwanted,
      {low} AS low_cal
      FROM c),
    a AS (SELECT *, min(branded) OVER (PARTITION BY term) AS only_branded FROM s),
    b AS (SELECT *, min(unwanted) OVER (PARTITION BY term) AS only_unwanted FROM a
      WHERE NOT branded OR only_branded),
    g AS (SELECT *, CAST(CASE WHEN low_d = term THEN 500
        WHEN starts_with(low_d, term || ',') OR starts_with(low_d, term || ' ') THEN 300
        WHEN contains(low_d, term) THEN 10 ELSE -1000 END
      + CASE data_type WHEN 'SR Legacy' THEN 100 WHEN 'Foundation' THEN 90
        WHEN 'Survey (FNDDS)' THEN 50 ELSE 0 END
      - length(description) - CASE WHEN energy = 0 AND NOT low_cal THEN 200 ELSE 0 END AS INTEGER)
        AS score
      FROM b WHERE NOT unwanted OR only_unwanted),
    w AS (SELECT *, row_number() OVER (PARTITION BY term
      ORDER BY CASE WHEN low_cal OR energy > 0 THEN 0 ELSE 1 END, score DESC, words,
        length(description), fdc_id) AS rn FROM g)
    SELECT term, fdc_id, description, data_type, energy, score FROM w WHERE rn = 1"""


_EVENT_NUTRIENT = {"click": 1008, "view": 1003, "error": 1089, "signup": 2000, "purchase": 1162}


def _nutrient(kind):
    out = None
    for k, v in _EVENT_NUTRIENT.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out


def nutrient_pivot(spark, d):
    events = table(spark, d, "events", ["event_id", "user_id", "event_type", "value"])
    rows = events.select(
        F.col("user_id").alias("fdc_id"), F.col("event_id").alias("seq"),
        _nutrient(F.col("event_type")).alias("nutrient_id"), F.col("value").alias("amount"),
    )
    return fd.nutrient_record(rows)


def _portions(spark, d):
    events = table(spark, d, "events", ["event_id", "user_id", "event_type", "value"])
    return events.select(
        F.col("user_id").alias("fdc_id"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "click", "Cup, packed")
        .when(F.col("event_type") == "view", "").alias("unit_name"),
        F.when(F.col("event_type") == "view", "1 LARGE")
        .when(F.col("event_type") == "error", "teaspoon")
        .when(F.col("event_type") == "signup", "").alias("modifier"),
        F.col("value").alias("gram_weight"),
    )


def portion_weights(spark, d):
    return n.portion_weights(_portions(spark, d).withColumn("measure", n.portion_measure()))


def portion_lists(spark, d):
    lists = n.portion_list(_portions(spark, d))
    shown = F.transform("entries", lambda e: F.concat(
        e["measure"], F.lit("="), e["gramWeight"].cast("decimal(12,2)").cast("string")))
    return lists.select("fdc_id", "part", F.array_join(shown, "|").alias("entries"))


_SUMS = ", ".join(
    f"{sql.rounded_total(f'sum(coalesce({x}, 0.0::DOUBLE) * (weight / serving))', x)} AS {x}"
    for x in fixed.NUTRIENTS
)

QUERIES = {
    "term_clean": (
        term_clean,
        f"""WITH s AS (SELECT p_partkey,
          'Melted ' || p_name || ', (' || lower(p_type) || ') all-purpose; ' || p_brand AS raw,
          CASE p_type WHEN 'SMALL' THEN 'EGGS (beaten)' WHEN 'LARGE' THEN 'White rice, steamed!'
            WHEN 'PROMO' THEN 'room temperature Butter' WHEN 'MEDIUM' THEN 'hot-chopped'
            ELSE 'all purpose  flour' END AS single FROM part)
        SELECT p_partkey, {sql.clean_term('raw')} AS term, {sql.clean_term('single')} AS mapped,
          'v9:' || lower({sql.clean_term('single')}) AS term_key FROM s""",
    ),
    "quantity_parse": (
        quantity_parse,
        f"WITH {_LINES_SQL} SELECT l_orderkey, pos, l_partkey, line, qty, unit, name FROM t",
    ),
    "unit_grams": (
        unit_grams,
        f"""WITH {_LINES_SQL}
        SELECT l_orderkey, pos, l_partkey, weight FROM t""",
    ),
    "nutrition_totals": (
        nutrition_totals,
        f"""WITH {_LINES_SQL}, {_RECORDS_SQL}
        SELECT l_orderkey, {_SUMS}
        FROM t LEFT JOIN r ON t.term_key = r.term_key GROUP BY l_orderkey""",
    ),
    "nutrition_lookup": (
        nutrition_lookup,
        f"""WITH {_LINES_SQL}, {_RECORDS_SQL}
        SELECT DISTINCT t.term_key, source, coalesce(cached, false) AS cached, calories
        FROM t LEFT JOIN r ON t.term_key = r.term_key""",
    ),
    "nutrition_cache_rows": (
        nutrition_cache_rows,
        f"""WITH {_LINES_SQL}, {_RECORDS_SQL}
        SELECT DISTINCT t.term_key, source, protein, TIMESTAMP '{_NOW}' AS created_at
        FROM t JOIN r ON t.term_key = r.term_key WHERE NOT cached""",
    ),
    "nutrition_breakdown": (
        nutrition_breakdown,
        f"""WITH {_LINES_SQL}, {_RECORDS_SQL}
        SELECT l_orderkey, pos, line AS ingredient,
          CASE WHEN r.term_key IS NULL THEN 'not_found' ELSE 'found' END AS status, unit, qty,
          source, weight AS weight_grams, calories * (weight / serving) AS calories,
          iron_mg * (weight / serving) AS iron_mg
        FROM t LEFT JOIN r ON t.term_key = r.term_key""",
    ),
    "breakdown_lists": (
        breakdown_lists,
        f"""
        WITH {_RECORDS_SQL},
        i AS (SELECT p_partkey AS id, p_size || ' g ' || p_name || ' ' || {_FOOD_SQL} AS l0,
          p_size || '/2 tbsp ' || split_part(p_name, ' ', 2) || ' ' || {_FOOD_SQL} AS l1, p_size,
          p_name || ' ' || {_FOOD_SQL} AS n0,
          split_part(p_name, ' ', 2) || ' ' || {_FOOD_SQL} AS n1, p_type FROM part)
        SELECT id, CAST(0 AS BIGINT) AS part,
          l0 || ':' || CASE WHEN a.source IS NULL THEN 'not_found:' ELSE 'found:' || a.source || ':'
            END || printf('%.6f', CAST(p_size AS DOUBLE))
          || '|' || l1 || ':' || CASE WHEN b.source IS NULL THEN 'not_found:'
            ELSE 'found:' || b.source || ':' END
          || CAST(CAST(round({sql.grams("'tbsp'", "p_size / 2.0::DOUBLE", "n1")}, 6) AS DECIMAL(16,6))
            AS VARCHAR)
          || '|a pinch of salt:not_found:100.000000' AS entries
        FROM i LEFT JOIN r a ON a.term_key = 'v9:' || lower({sql.clean_term('n0')})
          LEFT JOIN r b ON b.term_key = 'v9:' || lower({sql.clean_term('n1')})""",
    ),
    "audit_report": (
        audit_report,
        f"""
        WITH {_RECORDS_SQL},
        i AS (SELECT p_partkey AS id, p_name AS name,
          p_size || ' g ' || p_name || ' ' || {_FOOD_SQL} AS l0,
          p_size || '/2 tbsp ' || split_part(p_name, ' ', 2) || ' ' || {_FOOD_SQL} AS l1,
          p_name || ' ' || {_FOOD_SQL} AS n0, CAST(p_size AS DOUBLE) AS w0,
          split_part(p_name, ' ', 2) || ' ' || {_FOOD_SQL} AS n1, p_size FROM part),
        j AS (SELECT *, {sql.grams("'tbsp'", "p_size / 2.0::DOUBLE", "n1")} AS w1 FROM i),
        x AS (SELECT j.id, j.name, l0, l1, unnest([n0, n1]) AS n, unnest([w0, w1]) AS weight FROM j)
        SELECT id, name, l0 || '|' || l1 || '|a pinch of salt' AS ingredients,
          {', '.join(
              f"{sql.rounded_total(f'sum(coalesce({x}, 0.0::DOUBLE) * (weight / serving))', x)} AS {x}"
              for x in ('calories', 'protein', 'fat', 'carbs'))}
        FROM x LEFT JOIN r ON r.term_key = 'v9:' || lower({sql.clean_term('n')})
        GROUP BY id, name, l0, l1""",
    ),
    "nutrition_portions": (
        nutrition_portions,
        f"""
        WITH k AS (SELECT {sql.clean_term("p_name || ' pie'")} AS name, CAST(max(p_size) AS DOUBLE) AS v
          FROM part GROUP BY 1),
        w AS (SELECT p_partkey AS id, v,
          p_size * CASE p_type WHEN 'SMALL' THEN 80.25::DOUBLE WHEN 'LARGE' THEN 7.5::DOUBLE
            WHEN 'PROMO' THEN 28.35::DOUBLE ELSE 33.0::DOUBLE END AS w0, 33.0::DOUBLE AS w1
          FROM part JOIN k ON {sql.clean_term("p_name || ' pie'")} = name),
        s AS (SELECT id, v * (w0 / 100.0::DOUBLE) + v * (w1 / 100.0::DOUBLE) AS total FROM w)
        SELECT id, {sql.rounded_total('total', 'calories')} AS calories,
          {sql.rounded_total('total', 'iron_mg')} AS iron_mg,
          {sql.rounded_total('total', 'sugar')} AS sugar FROM s""",
    ),
    "food_records": (
        food_records,
        """WITH n AS (SELECT user_id,
          coalesce(arg_min(value, event_id) FILTER (event_type = 'click'), 0.0::DOUBLE) AS calories,
          coalesce(arg_min(value, event_id) FILTER (event_type = 'error'), 0.0::DOUBLE) AS iron_mg
        FROM events GROUP BY user_id)
        SELECT e.user_id AS fdc_id, CAST(floor(event_id / 1000) AS BIGINT) AS part,
          any_value(calories) AS calories, any_value(iron_mg) AS iron_mg,
          0.0::DOUBLE AS fat, 100.0::DOUBLE AS serving_size_g,
          string_agg(CASE event_type WHEN 'click' THEN 'Cup, packed' WHEN 'view' THEN '1 LARGE'
            WHEN 'error' THEN 'teaspoon' ELSE 'unit' END || '='
            || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR), '|' ORDER BY event_id) AS portions
        FROM events e JOIN n ON n.user_id = e.user_id GROUP BY e.user_id, part""",
    ),
    "food_pick": (food_pick, _pick_sql()),
    "nutrient_pivot": (
        nutrient_pivot,
        "SELECT user_id AS fdc_id, " + ", ".join(
            (
                f"coalesce(arg_min(value, event_id) FILTER (event_type = '{k}'), 0.0::DOUBLE) AS {x}"
                if (k := next((e for e, i in _EVENT_NUTRIENT.items() if i == number), None))
                else f"0.0::DOUBLE AS {x}"
            )
            for x, number in fixed.NUTRIENT_IDS.items()
        ) + " FROM events GROUP BY user_id",
    ),
    "portion_weights": (
        portion_weights,
        """SELECT user_id AS fdc_id,
          arg_min(value, event_id) FILTER (event_type = 'click') AS portion_cup,
          CAST(NULL AS DOUBLE) AS portion_tbsp,
          arg_min(value, event_id) FILTER (event_type = 'error') AS portion_tsp,
          CAST(NULL AS DOUBLE) AS portion_slice, CAST(NULL AS DOUBLE) AS portion_oz,
          arg_min(value, event_id) FILTER (event_type = 'view') AS portion_piece
        FROM events GROUP BY user_id""",
    ),
    "portion_lists": (
        portion_lists,
        """SELECT user_id AS fdc_id, CAST(floor(event_id / 1000) AS BIGINT) AS part,
          string_agg(CASE event_type WHEN 'click' THEN 'Cup, packed' WHEN 'view' THEN '1 LARGE'
            WHEN 'error' THEN 'teaspoon' ELSE 'unit' END || '='
            || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR), '|' ORDER BY event_id) AS entries
        FROM events GROUP BY ALL""",
    ),
}
