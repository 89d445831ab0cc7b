"""Ingredient lines to nutrition totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import fixed, text
from larder.operators.shaping import attach, first_per, list_parts, once


# --- lines -------------------------------------------------------------------------


def lines(recipes: DataFrame, key: str, ingredients: str) -> DataFrame:
    """One row per ingredient line with its place; a recipe without lines keeps one empty row."""
    return recipes.select(key, F.posexplode_outer(ingredients).alias("pos", "line"))


def parsed(df: DataFrame, line: str = "line") -> DataFrame:
    """Add quantity, unit, name and search term of a line; an unparsable line is one piece.

    The pattern is applied once per line, and its three groups are cut apart at a mark.
    """
    mark = "\u0001"
    marked = F.regexp_replace(line, fixed.LINE_PATTERN, f"$1{mark}$2{mark}$3")
    out = once(df, "_parts", F.split(marked, mark))
    match = (F.size("_parts") == 3) & ~F.col(line).contains(mark)
    qty, unit, name = (F.get("_parts", F.lit(i)) for i in range(3))
    return (
        out.withColumn("qty", F.when(match, text.parse_quantity(qty)).otherwise(1.0))
        .withColumn("unit", F.when(match, unit).otherwise(""))
        .withColumn("name", F.when(match & (name != ""), name).otherwise(F.col(line)))
        .withColumn("term", text.clean_term("name"))
        .drop("_parts")
    )


# --- weight ------------------------------------------------------------------------


def unit_key(unit: Column, strict_parity: bool = True) -> Column:
    """Lowercased unit without one final s.

    With `strict_parity=False`, `tbs`, a capital `T` and `pinches` mean what they say.
    """
    plain = F.regexp_replace(F.lower(F.coalesce(unit, F.lit(""))), "s$", "")
    if strict_parity:
        return plain
    return (
        F.when((unit == "T") | (F.lower(unit) == "tbs"), F.lit("tbsp"))
        .when(F.lower(unit) == "pinches", F.lit("pinch"))
        .otherwise(plain)
    )


def _first_contained(name: Column, table: list[tuple[str, float]], default: float) -> Column:
    out = None
    for key, value in table:
        hit = name.contains(key)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def density(low_name: Column, strict_parity: bool = True) -> Column:
    """Grams per millilitre by the lowercased name. In table order `sugar` hides `brown sugar`;
    with `strict_parity=False` the longer key comes first."""
    table = fixed.DENSITIES
    if not strict_parity:
        table = sorted(table, key=lambda e: -len(e[0]))
    return _first_contained(low_name, table, fixed.DEFAULT_DENSITY)


def piece_weight(low_name: Column) -> Column:
    """Grams of one piece by the lowercased name."""
    out = None
    for groups, grams in fixed.PIECE_WEIGHTS:
        hit = F.lit(True)
        for group in groups:
            hit = hit & text.contains_any(low_name, group)
        out = F.when(hit, grams) if out is None else out.when(hit, grams)
    return out.otherwise(fixed.DEFAULT_PIECE_WEIGHT)


def _factor(u: Column, table: list[tuple[list[str], float]]) -> Column:
    pairs = [F.lit(x) for units, factor in table for unit in units for x in (unit, factor)]
    return F.create_map(*pairs)[u]


def weighed(
    df: DataFrame, unit: str = "unit", qty: str = "qty", name: str = "name",
    weight: str = "weight_grams", strict_parity: bool = True,
) -> DataFrame:
    """Add the weight of a quantity: direct, by volume and density, or by the piece."""
    keyed = df.withColumn("_u", unit_key(F.col(unit), strict_parity)).withColumn(
        "_low", F.lower(name)
    )
    factors = keyed.withColumn(
        "_direct", _factor(F.col("_u"), fixed.WEIGHT_UNITS + fixed.COUNT_UNITS)
    ).withColumn("_volume", _factor(F.col("_u"), fixed.VOLUME_UNITS))
    low = F.col("_low")
    grams = (
        F.when(F.col("_direct").isNotNull(), F.col(qty) * F.col("_direct"))
        .when(F.col("_volume").isNotNull(),
              F.col(qty) * F.col("_volume") * density(low, strict_parity))
        .otherwise(F.col(qty) * piece_weight(low))
    )
    return factors.withColumn(weight, grams).drop("_u", "_low", "_direct", "_volume")


def portion_list(portions: DataFrame, width: int = 1000) -> DataFrame:
    """Household portions per food, ordered: `portions(fdc_id, seq, unit_name, modifier,
    gram_weight)`. Measure is the unit's name, else the modifier, else `unit`."""
    entry = F.struct(portion_measure().alias("measure"), F.col("gram_weight").alias("gramWeight"))
    return list_parts(portions, ["fdc_id"], "seq", entry, width)


def portion_measure() -> Column:
    return text.or_default("unit_name", text.or_default("modifier", "unit"))


def portion_weights(portions: DataFrame, key: str = "fdc_id") -> DataFrame:
    """Per food and class of unit, grams of the first portion that fits; one partial aggregate.

    Takes rows `(key, seq, measure, gram_weight)`.
    """
    low = F.lower("measure")
    firsts = []
    for name, (_, hints) in fixed.PORTION_CLASSES.items():
        fits = text.contains_any(low, hints)
        firsts.append(
            F.min_by(F.when(fits, F.col("gram_weight")), F.when(fits, F.col("seq")))
            .alias(f"portion_{name}")
        )
    return portions.groupBy(key).agg(*firsts)


# --- lookup ------------------------------------------------------------------------


def known_foods(
    cache: DataFrame, sources: list[tuple[str, DataFrame]], key: str = "term_key"
) -> DataFrame:
    """Every known term once with its nutrition: from the cache, else from the first source.

    All tables hold a column `key` once each, and `nutrition`; the cache also its `source`.
    `cached` tells where a term came from, so that new finds can be written to the cache.
    """
    every = cache.select(key, "nutrition", "source", F.lit(0).alias("place"))
    for i, (name, table) in enumerate(sources, start=1):
        every = every.unionByName(
            table.select(key, "nutrition", F.lit(name).alias("source"), F.lit(i).alias("place"))
        )
    some = every.filter(F.col("nutrition").isNotNull() & F.col(key).isNotNull())
    return first_per(some, [key], [F.asc("place")]).withColumn(
        "cached", F.col("place") == 0
    ).drop("place")


def resolve_terms(
    keys: DataFrame, cache: DataFrame, sources: list[tuple[str, DataFrame]], key: str = "term_key"
) -> DataFrame:
    """Nutrition of every distinct term, null where no table knows it."""
    wanted = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    return wanted.join(known_foods(cache, sources, key), key, "left").withColumn(
        "cached", F.coalesce("cached", F.lit(False))
    )


def new_cache_rows(resolved: DataFrame, now: Column, key: str = "term_key") -> DataFrame:
    """Rows to upsert into the cache: found outside of it, one per distinct term."""
    return resolved.filter(~F.col("cached") & F.col("nutrition").isNotNull()).select(
        key, "nutrition", "source", now.alias("created_at"), now.alias("updated_at")
    )


# --- totals ------------------------------------------------------------------------


def contribution(value: Column, weight: Column, serving: Column) -> Column:
    """Nutrient amount of a weight, given the amount per serving (100 g when unknown)."""
    base = F.when(serving.isNull() | (serving == 0), fixed.DEFAULT_SERVING_G).otherwise(serving)
    return F.coalesce(value, F.lit(0.0)) * (weight / base)


def item_stats(df: DataFrame, weight: str = "weight_grams", food: str = "nutrition") -> DataFrame:
    """Add the contribution of every line to every nutrient; null where no food was found."""
    n = F.col(food)
    return df.select(
        "*",
        *[
            F.when(n.isNotNull(), contribution(n[x], F.col(weight), n["serving_size_g"])).alias(x)
            for x in fixed.NUTRIENTS
        ],
    )


def rounded_total(total: Column, nutrient: str) -> Column:
    """A sum, rounded as totals are shown. The order of a distributed sum is not fixed, so noise
    beyond the ninth decimal is removed before halves are decided; fibre and sugar stay exact."""
    settled = F.round(F.coalesce(total, F.lit(0.0)), 9)
    if nutrient in fixed.WHOLE_NUMBER_NUTRIENTS:
        return text.half_up(settled)
    if nutrient in fixed.ONE_DECIMAL_NUTRIENTS:
        return text.one_decimal(settled)
    return settled


def totals(stats: DataFrame, key: str) -> DataFrame:
    """Totals per recipe, summed on the map side first; zeros for a recipe without lines."""
    return stats.groupBy(key).agg(
        *[rounded_total(F.sum(F.col(n)), n).alias(n) for n in fixed.NUTRIENTS]
    )


def breakdown(stats: DataFrame, key: str) -> DataFrame:
    """One row per line: what was read, what it weighs, what it adds; `not_found` lines kept."""
    found = F.col("nutrition").isNotNull()
    return stats.filter(F.col("line").isNotNull()).select(
        key, "pos", F.col("line").alias("ingredient"),
        F.when(found, "found").otherwise("not_found").alias("status"),
        "name", "term", "unit", "qty", "weight_grams", "source", *fixed.NUTRIENTS,
    )


def breakdown_lists(stats: DataFrame, key: str) -> DataFrame:
    """The breakdown as ordered lists per recipe (in parts for recipes of over 1,000 lines); an empty
    list for a recipe without lines."""
    status = F.when(F.col("nutrition").isNotNull(), "found").otherwise("not_found").alias("status")
    entry = F.when(F.col("line").isNotNull(), F.struct(
        F.col("line").alias("ingredient"), status, "source", "weight_grams", "qty", "unit", *fixed.NUTRIENTS
    ))
    rows = stats.withColumn("pos", F.coalesce("pos", F.lit(0)))
    return list_parts(rows, [key], "pos", entry).withColumn("entries", F.filter("entries", lambda e: e.isNotNull()))


def analyse_lines(
    rows: DataFrame,
    cache: DataFrame,
    sources: list[tuple[str, DataFrame]],
    strict_parity: bool = True,
) -> DataFrame:
    """Statistics per ingredient line of rows with a column `line`.

    The tables are merged by priority first, so the lines are read, parsed and joined once; empty
    rows have no key and are spread, hot terms are left to the adaptive split in that join.
    """
    foods = known_foods(cache, sources)
    joined = attach(
        line_terms(rows, keep_empty=True), foods.select("term_key", "nutrition", "source"), ["term_key"]
    )
    weights = weighed(joined, strict_parity=strict_parity)
    if "portions" in foods.schema["nutrition"].dataType.names:
        weights = weights.withColumn("_portion", portion_grams(strict_parity)).withColumn(
            "weight_grams", F.coalesce(F.col("_portion") * F.col("qty"), "weight_grams")
        )
    return item_stats(weights.drop("_portion"))


def line_terms(rows: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Parsed lines with the key of their search term; with `keep_empty` also the empty row of a
    recipe without lines, which has no key."""
    there = F.col("line").isNotNull()
    read = parsed(rows if keep_empty else rows.filter(there))
    return read.withColumn("term_key", F.when(there, text.cache_key("term")))


def portion_grams(strict_parity: bool = True) -> Column:
    """Grams of the first portion of the food that fits the unit of the line, else null."""
    u = unit_key(F.col("unit"), strict_parity)

    def fits(p: Column) -> Column:
        low = F.lower(p["measure"])
        out = F.lit(False)
        for units, hints in fixed.PORTION_CLASSES.values():
            out = out | (u.isin(units) & text.contains_any(low, hints))
        return out

    return F.try_element_at(F.filter(F.col("nutrition.portions"), fits), F.lit(1))["gramWeight"]


def analyse(
    recipes: DataFrame,
    cache: DataFrame,
    sources: list[tuple[str, DataFrame]],
    key: str = "id",
    ingredients: str = "recipe_ingredients",
    strict_parity: bool = True,
) -> DataFrame:
    """As `analyse_lines`, from recipes with a list of lines. `totals` and `breakdown` take the
    statistics."""
    return analyse_lines(lines(recipes, key, ingredients), cache, sources, strict_parity)
