"""Choosing a food of a food table for every ingredient term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import fixed, text, words
from larder.operators.nutrition import portion_list, portion_measure
from larder.operators.shaping import dealt, first_per, top_per


def _tightest() -> list[Column]:
    """Foods with the fewest further words first, then the shortest description."""
    return [F.size("food_words").asc(), F.length("description").asc(), F.col("fdc_id").asc()]


def matches(terms: DataFrame, foods: DataFrame) -> DataFrame:
    """Every distinct term with every food whose description has all of its words, and those words
    (`food_words`). `terms(term)`; `foods(fdc_id, description, ...)`.

    Each term meets the foods on its rarest word only, so a word found in a third of all foods is
    never joined on by a term that has any rarer one, and the other words are tested on the pair.
    """
    wanted = terms.select("term").filter(F.col("term") != "").distinct()
    tagged = foods.withColumn("food_words", F.array_distinct(words.words("description")))
    index = tagged.select("*", F.explode("food_words").alias("word"))
    frequency = index.groupBy("word").agg(F.count(F.lit(1)).alias("f"))

    each = wanted.select("term", F.explode(F.array_distinct(words.words("term"))).alias("word"))
    # a word no food has makes the term unanswerable: frequency 0 is the rarest of all
    rarest = (
        each.join(frequency, "word", "left")
        .groupBy("term")
        .agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "word")).alias("r"))
        .filter("r.f > 0")
        .select(
            "term", F.col("r.word").alias("word"),
            F.array_distinct(words.words("term")).alias("term_words"),
        )
    )
    pairs = rarest.join(index, "word").filter(
        F.size(F.array_except("term_words", "food_words")) == 0
    )
    return pairs.drop("word", "term_words")


def candidates(
    terms: DataFrame, foods: DataFrame, per_term: int = fixed.CANDIDATES_PER_TERM
) -> DataFrame:
    """The first `per_term` matching foods of every term as a list of search results would show them;
    those with the fewest further words come first (`api_rank`). `best_foods` looks at all of them."""
    return top_per(matches(terms, foods), ["term"], _tightest(), per_term, "api_rank").drop("food_words")


def is_low_calorie(term: Column) -> Column:
    return term.rlike(f"(?i){fixed.LOW_CALORIE_QUERY}")


def is_processed(c: Column) -> Column:
    return c.rlike(f"(?i){fixed.PROCESSED_FOOD}")


def candidate_score(term: Column, description: Column, data_type: Column, energy: Column) -> Column:
    """How well a food answers a term: match quality, kind of source, brevity, energy known."""
    d, q = F.lower(description), F.trim(F.lower(term))
    match = (
        F.when(d == q, 500)
        .when(d.startswith(F.concat(q, F.lit(","))) | d.startswith(F.concat(q, F.lit(" "))), 300)
        .when(d.contains(q), 10)
        .otherwise(-1000)
    )
    source = None
    for name, points in fixed.DATA_TYPE_SCORES.items():
        hit = data_type == name
        source = F.when(hit, points) if source is None else source.when(hit, points)
    no_energy = (F.coalesce(energy, F.lit(0)) == 0) & ~is_low_calorie(q)
    return match + source.otherwise(0) - F.length(d) - F.when(no_energy, 200).otherwise(0)


def pick(found: DataFrame, ties: list[Column] | None = None) -> DataFrame:
    """The best candidate of every term, by `ties` (`api_rank`) among equals.

    Unbranded foods before branded, unprocessed before processed unless the term asks for it, then
    the best score; among those a food with energy before one without unless the term is a
    low-calorie one. Preferring a kind only where the group has one is the same as ordering by
    that kind first, so all of it is one ranking and each group is trimmed before its shuffle.
    """
    term = F.lower(F.col("term"))
    branded = F.coalesce(F.col("data_type") == "Branded", F.lit(False))
    unwanted = ~is_processed(term) & is_processed(F.col("description"))
    energetic = is_low_calorie(term) | (F.coalesce(F.col("energy"), F.lit(0)) > 0)
    scored = found.withColumn(
        "score",
        candidate_score(
            F.col("term"), F.col("description"), F.col("data_type"), F.col("energy")
        ),
    )
    order = [
        branded.asc(), unwanted.asc(), energetic.desc(), F.desc("score"), *(ties or [F.asc("api_rank")])
    ]
    return first_per(scored, ["term"], order)


def best_foods(terms: DataFrame, foods: DataFrame, per_task: int = 100_000) -> DataFrame:
    """The best food of every term among all that match it; none is left out before it is scored.
    The ranking is cut to one food per term in every task before the shuffle; a task ranks what
    `per_task` foods match."""
    return pick(matches(terms, dealt(foods, per_task)), _tightest()).drop("food_words")


def nutrient_record(amounts: DataFrame, key: str = "fdc_id") -> DataFrame:
    """Long `(key, seq, nutrient_id, amount)` to one row with the ten nutrients; of repeated ids
    the first by `seq`, missing ones 0."""
    return (
        amounts.filter(F.col("nutrient_id").isin(list(fixed.NUTRIENT_IDS.values())))
        .groupBy(key)
        .agg(
            *[
                F.coalesce(
                    F.min_by(
                        F.col("amount"), F.when(F.col("nutrient_id") == number, F.col("seq"))
                    ),
                    F.lit(0.0),
                ).alias(name)
                for name, number in fixed.NUTRIENT_IDS.items()
            ]
        )
    )


def food_records(amounts: DataFrame, portions: DataFrame, width: int = 1000) -> DataFrame:
    """`(fdc_id, part, nutrition)` with the ten nutrients, a serving of 100 g, and all portions of the
    food in order, each with its own measure.

    A record holds the portions of `width` places; a food of ordinary size is the one row with part 0,
    one without portions has an empty list there.
    """
    wide = nutrient_record(amounts)
    lists = portion_list(portions, width).withColumnRenamed("entries", "portions")
    return _record(wide.join(lists, "fdc_id", "left").withColumn("part", F.coalesce("part", F.lit(0).cast("bigint"))), "part")


def line_records(amounts: DataFrame, portions: DataFrame) -> DataFrame:
    """`(fdc_id, nutrition)`, one row per food, with the portions that a line can take: the first by
    `seq` that fits each class of unit. They keep their order and measure, so that a line takes
    the same one as from the whole list."""
    low = F.lower("measure")
    entry = F.struct("seq", "measure", F.col("gram_weight").alias("gramWeight"))
    fits = [F.when(text.contains_any(low, hints), F.col("seq")) for _, hints in fixed.PORTION_CLASSES.values()]
    firsts = portions.withColumn("measure", portion_measure()).groupBy("fdc_id").agg(
        F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.min_by(entry, seq) for seq in fits])))).alias("portions")
    ).withColumn("portions", F.transform("portions", lambda p: p.dropFields("seq")))
    return _record(nutrient_record(amounts).join(firsts, "fdc_id", "left"))


def _record(rows: DataFrame, *kept: str) -> DataFrame:
    return rows.select(
        "fdc_id", *kept,
        F.struct(
            *fixed.NUTRIENTS,
            F.lit(fixed.DEFAULT_SERVING_G).alias("serving_size_g"),
            F.coalesce("portions", F.array()).alias("portions"),
        ).alias("nutrition"),
    )


def term_nutrition(terms: DataFrame, foods: DataFrame, amounts: DataFrame, portions: DataFrame) -> DataFrame:
    """`(term, fdc_id, nutrition)` of the best food per term. `foods` carries `energy`."""
    best = best_foods(terms, foods).select("term", "fdc_id")
    return best.join(line_records(amounts, portions), "fdc_id")
