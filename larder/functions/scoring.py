"""Quality score, 0 to 100."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import truthy


def weighted(terms: list[tuple[Column, int]]) -> Column:
    """Sum of the weights whose condition holds; an unknown condition adds nothing."""
    total = F.lit(0)
    for condition, weight in terms:
        total = total + F.when(condition, weight).otherwise(0)
    return total.cast("int")


NUTRITION_POINTS = 5


def quality_score(
    name: Column,
    description: Column,
    image: Column,
    ingredients: Column,
    instructions: Column,
    cook_time: Column,
    prep_time: Column,
    has_nutrition: Column,
) -> Column:
    return weighted(
        [
            (F.length(name) > 3, 10),
            (F.length(description) > 10, 10),
            (F.length(image) > 10, 20),
            (F.size(ingredients) > 0, 25),
            (F.size(instructions) > 0, 25),
            (truthy(cook_time) | truthy(prep_time), 5),
            (has_nutrition, NUTRITION_POINTS),
        ]
    )


def recipe_score(has_nutrition: Column | None = None) -> Column:
    """The score over the standard recipe columns."""
    return quality_score(
        *[
            F.col(c)
            for c in (
                "name", "description", "image", "recipe_ingredients", "recipe_instructions",
                "cook_time", "prep_time",
            )
        ],
        F.col("nutrition").isNotNull() if has_nutrition is None else has_nutrition,
    )
