"""Columns over JSON of mixed shape (VARIANT)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(v: Column) -> Column:
    """'STRING', 'BIGINT', 'ARRAY', 'OBJECT', ... or null where there is no value."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def text(v: Column, path: str = "$") -> Column:
    """The value at a path as text; objects and lists as JSON text."""
    return F.try_variant_get(v, path, "string")


def items(v: Column, path: str = "$") -> Column:
    """The list at a path, null when there is no list."""
    return F.try_variant_get(v, path, "array<variant>")


def node(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def string_only(v: Column) -> Column:
    """The text of a JSON string; null for any other kind."""
    return F.when(kind(v) == "STRING", text(v))


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def flat_ingredients(json: Column) -> Column:
    """JSON list to text array; anything that is no list gives an empty array."""
    values = items(F.try_parse_json(json))
    return F.coalesce(F.transform(values, lambda x: text(x)), F.array().cast("array<string>"))


def text_list(json: Column) -> Column:
    """JSON list (strings as they are, other items as JSON) or object (its values) to text."""
    v = F.try_parse_json(json)
    values = F.try_variant_get(v, "$", "map<string,variant>")
    return F.coalesce(
        F.transform(items(v), lambda x: text(x)),
        F.transform(F.map_values(values), lambda x: text(x)),
        F.array().cast("array<string>"),
    )


def joined(v: Column, separator: str = ", ") -> Column:
    """A list joined to one text, or the scalar's own text."""
    return F.coalesce(
        F.array_join(F.transform(items(v), lambda x: text(x)), separator), text(v)
    )


def step_text(v: Column) -> Column:
    """Text of one instruction step: itself, else its `text`, else its `name`."""
    return F.coalesce(string_only(v), non_empty(text(v, "$.text")), text(v, "$.name"))


def image_url(v: Column) -> Column:
    """A string, or the `url` or `contentUrl` of an object; of a list, its first item."""

    def one(x: Column) -> Column:
        return F.when(kind(x) == "STRING", text(x)).otherwise(
            F.coalesce(non_empty(text(x, "$.url")), non_empty(text(x, "$.contentUrl")))
        )

    return F.when(kind(v) == "ARRAY", one(node(v, "$[0]"))).otherwise(one(v))


def _is(v: Column, type_name: str) -> Column:
    return F.coalesce(text(v, '$["@type"]') == type_name, F.lit(False))


def instruction_list(v: Column) -> Column:
    """Instruction texts of a bare text, a list of texts, of steps, or of sections of steps;
    null where there is nothing of these shapes."""
    none = F.array().cast("array<string>")

    def step(x: Column) -> Column:
        said = non_empty(text(x, "$.text"))
        return F.when(_is(x, "HowToStep") & said.isNotNull(), F.array(said)).otherwise(none)

    def entry(x: Column) -> Column:
        section = items(x, "$.itemListElement")
        return (
            F.when(kind(x) == "STRING", F.array(text(x)))
            .when(
                _is(x, "HowToSection") & section.isNotNull(),
                F.flatten(F.transform(section, step)),
            )
            .otherwise(step(x))
        )

    return F.when(
        kind(v) == "ARRAY", F.flatten(F.transform(items(v), entry))
    ).when(kind(v) == "STRING", F.array(text(v)))


def bound(value: Column, make) -> Column:
    """`make` of a value that is worked out once, however often `make` uses it."""
    return F.element_at(F.transform(F.array(value), make), 1)


def repaired_image(image: Column, otherwise: Column) -> Column:
    """The URL inside an image field that holds a JSON object; `otherwise` when none is found."""

    def inside(v: Column) -> Column:
        return F.coalesce(
            non_empty(text(v, "$.url")), non_empty(text(v, "$.contentUrl")), otherwise
        )

    return F.when(
        image.rlike(r"^\s*\{"), bound(F.try_parse_json(image), inside)
    ).otherwise(image)
