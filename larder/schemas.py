"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

from larder.functions import fixed

NUTRITION = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in fixed.NUTRIENTS]
    + [
        T.StructField("serving_size_g", T.DoubleType()),
        T.StructField(
            "portions",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("measure", T.StringType()),
                        T.StructField("gramWeight", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)


_KINDS = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _fields(columns: str) -> list[T.StructField]:
    """`name kind, name kind not null, ...` to fields, without needing a session."""
    out = []
    for column in columns.split(", "):
        name, kind, *required = column.split(" ")
        out.append(T.StructField(name, _KINDS[kind], not required))
    return out


RECIPES = T.StructType(
    _fields(
        "id string not null, url string, name string not null, image string, description string, "
        "cook_time string, prep_time string, total_time string, recipe_yield string, "
        "recipe_ingredients array<string>, recipe_instructions array<string>, "
        "recipe_category string, recipe_cuisine string"
    )
    + [T.StructField("nutrition", NUTRITION)]
    + _fields(
        "created_at timestamp not null, updated_at timestamp not null, qa_status string not null, "
        "last_audited_at timestamp, audit_log array<string>, quality_score int"
    )
)

CRAWL_JOBS = T.StructType(
    _fields(
        "id string, url string, status string, recipes_found int, log string, "
        "created_at timestamp, updated_at timestamp, is_archived boolean, "
        "next_retry_at timestamp, retry_count int"
    )
)

INGREDIENT_CACHE = T.StructType(
    _fields("term string")
    + [T.StructField("nutrition", NUTRITION)]
    + _fields("source string, remote_id string, created_at timestamp, updated_at timestamp")
)

API_KEYS = T.StructType(
    _fields(
        "id string, key_hash string, owner_name string, owner_email string, is_active boolean, "
        "last_used_at timestamp, created_at timestamp, expires_at timestamp"
    )
)

PAGES = T.StructType(_fields("url string, status int, html string"))
