"""Rows that every operator must stand: nulls, empty and long texts, repeated rows, extra columns."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, _h string, k string, `size` int"


def documents(spark):
    plain = "The quick brown fox met twenty other animals near the old river and they all talked about rain for hours until night came down"
    rows = [
        (1, plain, "en", "a"), (1, plain, "en", "a"), (2, None, "en", "b"), (3, "", None, None),
        (None, plain + " again", None, "a"), (None, None, None, None), (4, " \n\t ", "de", "b"),
        (5, " ".join(f"word{i} of a very long text" for i in range(20_000)), "en", "a"),
        (6, "one", "fr", ""), (7, plain, "en", "b"), (8, "ünïcödé 𝒳 " * 30, "de", "b"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), 9, "h", None, 4) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
