"""Preference pairs against a plain version."""

from larder.llm import preferences
from tests.compare import compare, database

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int, n int"


def draw(turns):
    text, loss = "", []
    for role, body in turns:
        head = f"<|im_start|>{role}\n"
        if role == "assistant":
            loss.append((len(text) + len(head), len(text) + len(head) + len(body) + len("<|im_end|>")))
        text += f"{head}{body}<|im_end|>\n"
    return text, loss


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def test_prefix(spark):
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "a"), (2, 0, "user", "x"), (3, 0, "user", "same"), (None, 0, "user", "lost")]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "other"), (1, 3, "assistant", "a"), (3, 0, "user", "same"), (4, 0, None, None), (4, None, "system", "<|im_end|>")]
    got = {r.conv_id: r for r in preferences.format_pairs(frame(spark, chosen + chosen[:2]), frame(spark, rejected), "conv_id").collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].prompt_turns == 2 and got[1].prompt == draw([("user", "hi"), ("assistant", "yes")])[0]
    for side, word in (("chosen", "more"), ("rejected", "other")):
        text, loss = draw([("user", word), ("assistant", "a")])
        assert got[1][side] == text and [tuple(s) for s in got[1][side + "_loss"]] == loss
    assert (got[2].prompt_turns, got[2].rejected) == (0, "")
    assert (got[3].prompt_turns, got[3].chosen, got[3].rejected) == (1, "", "")


def test_null_turn_first_and_marks(spark):
    got = preferences.format_pairs(frame(spark, []), frame(spark, [(4, 0, None, None), (4, None, "system", "<|im_end|>")]), "conv_id")
    text = "".join(r.rejected for r in sorted(got.collect(), key=lambda r: r.part))
    assert text == "<|im_start|>system\n<| im_end|><|im_end|>\n<|im_start|>unknown\n<|im_end|>\n"


def test_long_conversation_in_parts(spark):
    rows = [(9, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(1000)]
    other = rows[:600] + [(9, i, r, t + "!") for _, i, r, t in rows[600:]]
    got = sorted(preferences.format_pairs(frame(spark, rows), frame(spark, other), "conv_id").collect(), key=lambda r: r.part)
    assert len(got) == 4 and sum(r.prompt_turns for r in got) == 600
    assert "".join(r.prompt for r in got) == draw([r[2:] for r in rows[:600]])[0]
    assert "".join(r.rejected for r in got) == draw([r[2:] for r in other[600:]])[0]


def neighbours(ids):
    ids = sorted(ids)
    return dict(zip(ids, ids[1:] + ids[:1], strict=True))


def test_next_conversation_over_the_whole_table(spark):
    """Sparse ids of every sign over several ranges: the true next id, the first after the last."""
    ids = [n * n * 1000 * (-1) ** n for n in range(300)]
    cuts = spark.createDataFrame([(i, i % 7) for i in ids], "conv_id bigint, cut bigint").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = preferences.following(cuts).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {r.conv_id: r.other for r in got} == neighbours(ids) and len(got) == 300
    assert all(r.cut == r.conv_id % 7 and r.other_cut == r.other % 7 for r in got)


def test_rejected_side_of_sparse_ids(spark):
    rows = [(i, t, "user" if t == 0 else "assistant", f"{i}-{t}") for i in (0, 1000, 2000) for t in (0, 1)]
    talks = frame(spark, rows)
    got = {r.conv_id: r for r in preferences.format_pairs(talks, preferences.rejected_by_neighbour(talks), "conv_id").collect()}
    for i, other in ((0, 1000), (1000, 2000), (2000, 0)):
        assert got[i].prompt == draw([("user", f"{i}-0")])[0]
        assert got[i].chosen == draw([("assistant", f"{i}-1")])[0]
        assert got[i].rejected == draw([("assistant", f"{other}-1")])[0]


def test_turns_of_null_and_equal_number_come_in_bounded_parts(spark):
    chosen = [(1, None, "user", f"n{i:04d}") for i in range(1000)] + [(1, 5, "user", f"e{i:04d}") for i in range(700)] + [(1, 900, "assistant", "end")]
    rejected = chosen[:-1] + [(1, 900, "assistant", "other")]
    found = preferences.format_pairs(frame(spark, chosen), frame(spark, rejected), "conv_id")
    got = sorted(found.collect(), key=lambda r: r.part)
    assert [r.part for r in got] == list(range(7)) and max(r.prompt_turns for r in got) == preferences.PART
    assert "".join(r.prompt for r in got) == draw([r[2:] for r in chosen[:-1]])[0]
    assert "".join(r.rejected for r in got) == draw([("assistant", "other")])[0]


def test_empty(spark):
    none = frame(spark, [])
    assert preferences.format_pairs(none, none, "conv_id").count() == 0
    assert preferences.rejected_by_neighbour(none).count() == 0


def test_query_against_sql(spark):
    from larder.llm import queries

    folder = "/root/testdata/sf0.01"
    df = queries.op4_preference_pairs(spark, folder)
    assert compare(df, database(folder), queries.OP4_SQL) == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan
