"""Operators on small fixtures, with invariants and brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.functions import fixed, porter, words
from larder.operators import catalog, foods, intervals, jobs, keys, nutrition, publish
from larder.operators import search as s
from larder.operators import shaping, tables


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# --- shaping ------------------------------------------------------------------------


def test_attach_keeps_every_row(spark):
    facts = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "z")], "id int, k string")
    dim = spark.createDataFrame([("a", 10)], "k string, v int")
    assert rows(shaping.attach(facts, dim, ["k"]), "id", "v") == [
        (1, 10), (2, None), (3, None), (4, None)
    ]


def test_prefer_falls_back_per_group(spark):
    df = spark.createDataFrame(
        [("a", 1, True), ("a", 2, False), ("b", 3, False), ("b", 4, None)], "g string, n int, ok boolean"
    )
    assert rows(shaping.prefer(df, ["g"], F.col("ok")), "n") == [(1,), (3,), (4,)]


def test_list_parts_are_ordered_and_bounded(spark):
    df = spark.range(25).select(F.lit("k").alias("k"), "id")
    parts = shaping.list_parts(df, ["k"], "id", F.col("id") * 2, width=10).orderBy("part").collect()
    assert [len(p["entries"]) for p in parts] == [10, 10, 5]
    assert list(itertools.chain(*[p["entries"] for p in parts])) == [2 * i for i in range(25)]


# --- catalogue ----------------------------------------------------------------------


def test_one_row(spark):
    df = spark.range(3)
    assert catalog.one_row(df, F.col("id") == 1).count() == 1
    with pytest.raises(LookupError):
        catalog.one_row(df, F.col("id") == 9)
    with pytest.raises(LookupError):
        catalog.one_row(df, F.col("id") > 0)


def test_health_of_an_empty_table(spark):
    df = spark.createDataFrame([], "st string, sc int")
    out = catalog.health(df, F.col("st"), F.col("sc"), {"verified": "verified"}).first()
    assert (out["total"], out["verified"], out["avg_score"]) == (0, 0, 0.0)


# --- search -------------------------------------------------------------------------

WORDS = ["bake", "baked", "baking", "bakes", "baker", "fish", "fishing", "fished", "the", "oven", "hot"]


def _texts(n=80, seed=3):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(1, 12)))) for i in range(n)]


def test_stemmed_search_equals_brute_force(spark):
    texts = _texts()
    df = spark.createDataFrame(texts, "id int, t string")
    query = s.TextQuery(all_of=("baking", "fish"), none_of=("ovens",))
    got = {r["id"] for r in s.text_search(df, F.col("t"), query, key="id", stem=True).collect()}
    want = set()
    for i, t in texts:
        stems = {porter.stem(w) for w in t.split() if w not in fixed.STOP_WORDS}
        if {"bake", "fish"} <= stems and "oven" not in stems:
            want.add(i)
    assert got == want and want


def test_phrase_and_any(spark):
    df = spark.createDataFrame(
        [(1, "hot fish oven"), (2, "fish hot oven"), (3, "oven fish"), (4, "x")], "id int, t string"
    )
    phrase = s.TextQuery(phrases=(("hot", "fish"),))
    assert [r["id"] for r in s.text_search(df, F.col("t"), phrase, key="id").collect()] == [1]
    some = s.TextQuery(any_of=("hot", "oven"))
    assert {r["id"] for r in s.text_search(df, F.col("t"), some, key="id").collect()} == {1, 2, 3}
    gap = s.TextQuery(phrases=(("The", "FISH", "of", "oven"),))
    assert [r["id"] for r in s.text_search(df, F.col("t"), gap, key="id").collect()] == [2]
    longer = s.TextQuery(phrases=(("fish", "hot", "oven"),))
    assert [r["id"] for r in s.text_search(df, F.col("t"), longer, key="id").collect()] == [2]


def _similarity(a, b):
    x, y = set(words.trigram_set(a)), set(words.trigram_set(b))
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.mark.parametrize("threshold", [0.2, 0.3, 0.5, 0.8, 1.0])
def test_fuzzy_join_equals_brute_force(spark, threshold):
    rnd = random.Random(11)
    syllables = ["ba", "ke", "fi", "sh", "ov", "en", "ho", "t", " "]
    make = lambda: "".join(rnd.choices(syllables, k=rnd.randint(1, 7))).strip()
    left, right = [make() for _ in range(60)] + [None, "x"], [make() for _ in range(60)] + ["x"]
    got = s.fuzzy_join(
        spark.createDataFrame([(x,) for x in left], "left_text string"),
        spark.createDataFrame([(x,) for x in right], "right_text string"),
        threshold,
    )
    want = {
        (a, b) for a in set(left) - {None} for b in set(right) if _similarity(a, b) >= threshold
        and words.trigram_set(a)
    }
    found = got.collect()
    assert {(r["left_text"], r["right_text"]) for r in found} == want
    assert len(found) == len(want)


@pytest.mark.parametrize("threshold", [0.2, 0.6])
@pytest.mark.parametrize(("hot", "short", "block"), [(0, 6, 3), (5, 12, 4), (0, 100, 2)])
def test_fuzzy_keys_lose_and_repeat_no_pair(spark, threshold, hot, short, block):
    """Hot pieces, hot twos, long left texts, single shared pieces and blocks, each forced by small parameters."""
    rnd = random.Random(11)
    syllables = ["ba", "ke", "fi", "sh", "ov", "en", "ho", "t", " "]
    make = lambda: "".join(rnd.choices(syllables, k=rnd.randint(1, 9))).strip()
    left, right = [make() for _ in range(70)] + [None, "x", "", "b a"], [make() for _ in range(70)] + ["x", "", "a"]
    tuned = {"hot": hot, "short": short, "block": block}
    found = s.fuzzy_join(
        spark.createDataFrame([(x,) for x in left], "left_text string"),
        spark.createDataFrame([(x,) for x in right], "right_text string"), threshold, **tuned,
    ).collect()
    assert sorted((r["left_text"], r["right_text"]) for r in found) == sorted(
        (a, b) for a in set(left) - {None} for b in set(right) if _similarity(a, b) >= threshold
    )
    every = sorted({x for x in left + right if x is not None})
    twos = s.fuzzy_pairs(spark.createDataFrame([(x,) for x in left + right], "text string"), threshold, **tuned)
    assert sorted((r["left_text"], r["right_text"]) for r in twos.collect()) == [
        (a, b) for a, b in itertools.combinations(every, 2) if _similarity(a, b) >= threshold
    ]


def test_a_piece_of_many_texts_is_no_key_of_its_own(spark):
    rnd = random.Random(2)
    letters = "bcdfghjklmnpqrstvwxz"
    texts = sorted({f"pancake {''.join(rnd.choices(letters, k=3))}" for _ in range(300)} | {
        "".join(rnd.choices(letters, k=14)) for _ in range(600)
    })
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    sets = s._ordered_pieces(df, s._frequency(df)).cache()
    one, two = (s._join_keys(sets, 0.5, 100, 32, first) for first in (True, False))
    blocked = s._block_hot(one, two, 50)[0]
    assert {r[0][0] for r in one.select("key").distinct().collect()} == {"0", "1"}
    assert blocked.groupBy("key", "cell").count().agg(F.max("count")).first()[0] <= 100
    assert blocked.select("t", "key").distinct().count() == one.count()
    assert s.fuzzy_pairs(df.toDF("text"), 0.5, hot=100, block=50).count() == s.fuzzy_pairs(df.toDF("text"), 0.5).count()


def test_signatures_rule_pairs_out_before_their_sets_are_compared(spark):
    """A signature never differs in more bits than the sets have pieces of one side only, and the pairs that a hot
    word brings together are told apart by it; cells of a key deal out what a task pairs."""
    rnd = random.Random(5)
    letters = "bcdfghjklmnpqrstvwxz"
    texts = sorted({f"pancake {''.join(rnd.choices(letters, k=rnd.randint(3, 30)))}" for _ in range(300)} | {"é", "ünï 9"})
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    rows = s._ordered_pieces(df, s._frequency(df)).collect()
    assert {r.t: len(set(r.g)) for r in rows} == {t: len(set(words.trigram_set(t))) for t in texts}
    told = 0
    for a, b in itertools.combinations(rows, 2):
        bits = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a.bits, b.bits, strict=True))
        apart = len(set(a.g) ^ set(b.g))
        assert bits <= apart
        shared = len(set(a.g) & set(b.g))
        told += bits > (len(a.g) + len(b.g)) * 0.3 / 1.7 or shared >= 0.7 * (len(a.g) + len(b.g) - shared)
    assert told > 0.95 * len(rows) * (len(rows) - 1) / 2
    found = s.fuzzy_pairs(df.toDF("text"), 0.3, hot=10, block=20)
    assert found.count() == sum(_similarity(a, b) >= 0.3 for a, b in itertools.combinations(texts, 2))


def test_texts_that_differ_in_rare_pieces_are_compared_by_classes(spark, monkeypatch):
    """Addresses of a few forms and many numbers: the keys of what their frequent pieces decide grow with the
    forms, a form of several chunks pairs all its texts, and numbers that bring others near are found too."""
    monkeypatch.setattr(s, "_CHUNK", 16)
    rnd = random.Random(3)
    forms = ["https://www.kitchen.example.org/en/recipes/{}?utm_source=feed", "https://m.kitchen.example.org/de/recipes/{}.html"]
    texts = sorted({rnd.choice(forms).format(rnd.randint(10**6, 10**7)) for _ in range(160)} | {
        f"https://m.kitchen.example.com/{w}/recipes/{i}" for w in ("en", "de") for i in range(5000, 5020)
    })
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    sets = s._ordered_pieces(df, s._frequency(df)).withColumn("r", F.expr("size(filter(f, x -> x <= 30))")).cache()
    classes, chunks = s._classes(sets, 30)
    assert classes.count() < len(texts) / 8
    assert chunks.count() > classes.count()
    members = chunks.select("c", F.explode("members.t").alias("t")).collect()
    assert sorted(r.t for r in members) == texts
    sizes = dict(sets.select("t", F.expr("slice(g, r + 1, size(g))")).collect())
    assert len({(r.c, tuple(sizes[r.t])) for r in members}) == classes.count()
    kept = s._join_keys(classes, 0.7, 30, 74, True, True).groupBy("key").count().agg(F.max("count")).first()[0]
    assert kept < len(texts) / 8
    found = s.fuzzy_pairs(df.toDF("text"), 0.7, hot=30).collect()
    want = {(a, b): v for a, b in itertools.combinations(texts, 2) if (v := _similarity(a, b)) >= 0.7}
    assert len(found) == len(want) > 4_000
    assert all(abs(want[r.left_text, r.right_text] - r.similarity) < 1e-12 for r in found)


@pytest.mark.parametrize("term", ["baking fish", "bak", "hot", "o"])
def test_fuzzy_search_equals_brute_force(spark, term):
    texts = _texts(60, seed=5)
    df = spark.createDataFrame(texts, "id int, t string")
    got = {r["id"] for r in s.fuzzy_search(df, F.col("t"), term, key="id", limit=None).collect()}
    assert got == {i for i, t in texts if _similarity(t, term) >= 0.3}


def _catalogue(spark):
    data = [
        ("1", "Fish pie", "A pie of fish", ["200g fish", "salt"], "verified"),
        ("2", "Fish pies", "Many pies", ["fish"], "pending"),
        ("3", "Cake", "No fish here, sweet pie", ["flour", "sugar"], "verified"),
        ("4", "Fish pie", "hidden", ["fish"], "rejected"),
        ("5", "Bread", "Plain", None, "flagged"),
    ]
    df = spark.createDataFrame(
        data, "id string, name string, description string, recipe_ingredients array<string>, qa_status string"
    )
    return df.select(
        "*", F.col("recipe_ingredients").alias("ingredients_flat"), F.lit("i").alias("image"),
        F.lit("PT1M").alias("cook_time"), F.lit("").alias("prep_time"),
        F.col("id").cast("int").alias("created_at"),
    )


def test_search_entry_point(spark):
    df = _catalogue(spark)
    found = s.search(df, "fish pie", full=True).collect()
    assert [r["id"] for r in found] == ["1", "2", "3"]
    assert found[0]["rank_score"] > found[1]["rank_score"] > found[2]["rank_score"]
    assert {r["id"] for r in s.search(df, "fish pie", "fish, salt").collect()} == {"1", "2"}
    assert {r["id"] for r in s.search(df, "fish pie", "fish, salt", match_all=True).collect()} == set()
    assert {r["id"] for r in s.search(df, "", "fish, flour").collect()} == {"2", "3"}
    assert {r["id"] for r in s.search(df, "", "flour, sugar", match_all=True).collect()} == {"3"}
    assert {r["id"] for r in s.search(df, "", "FISH", match="token").collect()} == {"1", "2"}
    assert s.search(df).columns == fixed.LIGHT_FIELDS
    assert s.search(df).count() == 4
    assert [r["id"] for r in s.search(df, "", "fish, salt, flour", full=True).collect()] == ["3", "2", "1"]


def test_search_for_stop_words_only(spark):
    df = _catalogue(spark)
    assert s.search(df, "the of").count() == 0


# --- tables -------------------------------------------------------------------------


def _orders(spark, data):
    return spark.createDataFrame(data, "k string, a int, b string, made int")


def test_upsert_rules(spark):
    old = _orders(spark, [("x", 1, "o", 1), ("y", 2, "o", 1), (None, 9, "loose", 1)])
    new = _orders(spark, [("x", None, None, 2), ("z", 5, None, 2), (None, 7, "new", 2), ("z", 6, "n", 1)])
    got = tables.upsert(
        old, new, "k", order=[F.desc("made")], overwrite=["b"], keep=["made"],
        defaults={"b": F.lit("d")},
    )
    assert sorted(map(str, got.collect())) == sorted(
        map(str, _orders(spark, [
            ("x", 1, None, 1), ("y", 2, "o", 1), ("z", 5, "d", 2), (None, 9, "loose", 1),
            (None, 7, "new", 2),
        ]).collect())
    )


def test_upsert_is_idempotent(spark):
    old = _orders(spark, [("x", 1, "o", 1), ("y", 2, "o", 1)])
    new = _orders(spark, [("x", 3, None, 2), ("z", 5, "n", 2)])
    once = tables.upsert(old, new, "k", keep=["made"])
    twice = tables.upsert(once, new, "k", keep=["made"])
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_fold_equals_repeated_upserts(spark):
    rnd = random.Random(2)
    steps = [
        [(rnd.choice("abc"), rnd.choice([None, i]), rnd.choice([None, f"b{i}"]), i)]
        for i in range(12)
    ]
    state = _orders(spark, steps[0])
    for step in steps[1:]:
        state = spark.createDataFrame(
            tables.upsert(state, _orders(spark, step), "k", overwrite=["b"], keep=["made"]).collect(),
            state.schema,
        )
    every = spark.createDataFrame(
        [(*r, i) for i, step in enumerate(steps) for r in step], "k string, a int, b string, made int, at int"
    )
    folded = tables.fold_changes(every, "k", F.col("at"), overwrite=["b"], keep=["made"])
    assert rows(folded, "k", "a", "b", "made") == rows(state, "k", "a", "b", "made")


def test_update_by_key_sets_nulls_and_ignores_unknown(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    changes = spark.createDataFrame([(1, None, 1), (9, "z", 1), (2, "x", 1), (2, "y", 2)], "id int, v string, at int")
    got = tables.update_by_key(df, changes, "id", ["v"], [F.desc("at")])
    assert rows(got, "id", "v") == [(1, None), (2, "y")]


def test_keep_latest_tells_null_from_empty(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("", 3), ("a", 4), ("a", 5)], "k string, n int")
    assert rows(tables.keep_latest(df, ["k"], [F.desc("n")]), "n") == [(2,), (3,), (5,)]


# --- nutrition ----------------------------------------------------------------------


@pytest.mark.parametrize(
    "line, qty, unit, name, grams",
    [
        ("1 1/2 cups all-purpose flour", 1.5, "cups", "all-purpose flour", 1.5 * 236.59 * 0.55),
        ("3 tbsp butter melted", 3.0, "tbsp", "butter melted", 3 * 14.79 * 0.96),
        ("1 T oil", 1.0, "T", "oil", 4.93 * 0.92),
        ("2 tbs sugar", 2.0, "tbs", "sugar", 2 * 100.0),
        ("1 tsp brown sugar", 1.0, "tsp", "brown sugar", 4.93 * 0.85),
        ("2 chicken breasts", 2.0, "chicken", "breasts", 200.0),
        ("200g pasta", 200.0, "g", "pasta", 200.0),
        ("4 large eggs", 4.0, "large", "eggs", 200.0),
        ("2 slices wheat bread", 2.0, "slices", "wheat bread", 60.0),
        ("1 pinch salt", 1.0, "pinch", "salt", 0.3),
        ("salt to taste", 1.0, "", "salt to taste", 100.0),
        ("1 pineapple", 1.0, "", "pineapple", 180.0),
    ],
)
def test_line_to_grams(spark, line, qty, unit, name, grams):
    df = nutrition.parsed(spark.createDataFrame([(line,)], "line string"))
    r = nutrition.weighed(df, weight="g").first()
    got = (r["qty"], r["unit"], r["name"])
    if line == "1 pineapple":  # no unit: the pattern needs text after it
        assert (r["qty"], r["name"], r["g"]) == (1.0, "pineapple", 180.0)
        return
    assert got == (qty, unit, name)
    assert r["g"] == pytest.approx(grams)


def test_relaxed_units(spark):
    df = spark.createDataFrame([("tbs",), ("T",), ("pinches",)], "u string")
    df = df.select("u", F.lit(1.0).alias("qty"), F.lit("brown sugar").alias("name"))
    got = [r["g"] for r in nutrition.weighed(df, "u", weight="g", strict_parity=False).collect()]
    assert got == pytest.approx([14.79 * 0.93, 14.79 * 0.93, 0.3])


def _foods(spark):
    return spark.createDataFrame(
        [
            (1, "Butter, salted", "SR Legacy", 700.0),
            (2, "Butter", "Branded", 700.0),
            (3, "Butter chips, baked", "SR Legacy", 500.0),
            (4, "Peanut butter", "Foundation", 600.0),
            (5, "Apple, dried", "SR Legacy", 300.0),
            (6, "Water, tap", "SR Legacy", 0.0),
            (7, "Egg whole", "Survey (FNDDS)", 0.0),
            (8, "Egg whole raw", "Survey (FNDDS)", 140.0),
        ],
        "fdc_id long, description string, data_type string, energy double",
    )


def test_food_choice(spark):
    terms = spark.createDataFrame(
        [("butter",), ("apple",), ("water",), ("egg whole",), ("nothing",), ("baked butter",), ("",)],
        "term string",
    )
    best = dict(rows(foods.pick(foods.candidates(terms, _foods(spark))), "term", "fdc_id"))
    assert best == {
        "butter": 1,  # unbranded before the exact branded name, unprocessed before chips
        "apple": 5,  # only a processed one exists
        "water": 6,  # low in calories, so no energy is fine
        "egg whole": 8,  # the exact name has no energy
        "baked butter": 3,
    }


def test_candidates_are_the_tightest(spark):
    many = spark.range(30).select(
        F.col("id").alias("fdc_id"), F.concat(F.lit("oil "), F.repeat(F.lit("x "), F.col("id").cast("int")))
        .alias("description")
    )
    terms = spark.createDataFrame([("oil",)], "term string")
    got = rows(foods.candidates(terms, many), "api_rank", "fdc_id")
    assert [r[0] for r in got] == [1, 2, 3, 4, 5]
    assert got[0] == (1, 0)


def test_no_food_is_left_out_before_it_is_scored(spark):
    many = [(i, "Milk", "Branded", 60.0) for i in range(6)] + [(9, "Milk, whole, with added vitamin D", "SR Legacy", 61.0)]
    df = spark.createDataFrame(many + _foods(spark).collect(), _foods(spark).schema)
    terms = spark.createDataFrame([("milk",), ("milk",), ("butter",), ("none",), (None,)], "term string")
    best = foods.best_foods(terms, df)
    assert dict(rows(best, "term", "fdc_id")) == {"milk": 9, "butter": 1}
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_food_records_keep_every_portion(spark):
    amounts = spark.createDataFrame([(1, 1, 1008, 717.0), (2, 1, 1008, 5.0)], "fdc_id long, seq int, nutrient_id int, amount double")
    given = [(1, 4, "cup", "", 227.0), (1, 1, None, "pat", 5.0), (1, 2, None, "slice or cup", 30.0), (1, 9, "Cup", None, 99.0), (1, 12, "", None, 1.0)]
    portions = spark.createDataFrame(given, "fdc_id long, seq int, unit_name string, modifier string, gram_weight double")
    got = {(r.fdc_id, r.part): [tuple(p) for p in r.nutrition.portions] for r in foods.food_records(amounts, portions).collect()}
    assert got == {(1, 0): [("pat", 5.0), ("slice or cup", 30.0), ("cup", 227.0), ("Cup", 99.0), ("unit", 1.0)], (2, 0): []}
    parts = {r.part: len(r.nutrition.portions) for r in foods.food_records(amounts, portions, width=5).collect() if r.fdc_id == 1}
    assert parts == {0: 3, 1: 1, 2: 1}
    # what a line takes from the short list is what it takes from the whole one
    whole = foods.food_records(amounts, portions).drop("part")
    units = spark.createDataFrame([(u,) for u in ("cups", "slice", "pat", "oz", "tbsp", "whole", None)], "unit string")
    for records in (whole, foods.line_records(amounts, portions)):
        one = records.filter("fdc_id = 1").select("nutrition")
        taken = units.join(one).select("unit", nutrition.portion_grams().alias("g")).collect()
        assert {r.unit: r.g for r in taken if r.unit in ("cups", "slice", "oz")} == {"cups": 30.0, "slice": 30.0, "oz": None}
    short = foods.line_records(amounts, portions).filter("fdc_id = 1").first().nutrition.portions
    assert [tuple(p) for p in short] == [("slice or cup", 30.0)]


def test_full_nutrition_run(spark):
    recipes = spark.createDataFrame(
        [("r1", ["2 cups butter", "1 large egg", "unknown stuff"]), ("r2", ["100 g butter"]), ("r3", [])],
        "id string, recipe_ingredients array<string>",
    )
    amounts = spark.createDataFrame(
        [(1, 1, 1008, 717.0), (1, 2, 1008, 1.0), (1, 3, 1004, 81.0), (8, 1, 1008, 143.0), (8, 2, 9999, 1.0)],
        "fdc_id long, seq int, nutrient_id int, amount double",
    )
    portions = spark.createDataFrame(
        [(1, 2, "cup", None, 227.0), (1, 1, None, "pat", 5.0), (8, 1, "", "large", 50.0)],
        "fdc_id long, seq int, unit_name string, modifier string, gram_weight double",
    )
    terms = nutrition.line_terms(nutrition.lines(recipes, "id", "recipe_ingredients"))
    found = foods.term_nutrition(
        terms.select(F.regexp_replace("term", " salted", "").alias("term")), _foods(spark), amounts, portions
    )
    source = found.select(
        F.concat(F.lit("v9:"), F.when(F.col("term") == "butter", "butter salted").otherwise(F.col("term")))
        .alias("term_key"), "nutrition",
    )
    cache = source.limit(0).withColumn("source", F.lit("usda"))
    stats = nutrition.analyse(recipes, cache, [("usda", source)])
    totals = {r["id"]: r for r in nutrition.totals(stats, "id").collect()}
    # 2 cups by the portion of 227 g
    by_line = {(r["id"], r["pos"]): r for r in nutrition.breakdown(stats, "id").collect()}
    assert by_line["r1", 0]["weight_grams"] == 454.0
    assert by_line["r1", 2]["status"] == "not_found"
    assert totals["r2"]["calories"] == 717.0
    assert totals["r2"]["fat"] == 81.0
    assert totals["r1"]["calories"] >= round(717 * 4.54)
    assert all(totals["r3"][n] == 0 for n in ("calories", "fat"))
    # totals are the sum of the breakdown
    for r in ("r1", "r2"):
        total = sum(x["calories"] or 0.0 for k, x in by_line.items() if k[0] == r)
        assert totals[r]["calories"] == int(total + 0.5)
    lists = nutrition.breakdown_lists(stats, "id").collect()
    assert {x["id"]: len(x["entries"]) for x in lists} == {"r1": 3, "r2": 1, "r3": 0}


def test_known_foods_priority(spark):
    n = "term_key string, nutrition struct<calories:double>"
    cache = spark.createDataFrame([("a", (1.0,), "second")], n + ", source string")
    first = spark.createDataFrame([("a", (2.0,)), ("b", (3.0,)), ("c", None)], n)
    second = spark.createDataFrame([("b", (4.0,)), ("c", (5.0,))], n)
    keys_ = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",), (None,)], "term_key string")
    got = nutrition.resolve_terms(keys_, cache, [("usda", first), ("second", second)])
    assert rows(got, "term_key", "nutrition.calories", "source", "cached") == [
        ("a", 1.0, "second", True), ("b", 3.0, "usda", False), ("c", 5.0, "second", False),
        ("d", None, None, False),
    ]
    fresh = nutrition.new_cache_rows(got, F.lit(0))
    assert rows(fresh, "term_key") == [("b",), ("c",)]


# --- jobs, keys ---------------------------------------------------------------------


def test_crawl_results_block_wins(spark):
    requests = spark.createDataFrame(
        [(1, 0, 2, False, None), (1, 1, 0, True, "blocked"), (2, 0, 1, False, None), (2, 1, 0, False, "e1"),
         (2, 2, 0, False, "e2")],
        "job_id int, request_no int, found int, blocked boolean, error string",
    )
    assert rows(jobs.crawl_results(requests), "job_id", "recipes_found", "errors", "status") == [
        (1, 2, 1, "cooling_down"), (2, 1, 2, "completed")
    ]
    assert rows(jobs.crawl_logs(requests), "job_id", "log") == [(1, "blocked"), (2, "e1\ne2")]


def test_keys(spark):
    requests = spark.createDataFrame(
        [("a", "U+1@x.yz", "k1", 1), ("b", "u+2@X.yz", "k2", 2), ("c", "bad", "k3", 3), ("d", "w@x.yz", "k4", 1)],
        "id string, email string, raw_key string, created_at int",
    )
    records = keys.activate_latest(keys.key_rows(requests))
    assert rows(records, "id", "owner_email", "is_active") == [
        ("a", "u@x.yz", False), ("b", "u@x.yz", True), ("d", "w@x.yz", True)
    ]
    assert keys.several_active(records).count() == 0
    assert rows(keys.authorised(requests, records), "id") == [("b",), ("d",)]


# --- intervals ----------------------------------------------------------------------


def _greedy(times, gap):
    out, last = [], None
    for t in sorted(set(times)):
        if last is None or t - last >= gap:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize("bucket", [60, 61, 100, 3600, None])
def test_intervals_equal_the_greedy_fold(spark, bucket):
    rnd = random.Random(bucket or 1)
    events = []
    for key, n, span in [("hot", 3000, 4000), ("even", 200, 12000), ("rare", 5, 10**6), ("one", 1, 10)]:
        events += [(key, rnd.randint(0, span * 10) / 10) for _ in range(n)]
    events += [("grid", float(t)) for t in range(0, 2000, 20)]
    df = spark.createDataFrame(events, "k string, s double").select(
        "k", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint")).alias("at")
    )
    got = {}
    for r in intervals.accepted(df, "k", "at", 60, bucket).collect():
        got.setdefault(r["k"], []).append(r["us"])
    want = {}
    for k, t in events:
        want.setdefault(k, []).append(int(t * 1_000_000))
    assert {k: sorted(v) for k, v in got.items()} == {
        k: _greedy(v, 60_000_000) for k, v in want.items()
    }


def _after(times, before, gap):
    last = before
    for t in times:
        if t - last >= gap:
            last = t
    return last


def test_step_functions_compose():
    rnd = random.Random(5)
    for _ in range(200):
        times = sorted(rnd.sample(range(300), rnd.randint(2, 40)))
        gap, cut = rnd.randint(1, 60), rnd.randint(1, len(times) - 1)
        first, second = (np.array(x, dtype=np.int64) for x in (times[:cut], times[cut:]))
        both = intervals.composed(times[0], intervals.step_function(first, gap), intervals.step_function(second, gap), gap)
        for before in (intervals.NEVER, *range(times[0] - gap - 2, times[0])):
            want = _after(times, before, gap)
            assert intervals.applied(*intervals.step_function(np.array(times), gap), before, gap) == want
            assert intervals.applied(*both, before, gap) == want
            got = intervals.taken(np.array(times), before, gap).tolist()
            assert (got[-1] if got else before) == want


@pytest.mark.parametrize(("run_rows", "fan"), [(1, 2), (7, 3), (50, 64)])
def test_one_key_with_most_rows_is_dealt_out(spark, run_rows, fan):
    rnd = random.Random(run_rows)
    events = [("hot", rnd.randint(0, 20_000)) for _ in range(2700)] + [(f"k{i % 40}", rnd.randint(0, 9000)) for i in range(300)]
    events += [(None, 5), ("hot", None), ("hot", -700), ("last", 1), ("last", 1)]
    df = spark.createDataFrame(events, "k string, s int").select("k", F.timestamp_seconds("s").alias("at"))
    got = {}
    for r in intervals.accepted(df, "k", "at", 60, run_rows, fan).collect():
        got.setdefault(r["k"], []).append(r["us"])
    want = {}
    for k, t in events:
        if k is not None and t is not None:
            want.setdefault(k, []).append(t * 1_000_000)
    assert {k: sorted(v) for k, v in got.items()} == {k: _greedy(v, 60_000_000) for k, v in want.items()}
    times = df.select("k", F.unix_micros("at").alias("us")).filter("k IS NOT NULL AND us IS NOT NULL").distinct()
    cut = intervals.runs(times, "k", 60_000_000, 50).select("k", "part", F.size("times").alias("n")).collect()
    assert max(r["n"] for r in cut) <= 50
    assert len({r["part"] for r in cut if r["k"] == "hot"}) > 4  # no task holds the key
    assert intervals.accepted(df.limit(0), "k", "at").count() == 0


# --- publishing ---------------------------------------------------------------------


def test_rating_and_document(spark):
    df = spark.createDataFrame(
        [("1", "Pie", None, None, ["a"], ["Mix"], 95), ("2", "Tea", "u", "Nice", None, None, 0)],
        "id string, name string, image string, description string, recipe_ingredients array<string>, "
        "recipe_instructions array<string>, quality_score int",
    ).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    docs = dict(rows(publish.schema_org(df, "Me"), "id", "document"))
    assert '"ratingValue":"4.8"' in docs["1"]
    assert '"description":"A delicious recipe for Pie."' in docs["1"]
    assert '"image":[]' in docs["1"]
    assert "aggregateRating" not in docs["2"]
    assert '"recipeInstructions":[]' in docs["2"]


def test_crawl_record_of_every_outcome(spark):
    requests = spark.createDataFrame(
        [(1, 1, 2, False, "e1", None, None), (1, 2, 1, False, "e2", None, None),
         (2, 1, 4, True, "e", "HTTP 403 at x/1", None), (2, 2, 0, True, None, "Anti-bot page at x/2", "stopped"),
         (3, 1, 5, False, "e3", None, None), (3, 2, 0, False, None, None, "out of memory"),
         (4, 1, 7, False, None, None, None), (6, 1, None, None, None, None, None)],
        "job_id int, request_no int, found int, blocked boolean, error string, reason string, failure string",
    )
    table = spark.createDataFrame(
        [(i, "processing", 0, "old", None, 1, None) for i in (1, 2, 3, 4, 5, 6)],
        "id int, status string, recipes_found int, log string, next_retry_at timestamp, retry_count int, updated_at timestamp",
    )
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    done = jobs.record_results(table, jobs.crawl_results(requests), now, jobs.job_logs(requests))
    got = {r.id: (r.status, r.recipes_found, r.log) for r in done.collect()}
    assert got == {
        1: ("completed", 3, "e1\ne2"), 2: ("cooling_down", 4, "Blocked: Anti-bot page at x/2. Retrying in 48 hours."),
        3: ("failed", 5, "out of memory"), 4: ("completed", 7, "old"), 5: ("processing", 0, "old"), 6: ("completed", None, "old"),
    }
    # many requests in several parts of the log
    many = spark.range(120).select(
        F.lit(1).alias("job_id"), F.col("id").alias("request_no"), F.lit(0).alias("found"), F.lit(False).alias("blocked"),
        F.concat(F.lit("e"), "id").alias("error"),
    )
    assert jobs.job_logs(many).first().log.split("\n") == [f"e{i}" for i in range(120)]
    assert jobs.crawl_results(many).first().status == "completed"


def test_block_reason(spark):
    df = spark.createDataFrame([(403,), (429,), (200,), (None,)], "s int")
    got = [r[0] for r in df.select(jobs.block_reason(F.col("s"), F.lit("u"))).collect()]
    assert got == ["HTTP 403 at u", "HTTP 429 at u", "Anti-bot page at u", "Anti-bot page at u"]


def test_count_beside_the_listing(spark):
    rows = spark.range(130).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("fish "), "id").alias("name"),
        F.when(F.col("id") % 3 == 0, "rejected").otherwise("verified").alias("qa_status"),
        *(F.lit("").alias(c) for c in ("image", "description", "cook_time", "prep_time")),
    )
    listed = s.search(rows, count="total").collect()
    assert len(listed) == 50 and {r.total for r in listed} == {86}
    assert "total" not in s.search(rows).columns


def test_foods_of_one_split_are_dealt_out(spark):
    from larder.operators.shaping import dealt

    made = [(i, f"red apple {i % 7}", "Foundation", 5.0) for i in range(1000)]
    df = spark.createDataFrame(made, "fdc_id long, description string, data_type string, energy double").coalesce(1)
    parts = dealt(df, 100).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) == 10 and max(r["count"] for r in parts) < 200
    assert sorted(dealt(df, 100).collect()) == sorted(df.collect())
    assert dealt(df, 1000).rdd.getNumPartitions() == 1
    terms = spark.createDataFrame([("apple",), ("red apple 3",), ("pear",)], "term string")
    one, many = (sorted(foods.best_foods(terms, df, n).collect()) for n in (10**6, 50))
    assert one == many and [r["term"] for r in one] == ["apple", "red apple 3"]
