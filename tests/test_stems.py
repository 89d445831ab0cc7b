"""The stored stem map: what it holds, what an increment adds, and searches by it."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from larder.functions import fixed, porter
from larder.operators import search as s
from larder.operators.stems import StemMap
from larder.sources.store import Store

WORDS = ["bake", "baked", "baking", "Bakes", "baker", "fish", "fishing", "the", "ovens", "hot", "größe", "a1", "42"]


def texts(spark, seed, n=60):
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(0, 12)))) for i in range(n)] + [(n, None), (n + 1, "")]
    return rows, spark.createDataFrame(rows, "id int, t string")


@pytest.fixture
def stems(spark, tmp_path):
    return StemMap(Store(spark, str(tmp_path / "stems")), buckets=4)


def held(stems):
    return sorted(map(tuple, stems.store.read("stems").collect()))


def test_increments_add_new_words_only(spark, stems):
    with pytest.raises(LookupError):
        stems.spellings(["bake"])
    first = spark.createDataFrame([("Baking, baked fish",), (None,), ("",), ("baked 42 größe a1 xy",)], "t string")
    stems.learn(first, F.col("t"))
    assert held(stems) == [(w, porter.stem(w)) for w in ("baked", "baking", "fish")]
    files, number = set(stems.store.read("stems").inputFiles()), stems.store.version().number
    stems.learn(first, F.col("t"))  # a repeated batch
    assert stems.store.version().number == number
    stems.learn(spark.createDataFrame([("fish fishing bakes",)], "t string"), F.col("t"))
    assert held(stems) == sorted((w, porter.stem(w)) for w in ("baked", "baking", "fish", "fishing", "bakes"))
    assert files < set(stems.store.read("stems").inputFiles())
    assert stems.spellings(["bake", "größe", "none"]) == {"bake": ["baked", "bakes", "baking"], "größe": ["größe"], "none": []}
    assert stems.spellings(["bake"], most=2) is None


def test_an_empty_corpus(spark, stems):
    stems.learn(spark.createDataFrame([], "t string"), F.col("t"))
    assert stems.spellings(["bake"]) == {"bake": []}
    stems.learn(spark.createDataFrame([("bakes",)], "t string"), F.col("t"))
    assert stems.spellings(["bake"]) == {"bake": ["bakes"]}


@pytest.mark.parametrize("query", [
    s.TextQuery(all_of=("baking", "fish"), none_of=("oven",)), s.TextQuery(any_of=("größe", "baker", "42")),
    s.TextQuery(phrases=(("baked", "fishing"),)), s.TextQuery(all_of=("unknown",)), s.TextQuery(all_of=("the",)),
])
def test_searches_equal_those_that_stem_themselves(spark, stems, query):
    rows, df = texts(spark, 3)
    stems.learn(df, F.col("t"))
    stored = s.text_search(df, F.col("t"), query, key="id", stem=stems).collect()
    assert stored == s.text_search(df, F.col("t"), query, key="id", stem=True).collect()
    if query.all_of == ("baking", "fish"):
        found = {i: {porter.stem(w) for w in (t or "").lower().split() if w not in fixed.STOP_WORDS} for i, t in rows}
        assert {r["id"] for r in stored} == {i for i, x in found.items() if {"bake", "fish"} <= x and "oven" not in x}


@pytest.mark.parametrize("name", ["stem_search", "hybrid_stemmed"])
def test_no_text_leaves_the_jvm(spark, name):
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
