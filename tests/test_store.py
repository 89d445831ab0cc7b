"""Stored tables: what an upsert rewrites, failed and repeated writes, readers, several tables at once."""

import pytest
from pyspark.sql import functions as F

from larder.sources.store import Conflict, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_untouched_buckets_keep_their_files(spark, store):
    first = store.upsert("t", spark.range(1000).select("id", F.lit("a").alias("v")), "id", buckets=16)
    batch = spark.createDataFrame([(3, "b"), (5000, "c")], "id long, v string")
    hit = store.touched(first.tables["t"], batch)
    files = set(store.read("t", first).inputFiles())
    second = store.upsert("t", batch, "id")
    kept = {b: f for b, f in first.tables["t"].folders.items() if b not in hit}
    assert 1 <= len(hit) <= 2 and len(kept) == 16 - len(hit)
    assert {b: second.tables["t"].folders[b] for b in kept} == kept
    assert len(files & set(store.read("t", second).inputFiles())) == len(kept)
    got = dict(rows(store.read("t")))
    assert len(got) == 1001 and got[3] == "b" and got[5000] == "c" and got[4] == "a"
    # a reader of the first version still sees it
    assert dict(rows(store.read("t", first))) == {i: "a" for i in range(1000)}
    assert store.read("none") is None


def test_upserts_equal_a_dictionary(spark, store):
    import random

    pick = random.Random(2)
    state = {}
    for number in range(4):
        batch = {pick.randrange(40): (pick.choice([None, "x", "y"]), number) for _ in range(12)}
        df = spark.createDataFrame([(k, *v) for k, v in batch.items()], "k int, a string, n int")
        store.upsert("t", df, "k", buckets=5, mark=("job", number), overwrite=["n"])
        store.upsert("t", df.withColumn("n", F.lit(-1)), "k", mark=("job", number))  # repeated: ignored
        for k, (a, n) in batch.items():
            state[k] = (a if a is not None else state.get(k, (None, 0))[0], n)
    assert rows(store.read("t")) == sorted(((k, *v) for k, v in state.items()), key=str)
    assert store.version().marks == {"job": 3} and store.applied(("job", 2)) and not store.applied(("job", 4))


def test_rows_without_a_key_are_kept_apart(spark, store):
    df = spark.createDataFrame([(None, 1), (None, 1), (None, 2), (7, 3)], "k int, v int")
    store.upsert("t", df, "k", buckets=3)
    store.upsert("t", spark.createDataFrame([(None, 1), (7, 4)], "k int, v int"), "k")
    assert rows(store.read("t")) == sorted([(None, 1)] * 3 + [(None, 2), (7, 4)], key=str)


def test_a_failed_write_changes_nothing(spark, store):
    store.upsert("t", spark.range(50).select("id", F.lit(1).alias("v")), "id", buckets=4)
    before = store.version()
    broken = spark.range(50).select("id", F.when(F.col("id") < 40, 2).otherwise(F.raise_error(F.lit("no")).cast("int")).alias("v"))
    with pytest.raises(Exception, match="no"):
        store.upsert("t", broken, "id")
    assert store.version() == before
    assert rows(store.read("t")) == sorted(((i, 1) for i in range(50)), key=str)


def test_vacuum_keeps_what_the_last_versions_name(spark, store):
    for n in range(3):
        store.upsert("t", spark.range(n, 20).select("id", F.lit(n).alias("v")), "id", buckets=2)
    last, before = store.version(), store.version(2)
    gone = store.vacuum(keep=2)
    assert f"versions/v{1:010d}.json" in gone and len(gone) == 2
    assert rows(store.read("t", last)) == sorted(((i, min(i, 2)) for i in range(20)), key=str)
    assert rows(store.read("t", before)) == sorted(((i, min(i, 1)) for i in range(20)), key=str)
    assert store.vacuum(keep=2) == []


def test_the_second_of_two_writers_fails(spark, store):
    store.upsert("t", spark.range(5), "id", buckets=2)
    base = store.version()
    mine = store.appended("t", base.tables["t"], spark.range(5, 6))
    other = store.appended("t", base.tables["t"], spark.range(6, 7))
    store.commit(base, {"t": other})
    with pytest.raises(Conflict):
        store.commit(base, {"t": mine})
    assert rows(store.read("t")) == [(i,) for i in (0, 1, 2, 3, 4, 6)]


def test_tables_change_together(spark, store):
    base = store.version()
    a = store.table(base, "a", spark.range(1), "id", 2)
    b = store.table(base, "b", spark.range(1), "id", 3)
    store.commit(base, {"a": store.appended("a", a, spark.range(4)), "b": store.appended("b", b, spark.range(2))}, ("m", 0))
    base = store.version()
    store.commit(base, {n: store.replaced(n, base.tables[n], spark.range(9, 10)) for n in "ab"}, ("m", 1))
    assert rows(store.read("a")) == rows(store.read("b")) == [(9,)]
    assert rows(store.read("a", store.version(1))) == [(i,) for i in range(4)]
    store.rebucket("a", 7)
    assert store.version().tables["a"].buckets == 7 and rows(store.read("a")) == [(9,)]


def test_empty_batches_and_new_columns(spark, store):
    empty = spark.createDataFrame([], "k int, v int")
    store.upsert("t", empty, "k", buckets=2)
    assert store.read("t").count() == 0
    store.upsert("t", spark.createDataFrame([(1, 2, 3)], "k int, v int, extra int"), "k")
    assert rows(store.read("t")) == [(1, 2)]
    store.upsert("t", spark.createDataFrame([(1,), (2,)], "k int"), "k")
    assert rows(store.read("t")) == [(1, 2), (2, None)]
