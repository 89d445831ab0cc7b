"""The lookup table against a plain filling and its promises."""

import hashlib
from collections import Counter

import pytest

from larder.llm import queries, sharding
from tests.llm import edge


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def slow_fill(shards, slots):
    orders = []
    for s in shards:
        start, step = number(f"start:{s}") % slots, number(f"step:{s}") % (slots - 1) + 1
        orders.append([(start + j * step) % slots for j in range(slots)])
    owner = {}
    while len(owner) < slots:
        for i, order in enumerate(orders):
            free = next((x for x in order if x not in owner), None)
            if free is not None:
                owner[free] = i
    return [owner[x] for x in range(slots)]


def test_fill():
    names = ["a", "b", "c", "d", "e"]
    assert sharding.fill(names, 251) == slow_fill(names, 251)
    assert sharding.fill(["only"], 13) == [0] * 13


def test_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    full = sharding.fill(names, 10_007)
    sizes = Counter(full).values()
    assert max(sizes) - min(sizes) <= 1
    less = sharding.fill(names[:-1], 10_007)
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != 9)
    assert moved < 0.1 * 10_007
    heavy = Counter(sharding.fill(names, 10_007, [3] + [1] * 9))
    assert 2.7 < heavy[0] / heavy[1] < 3.3


@pytest.mark.parametrize("shards, slots", [(["a"], 12), ([], 13), (["a", "a"], 13), (["a"] * 1, 1)])
def test_refused(shards, slots):
    with pytest.raises(ValueError):
        sharding.fill(shards, slots)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    df = queries.op5_sharding_lookup(spark, folder)
    table = sharding.fill(queries.SHARDS)
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in rows:
        slot = number(str(r.doc_id)) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, queries.SHARDS[table[slot]])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "hashpartitioning" not in plan


def test_edges(spark, tmp_path):
    docs = edge.documents(spark)
    placed = sharding.place(docs, "doc_id", ["x", "y"], 13)
    assert placed.count() == docs.count() and placed.columns == [*docs.columns, "slot", "shard"]
    assert sum(r.n_rows for r in sharding.shares(placed).collect()) == docs.count()
    assert sharding.place(edge.empty(spark), "doc_id", ["x", "y"], 13).count() == 0
    with pytest.raises(ValueError):
        sharding.place(placed, "doc_id", ["x"], 13)
    sharding.write(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()
