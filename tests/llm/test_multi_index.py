"""The inverted multi-index against all distances: recall, exactness, copies, edges."""

import math

import numpy as np
import pytest

from larder.llm import multi_index
from larder.session import table

SCHEMA = "vec_id bigint, embedding array<double>, id int, v string, q int"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 1, "v", 2) for i, x in rows], SCHEMA)


def plain(rows, ids, k=10):
    """(query, rank) -> (id, distance) by all distances."""
    size = max((len(x) for _, x in rows if x is not None), default=0)
    good = sorted({
        (i, tuple(v + 0.0 for v in x)) for i, x in rows
        if i is not None and x is not None and len(x) == size
        and all(v is not None and math.isfinite(v) for v in x) and any(x)
    })
    out = {}
    for q, y in good:
        if q in ids:
            found = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), i) for i, x in good if i != q)[:k]
            out |= {(q, rank + 1): (i, pytest.approx(d, abs=1e-12)) for rank, (d, i) in enumerate(found)}
    return out


def found(df):
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in df.collect()}


def test_walk_is_in_order_and_whole():
    rng = np.random.default_rng(0)
    index = multi_index.Index(rng.normal(size=(7, 3)), rng.normal(size=(7, 3)), np.zeros(50), 1, 0.0, 0.0)
    x = rng.normal(size=6)
    walked = list(index.walk(x))
    a, b = index.halves(x)
    assert sorted(c for _, c in walked) == list(range(49))
    assert [s for s, _ in walked] == sorted(s for s, _ in walked)
    assert all(s == pytest.approx(a[c // 7] + b[c % 7]) for s, c in walked)


def test_recall_on_the_table(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings", ["vec_id", "embedding"])
    local = [(r.vec_id, list(r.embedding)) for r in rows.collect()]
    ids = set(range(0, 2000, 20))
    want = plain(local, ids)
    got = found(multi_index.search(rows, rows.filter("vec_id % 20 = 0"), first=100, unit=256, query_block=32))
    assert got.keys() == want.keys()
    pairs = {(q, i) for (q, _), (i, _) in want.items()}
    assert len(pairs & {(q, i) for (q, _), (i, _) in got.items()}) >= 0.9 * len(pairs)
    stored = {i: np.array(x) for i, x in local}
    for (q, _), (i, score) in got.items():
        assert score == pytest.approx(np.linalg.norm(stored[q] - stored[i]), abs=1e-12)


def test_all_cells_give_the_exact_result_with_copies_and_edges(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=5)]) for i in range(200)]
    copy = [1.0, 2.0, 0.0, -1.0, 0.5]
    rows += [(i, copy) for i in range(300, 420)] + [(300, copy), (7, rows[7][1]), (8, copy)]
    rows += [
        (500, None), (600, []), (700, [0.0] * 5), (800, [1.0, None, 1.0, 1.0, 1.0]), (900, [1.0, math.nan, 0.0, 0.0, 0.0]),
        (1000, [1.0, math.inf, 0.0, 0.0, 0.0]), (1100, [1.0, 2.0]), (None, copy), (1200, [-0.0, 1.0, 0.0, 0.0, 0.0]),
        (1201, [0.0, 1.0, -0.0, 0.0, 0.0]),
    ]
    df = frame(spark, rows)
    ids = {i for i, _ in rows if i is not None and i % 100 == 0}
    got = found(multi_index.search(df, df.filter("vec_id % 100 = 0"), reach=1.0, first=20, unit=32, query_block=4))
    assert got == plain(rows, ids)


def test_fewer_rows_than_asked_and_none(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(4)]
    df = frame(spark, rows)
    assert found(multi_index.search(df, df.filter("vec_id = 0"))) == plain(rows, {0})
    assert multi_index.search(frame(spark, rows[:1]), df.filter("vec_id = 0")).count() == 0
    empty = frame(spark, [])
    assert multi_index.search(empty, empty).count() == 0
    assert multi_index.search(df, empty).count() == 0
    one = frame(spark, [(0, [2.0]), (1, [3.0]), (2, [-1.0])])  # vectors of one component
    assert found(multi_index.search(one, one.filter("vec_id = 0"))) == {(0, 1): (1, 1.0), (0, 2): (2, 3.0)}
