"""The filter audit against a plain version: merges, ranges, nulls, repeated rows."""

import re
from itertools import permutations

import numpy as np

from larder.llm import filter_audit
from tests.llm import edge


def plain(docs, labels):
    """(part, order, step) -> counts, one document at a time."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    fails = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        later = i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in docs)
        fails.append((lang or "", i, "".join(f for f, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), later,
        ), strict=True) if bad)))
    rows, total = {}, {}
    for part in {p for p, _, _ in fails}:
        inside = [(i, f) for p, i, f in fails if p == part]
        for order in permutations("ABCDE"):
            left = inside
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[part, f] = total.get((part, f), 0) + len(gone)
                rows[part, "".join(order), step] = (
                    len(left), len(gone), sum(f in x for _, x in inside) - len(gone), sum(x == f for _, x in inside),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                )
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def found(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_galloping_merges():
    rng = np.random.default_rng(2)
    for _ in range(300):
        size = int(rng.integers(1, 200))
        lists = [np.flatnonzero(rng.random(size) < p).tolist() for p in rng.random(int(rng.integers(1, 6)))]
        runs = filter_audit.alone(lists[0], lists[1:])
        got = [x for a, b in runs for x in lists[0][a:b]]
        assert got == [x for x in lists[0] if not any(x in other for other in lists[1:])]
        marked = np.flatnonzero(rng.random(size) < 0.4).tolist()
        assert filter_audit._inside(lists[0], runs, marked) == len(set(got) & set(marked))
    ids = list(range(0, 1000, 3))
    assert [filter_audit.gallop(ids, x, 0) for x in (0, 1, 500, 999, 5000)] == [0, 1, 167, 333, 334]


def test_edges_and_small_ranges(spark):
    rng = np.random.default_rng(4)
    docs = edge.documents(spark)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    shout = " ".join(["SALE", "now", "#1"] * 80)
    more = [(int(i), [shout, "calm words " * 120, " ".join(f"w{k}" for k in range(250)), None][int(i) % 4], "en" if i % 5 else None)
            for i in rng.permutation(120)] + [(11, shout, "en"), (11, "other", "en"), (None, shout, "en"), (None, shout, "")]
    more = [(*r, "s", 1, 2, "h", "k", 3) for r in more]
    both = docs.unionByName(spark.createDataFrame(more, docs.schema))
    rows += [r[:3] for r in more]
    labels = [(1, 1, 0), (5, 0, 1), (11, 1, 1), (11, 0, 0), (12, None, 1), (None, 1, 1), (999, 1, 1), (40, 1, None)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    want = plain(rows, [x for x in labels if x[0] is not None])
    for size in (65_536, 7, 1):
        assert found(filter_audit.interactions(both, marks, rows=size)) == want
    assert filter_audit.interactions(edge.empty(spark), marks).count() == 0
    assert found(filter_audit.interactions(both, marks.limit(0))) == plain(rows, [])
