"""Personal data against a plain version: the whole contract of the base spans, and the choice of added ones."""

import hashlib
import random
import re
import time

import numpy as np

from larder.llm import boosting, pii, queries

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind, body):
    digits = re.sub("[^0-9]", "", body)
    if kind == "ip":
        return all(int(p) <= 255 for p in body.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def plain(text):
    found = [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(PATTERNS[k], text) if holds(k, m[0])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def test_query_against_plain(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op1_pii_boosted(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        drawn = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(drawn.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in base) for k in KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(",")) | {""}


def slow_added(selector, text, base):
    """Every candidate held against every base span and every span already taken."""
    found = [c for c in pii.candidates(text) if not any(b[1] < c[2] and c[1] < b[2] for b in base)]
    if not found:
        return []
    margin = selector.trees.margin(np.array([pii.features(text, *c) for c in found]))
    share = boosting.calibrated(margin, selector.knots, selector.values)
    taken = []
    for i in sorted(range(len(found)), key=lambda i: (-margin[i], i)):
        kind, start, end = found[i]
        if share[i] >= selector.precision and all(end <= t[1] or t[2] <= start for t in taken):
            taken.append((kind, start, end, float(share[i])))
    return taken


def fitted():
    rng = np.random.default_rng(5)
    x = rng.random((400, len(pii.features("+1 415 555 0132", "phone", 0, 15)))) * 8
    trees = boosting.fit(x, (x[:, 5] > 3).astype(float), rounds=10)
    return pii.Selector(trees, np.array([-100.0, 100.0]), np.array([0.0, 1.0]), 0.4)


def test_choice_against_all_pairs():
    selector, rng, added = fitted(), random.Random(3), 0
    parts = ["+1 415 555 0132", "(415) 555-0132", "4111 1111 1111 1111", "10.0.0.1", "10[.]0[.]0[.]7", "a.b@c.org", "x at y dot org", "12 34 56 78 90 12", "word", "2001:db8:0:1:2:3:4:5"]
    for _ in range(300):
        text = "".join(rng.choice(parts) + rng.choice([" ", ", ", ".", "-"]) for _ in range(rng.randint(0, 14)))
        base = pii.base_spans(text)
        want = slow_added(selector, text, base)
        assert selector.added(text, base) == want
        added += len(want)
        for c in pii.candidates(text):
            assert pii.Cover(base).meets(*c[1:]) == any(b[1] < c[2] and c[1] < b[2] for b in base)
    assert added > 100


def test_many_spans_in_one_text():
    text = " ".join(f"user{i}@host{i}.org 10[.]0[.]0[.]{i % 250}" for i in range(100_000))
    start = time.time()
    spans = pii.spans_of(text, fitted())
    assert sum(s["base"] for s in spans) == 100_000
    assert time.time() - start < 180
