"""Content-defined chunking against a byte-by-byte version."""

import hashlib
import random

from larder.llm import fingerprints as fp
from tests.llm import edge


def slow_boundaries(data: bytes) -> list[int]:
    ends, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(fp.GEAR[b])) & 0xFFFFFFFF
        size = i + 1 - start
        mask = int(fp.STRICT) if size < fp.NORMAL else int(fp.LOOSE)
        if size >= fp.LEAST and h & mask == 0 or size == fp.MOST:
            ends.append(i + 1)
            start = i + 1
    return ends + [len(data)] if start < len(data) else ends


def slow(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (own, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        many = len(text) // 4
        changed = text[: len(text) - many] + after[:many]
        sets = []
        for t in (text, changed, after):
            data, at, found = t.encode(), 0, {}
            for end in slow_boundaries(data):
                found[data[at:end]] = end - at
                at = end
            sets.append(found)
        def share(a, b):
            return sum(n for c, n in a.items() if c in b) / sum(a.values()) if a else float(not b)
        out.append((own, len(text), hashlib.sha256(changed.encode()).hexdigest(), round(share(sets[0], sets[1]), 9), round(share(sets[0], sets[2]), 9)))
    return out


def test_boundaries(monkeypatch):
    rng = random.Random(1)
    texts = [b"", b"a", b"a" * 1000, *(bytes(rng.choice(b"abc defg\n") for _ in range(n)) for n in (15, 16, 49, 200, 5000))]
    monkeypatch.setattr(fp, "RUN", 100)  # windows that run over the end of a run
    for t in texts:
        assert fp.boundaries(t) == slow_boundaries(t)


def test_insertion_shifts_nothing_else():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ijk") for _ in range(4000))
    assert fp.containment(fp.chunks(text), fp.chunks("xyz" + text)) > 0.95


def test_neighbours(spark):
    rng = random.Random(3)
    rows = [(i * 3, "".join(rng.choice("abc de") for _ in range(rng.choice([0, 3, 80, 900])))) for i in range(60)]
    rows += [(1000, None), (1001, rows[-1][1])]
    got = fp.neighbours(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    found = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got.collect()]
    assert sorted(found) == sorted(slow(rows))


def test_edges(spark):
    docs = edge.documents(spark)
    rows = fp.neighbours(docs).collect()
    assert len(rows) == docs.count()
    by_text = {r.fingerprint for r in rows if r.doc_id in (1, 7)}
    assert len(by_text) == 1
    assert {r.fingerprint for r in rows if r.doc_id in (2, 3)} == {""}
    assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in rows)
    assert fp.neighbours(edge.empty(spark)).count() == 0
    one = fp.neighbours(docs.filter("doc_id = 7")).collect()
    assert one[0].near_next == 1.0
    assert fp.fingerprints(docs).count() == docs.count()
