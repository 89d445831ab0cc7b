"""Nulls, empty and long texts, repeated rows, extra columns and empty tables; exact parts by brute force."""

import re

from larder.llm import mixing, packing, pii, quality, simhash, stages
from tests.llm import edge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_personal_data(spark):
    docs = edge.documents(spark)
    assert pii.find(docs).count() == docs.count()
    assert pii.find(edge.empty(spark)).count() == 0
    assert pii.redact(docs).columns == docs.columns
    text = "mail a.b@c.org, ip 10.0.0.1 and 300.1.1.1, card 4111 1111 1111 1111, phone +49 30 1234567"
    assert [(k, text[a:b]) for k, a, b in pii.base_spans(text)] == [
        ("email", "a.b@c.org"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+49 30 1234567")
    ]


def test_quality_counts(spark):
    docs = edge.documents(spark)
    texts = docs.select("text").collect()
    want = sorted(len(WORD.findall(r.text or "")) for r in texts)
    got = quality.verdicts(docs).collect()
    assert sorted(r.n_words for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)
    assert quality.verdicts(edge.empty(spark)).count() == 0


def test_packing_round_trip(spark):
    docs = edge.documents(spark)
    rows = packing.pack(docs).collect()
    placed = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        placed.setdefault(r.sequence_id, []).append((r.offset, r["length"]))
    for pieces in placed.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    want = sum(len(packing.token_ids(r.text or "", "byte_bpe_50k.json", None)) + 1 for r in docs.collect())
    assert sum(r["length"] for r in rows) == want
    assert packing.pack(edge.empty(spark)).count() == 0


def test_mix(spark):
    docs = edge.documents(spark)
    rows = mixing.taken(*mixing.mix(docs)).collect()
    assert len(rows) == docs.count()
    sums = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        sums.setdefault((r.k, r.target), []).append(r.taken)
    assert all(abs(sum(v) - target) <= 1 for (_, target), v in sums.items())
    assert mixing.taken(*mixing.mix(edge.empty(spark))).count() == 0


def test_stages(spark):
    docs = edge.documents(spark)
    for stage in (stages.simhash_near_dedup, stages.personal_data, stages.source_mix):
        assert stage(spark, docs, "").columns == docs.columns
    # the copies of the plain text and its near copy with one more word (five-word shingles: similarity
    # about 0.95) are one group, the texts without words another; one row of each stays
    group = {"The ": "plain", "": "none", "word": "long", "one": "one", "ünïc": "letters"}
    kept = stages.simhash_near_dedup(spark, docs, "").collect()
    assert sorted(group[(r.text or "").strip()[:4]] for r in kept) == sorted(group.values())
    assert all(tuple(r) in set(map(tuple, docs.collect())) for r in kept)
