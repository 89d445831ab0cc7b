"""Near-duplicates by shingle similarity against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import simhash, similar, stages

SCHEMA = "doc_id bigint, text string, lang string, source string"


def plain(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def brute(texts, least=0.8):
    """Component number of every text."""
    sets, root = [plain(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or jaccard(a, sets[j]) >= least:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def edited(rng, words, many):
    words = list(words)
    for at in rng.sample(range(len(words)), many):
        words[at] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def corpus():
    """Groups of near copies from 0.6 to 1, one of them hot, and clean texts."""
    rng = random.Random(3)
    texts = [None, "", " \n", "one two", "ONE two", "one two three"]
    for group in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts += [" ".join(words)] + [edited(rng, words, many) for many in range(1, 9)]
        if group == 0:
            texts += [edited(rng, words, 1 + n % 6) for n in range(150)]
    return texts


@pytest.mark.parametrize("bucket_rows", [1024, 7])
def test_groups_against_brute_force(spark, bucket_rows):
    texts = corpus()
    want = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in similar.similar_groups(docs, bucket_rows=bucket_rows).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_stage_takes_copies_of_point_eight_and_leaves_others(spark):
    rng = random.Random(4)
    rows, near = [], 0
    for n in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for i, many in enumerate((0, 4, 30)):
            rows.append((3 * n + i, edited(rng, words, many), "en", "a"))
        near += jaccard(plain(rows[-3][1]), plain(rows[-2][1])) >= 0.8
        assert jaccard(plain(rows[-3][1]), plain(rows[-1][1])) < 0.8
    assert near == 40
    kept = {r.doc_id for r in stages.simhash_near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert kept == {r[0] for r in rows if r[0] % 3 != 1}


def test_recall_of_the_candidates():
    """Share of pairs just above 0.8 that share a key."""
    rng = np.random.default_rng(6)
    met = 0
    for _ in range(2000):
        grams = np.unique(rng.integers(0, 2**32, 230, dtype=np.uint64).astype("<u4"))
        a, b = np.sort(grams[: len(grams) - 22]), np.sort(grams[22:])
        assert similar.similarity(a, b) > 0.8
        met += bool(np.intersect1d(similar.band_keys(a), similar.band_keys(b)).size)
    print("pairs at 0.81 that share a key:", met, "of 2000")
    assert met >= 1990


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, None), (4, ""), (4, ""), (2, "a b"), (2, "a b")], "doc_id bigint, text string")
    got = similar.similar_groups(docs.withColumn("sid", F.lit(1)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, 4), (4, 4), (4, 4), (2, 2), (2, 2)], key=str)
    assert similar.similar_groups(docs.limit(0)).collect() == []


def test_stage_links_by_fingerprints_too(spark):
    """Copies with a word changed every 40 share too few shingles of five words for 0.8 but, of long texts, often
    have fingerprints within four bits; the groups of the stage are those of both, and of chains through both."""
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(300)}" for _ in range(900)]
        far = list(words)
        for at in range(0, 900, 36):
            far[at] = "x"
        texts += [" ".join(words), " ".join(far), edited(rng, far, 3)]
    fps = [simhash.fingerprint(t) for t in texts]
    root = brute(texts)
    apart = [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4 and root[i] != root[j]]
    assert apart  # what the shingles alone would leave
    for i, j in apart:
        low, high = sorted((root[i], root[j]))
        root = [low if r == high else r for r in root]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], SCHEMA)
    kept = {r.doc_id for r in stages.simhash_near_dedup(spark, docs, "").collect()}
    assert kept == set(root)


def test_blocks_of_long_texts_are_counted_by_ranges(monkeypatch):
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 2**32, 5000, dtype=np.uint64).astype("<u4"))
    sets = [base, base[: int(0.9 * len(base))], base[: int(0.5 * len(base))], np.unique(rng.integers(0, 2**32, 700, dtype=np.uint64).astype("<u4"))]
    monkeypatch.setattr(similar, "_SHARE", 1000)
    a, b = similar._linked(np.arange(4), sets, 0.8)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(0, 1)}
