"""SimHash groups against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import simhash


def brute_components(fps, bits=4):
    """Smallest member reachable over pairs of at most `bits` differing bits."""
    fps = sorted({int(f) for f in fps})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_every_pair_within_four_bits_shares_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, i % 5, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    (ra, ka), (rb, kb) = simhash.keys(a), simhash.keys(b)
    left = set(zip(ra.tolist(), ka.tolist(), strict=True))
    shared = {r for r, k in zip(rb.tolist(), kb.tolist(), strict=True) if (r, k) in left}
    assert len(shared) == len(a)


def test_fingerprint_by_definition():
    import xxhash

    text = "Ab c\td\x0b e É a\u00a0b c d"
    words = text.encode().lower().split()
    assert words[4] == "É".encode() and words[5] == "a\u00a0b".encode()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("Ab") == xxhash.xxh64_intdigest(b"ab", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("bucket_rows", [8192, 3])
def test_links_connect_what_brute_force_connects(spark, bucket_rows):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = list(base)
    for i in range(260):
        x = fps[rng.integers(0, len(fps))] if i % 3 else base[0]
        for bit in rng.choice(64, rng.integers(1, 6), replace=False):
            x ^= np.uint64(1) << np.uint64(bit)
        fps.append(x)
    fps = np.array(fps, dtype=np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(f),) for f in fps], "fp bigint").repartition(3)
    found = simhash.components(simhash.links(df, bucket_rows=bucket_rows)).collect()
    got = {r.node: r.root for r in found}
    want = brute_components(fps)
    assert len(found) == len(got)
    for f, root in want.items():
        mates = {g for g, r in want.items() if r == root}
        assert got.get(f, f) == min(mates)


def test_null_empty_repeated_and_extra_columns(spark):
    rows = [(3, None, "x"), (2, "", "y"), (None, " \t", "z"), (7, "one two three four five", "q"),
            (7, "one two three four five", "q"), (5, "ONE two three four five", "q"), (9, "w " * 60000, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string").withColumn("key", F.lit(1))
    got = sorted(simhash.near_groups(docs).select("doc_id", "component_id").collect(), key=str)
    assert got == sorted([(2, 2), (3, 2), (None, 2), (5, 5), (7, 5), (7, 5), (9, 9)], key=str)
    assert simhash.near_groups(docs.limit(0)).collect() == []
