"""Learned parts: robust estimates against brute force, held-out accuracy, added spans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import pii, quality, queries, toxicity
from larder.session import table

SMALL = "/root/testdata/sf0.01"
TEXT = "The quick brown fox met twenty other animals near the old river and they all talked about rain for hours until night came down"


def test_small_groups_have_verdicts(spark):
    """Every group size from one row on has an estimate; clean rows stay."""
    rows = [(100 * n + i, f"{TEXT} and word{i} came", "en", f"s{n}") for n in range(1, 12) for i in range(n)]
    got = quality.verdicts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    assert len(got) == len(rows)
    assert all(r.kept is True and r.distance is not None for r in got)


def brute_mcd(x, prior, weight):
    """Lowest log determinant over many starts, each concentrated until it stands."""
    n, p = x.shape
    h, best = (n + p + 1) // 2, None
    for start in range(200):
        pick = np.random.default_rng(1000 + start).permutation(n)[: p + 1]
        for _ in range(30):
            part = x[pick]
            mean, cov = quality._settled(part.mean(axis=0), np.cov(part.T, bias=True), len(part), prior, weight)
            away = x - mean
            pick = np.argsort(np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away))[:h]
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = det, mean, cov
    return best


def test_estimate_near_brute_force(spark):
    rng = np.random.default_rng(5)
    good = rng.normal(0, 0.3, (700, quality.DIMENSIONS)) @ np.triu(rng.uniform(0.2, 1, (quality.DIMENSIONS,) * 2))
    bad = rng.normal(6, 0.2, (200, quality.DIMENSIONS))
    x = np.concatenate([good, bad])
    rows = spark.createDataFrame([("g", v.tolist(), i) for i, v in enumerate(x)], "g string, x array<double>, h bigint")
    rows = rows.withColumn("h", F.xxhash64("h")).repartition(5)
    one = quality.estimates(rows).collect()
    assert len(one) == 1
    det, mean, cov = brute_mcd(x, quality._prior(rows), 30.0)
    assert one[0].det <= det + 0.35  # bins of distance take in a little over half of the rows

    def outside(m, c):
        away = x - np.array(m)
        return np.einsum("ij,jk,ik->i", away, np.linalg.inv(c), away) > 40

    found = outside(one[0].mean, np.reshape(one[0]["cov"], cov.shape))
    assert found[700:].all() and outside(mean, cov)[700:].all()
    assert found[:700].mean() < 0.02


def test_held_out_toxicity(spark):
    scored = queries.op6_toxicity_boosted(spark, SMALL)
    labels = table(spark, SMALL, "labels", ["doc_id", "toxic"])
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    score = np.array([r.score for r in rows])
    y = np.array([int(r.toxic) for r in rows])
    assert ((0 <= score) & (score <= 1)).all() and 0 < y.sum() < len(y)
    order = score[:, None] - score[y == 1]
    below = ((order < 0)[y == 0].mean() + (order == 0)[y == 0].mean() / 2)
    print("held-out area under the curve", below, "of", len(y))
    assert below >= 0.9
    told = score >= 0.7
    if told.any():
        assert y[told].mean() >= 0.8


@pytest.fixture(scope="module")
def selector(spark):
    return pii.train(table(spark, SMALL, "documents", ["doc_id", "text"]))


@pytest.mark.parametrize("text", ["phone (415) 555-0132 for more", "server at 10[.]20[.]30[.]40 is down"])
def test_added_spans(selector, text):
    assert selector is not None
    added = [s for s in pii.spans_of(text, selector) if not s["base"]]
    assert len(added) == 1


def test_no_added_spans_in_clean_text(spark, selector):
    for text in (TEXT, "see version 1.2.3 of page 17, order 20240131, in 1999-2004", "we met at Paris. It was 12:30:45 then"):
        assert pii.spans_of(text, selector) == []


def test_toxicity_features_of_edges():
    scorer = toxicity.Marks(dict.fromkeys(toxicity.SEED, toxicity.SEED_WEIGHT))
    for text in (None, "", " \n", "you IDIOT " * 50_000, "i d i o t", "1d10t!!"):
        got = toxicity.features(text, scorer)
        assert len(got) == toxicity.FEATURES and np.isfinite(got).all()
    assert toxicity.features(None, scorer) == toxicity.features("", scorer)
