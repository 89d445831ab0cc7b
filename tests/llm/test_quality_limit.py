"""The limit of the quality rules: quantiles, the consistency factor, and the reweighting step."""

import numpy as np
import pytest

from larder.llm import quality


def test_quantiles_as_in_published_tables():
    for share, k, value in ((0.5, 1, 0.45494), (0.95, 2, 5.99146), (0.975, 7, 16.01276), (0.99, 10, 23.20925), (0.999, 7, 24.32189)):
        assert quality.quantile(share, k) == pytest.approx(value, abs=1e-4)
        assert quality.chi_square(value, k) == pytest.approx(share, abs=1e-5)
    assert quality.chi_square(0.0, 7) == 0.0 and quality.consistency(1.0) == 1.0


def test_the_factor_makes_the_scatter_of_normal_rows_right():
    x = np.random.default_rng(1).normal(size=(200_000, quality.DIMENSIONS))
    d2 = (x * x).sum(axis=1)
    for share in (0.5, 0.75, 0.975):
        inner = x[np.argsort(d2)[: int(share * len(x))]]
        assert inner.var() * quality.consistency(share) == pytest.approx(1.0, abs=0.01)


def test_reweighted_estimates_equal_a_plain_version(spark):
    rng = np.random.default_rng(5)
    p = quality.DIMENSIONS
    mixing = np.triu(rng.uniform(0.2, 1, (p, p)))
    groups = {"big": np.vstack([rng.normal(0, 0.3, (900, p)) @ mixing, rng.normal(6, 0.2, (90, p))]), "two": rng.normal(0, 0.3, (2, p))}
    rows = spark.createDataFrame([(g, [float(v) for v in r], i) for g, x in groups.items() for i, r in enumerate(x)], "g string, x array<double>, h long")
    prior = quality._prior(rows)
    raw = quality.estimates(rows, prior=prior).cache()
    got = {r["g"]: r for r in quality.reweighted(rows, raw, prior, 30.0).collect()}
    assert set(got) == set(groups)
    for r in raw.collect():
        x = groups[r["g"]]
        n = len(x)
        wide = np.reshape(r["cov"], (p, p)) * quality.consistency(min(1.0, (n + p + 1) // 2 / n))
        part = x[quality._distances(x, np.array(r["mean"]), wide) <= quality.quantile(0.975)]
        cov = np.cov(part.T, bias=True) * quality.consistency(0.975)
        mean, cov = quality._settled(part.mean(axis=0), cov, len(part), prior, 30.0)
        assert np.allclose(got[r["g"]]["mean"], mean) and np.allclose(np.reshape(got[r["g"]]["cov"], (p, p)), cov)
    d2 = quality._distances(groups["big"], np.array(got["big"]["mean"]), np.reshape(got["big"]["cov"], (p, p)))
    assert (d2[:900] <= quality.quantile(1 - 1e-6)).all() and (d2[900:] > quality.quantile(1 - 1e-6)).all()
