import math

import numpy as np
import pytest

from quakeledger.functions import estimators as es
from quakeledger.functions import tails


def binom(n, p):
    return [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]


@pytest.mark.parametrize("n,p", [(5, 0.3), (60, 0.001), (300, 0.5), (40, 0.97)])
def test_binomial_tails(n, p):
    pmf = binom(n, p)
    for k in range(0, n + 1, max(1, n // 17)):
        assert tails.upper_tail(k, n, p) == pytest.approx(sum(pmf[k:]), abs=1e-10)
        assert tails.lower_tail(k, n, p) == pytest.approx(sum(pmf[: k + 1]), abs=1e-10)
    assert tails.upper_tail(5_000, 5_000_000, 0.001) == pytest.approx(0.5, abs=0.01)


def test_chi_square_critical_values():
    for df, x in ((1, 3.841), (8, 15.507), (30, 43.773)):
        assert tails.chi_square_sf(x, df) == pytest.approx(0.05, abs=1e-4)


def test_omori_recovers_p():
    rng = np.random.default_rng(1)
    for p in (0.9, 1.1, 1.4):
        c, top = 0.05, 30.0
        u = rng.random(3000)
        a, b = c ** (1 - p), (top + c) ** (1 - p)
        t = (a + u * (b - a)) ** (1 / (1 - p)) - c
        fit = es.fit_omori(t)
        assert not fit["degenerate"] and abs(fit["p"] - p) / p < 0.2
    assert es.fit_omori(rng.uniform(0, 30, 500))["degenerate"]
    assert es.fit_omori(np.array([1.0, 2.0]))["degenerate"] and es.fit_omori(np.full(9, 3.0))["degenerate"]


def test_dimension_of_a_line_and_a_square():
    rng = np.random.default_rng(2)
    x = rng.random(900)
    assert 0.85 < es.correlation_dimension(np.column_stack([x, 2 * x])) < 1.1
    assert 1.7 < es.correlation_dimension(rng.random((900, 2))) < 2.05
    assert math.isnan(es.correlation_dimension(np.zeros((100, 2))))


def test_trend_equals_brute_force():
    v = np.random.default_rng(3).integers(0, 9, 60) / 2
    s = sum(np.sign(v[j] - v[i]) for i in range(60) for j in range(i + 1, 60))
    assert es.mann_kendall_z(v)[0] == s
    x = np.arange(60.0)
    assert es.sen_slope(x, v) == pytest.approx(np.median([(v[j] - v[i]) / (j - i) for i in range(60) for j in range(i + 1, 60)]))
    assert math.isnan(es.sen_slope(np.ones(5), np.arange(5.0)))


def test_bootstrap_error():
    v = np.round(np.arange(2, 6, 0.1), 1)
    counts = np.maximum(1, (1000 * 10 ** -(v - 2))).astype(int)
    assert 0 <= es.mc_bootstrap_se(v, counts) < 0.2
    assert es.mc_bootstrap_se(v[:1], np.array([50])) == 0 and math.isnan(es.mc_bootstrap_se(v[:2], np.array([3, 3])))
    flat = np.full(len(v), 5)
    assert es.mc_bootstrap_se(v, flat) > 0.3


def sums(x):
    have = np.isfinite(x)
    mask = (have * (1 << np.arange(5))).sum(1)
    n, s, q = np.zeros((1, 32)), np.zeros((1, 32, 5)), np.zeros((1, 32, 5, 5))
    for m, row in zip(mask, np.where(have, x, 0.0)):
        n[0, m] += 1
        s[0, m] += row
        q[0, m] += np.outer(row, row)
    return n, s, q


def em_by_rows(x):
    """Expectation maximisation row by row."""
    x = x[np.isfinite(x).any(1)]
    n, p = x.shape
    mu = np.nanmean(x, 0)
    d = np.where(np.isfinite(x), x - mu, 0.0)
    sigma = d.T @ d / n + 1e-8 * np.eye(p)
    for _ in range(200):
        sx, sxx = np.zeros(p), np.zeros((p, p))
        for row in x:
            o = np.isfinite(row)
            u = ~o
            full, extra = row.copy(), np.zeros((p, p))
            if u.any():
                g = sigma[np.ix_(u, o)] @ np.linalg.inv(sigma[np.ix_(o, o)] + 1e-8 * np.eye(o.sum()))
                full[u] = mu[u] + g @ (row[o] - mu[o])
                extra[np.ix_(u, u)] = sigma[np.ix_(u, u)] - g @ sigma[np.ix_(o, u)]
            sx += full
            sxx += np.outer(full, full) + extra
        mu2 = sx / n
        s2 = sxx / n - np.outer(mu2, mu2)
        s2 = (s2 + s2.T) / 2 + 1e-8 * np.eye(p)
        done = max(np.abs(mu2 - mu).max(), np.abs(s2 - sigma).max()) < 1e-8
        mu, sigma = mu2, s2
        if done:
            break
    d2, used = 0.0, 0
    keys = np.isfinite(x)
    for key in {tuple(k) for k in keys}:
        o = np.array(key)
        rows = x[(keys == o).all(1)][:, o]
        diff = rows.mean(0) - mu[o]
        d2 += len(rows) * diff @ np.linalg.inv(sigma[np.ix_(o, o)]) @ diff
        used += o.sum()
    return d2, used - p


def test_little_equals_the_fit_by_rows():
    rng = np.random.default_rng(5)
    z = rng.normal(size=(150, 5))
    z[:, 1] += 0.8 * z[:, 0]
    x = np.where(rng.random(z.shape) < 0.2, np.nan, z)
    got = es.little_tests(*sums(x))
    d2, df = em_by_rows(x)
    assert got["df"][0] == df and got["d2"][0] == pytest.approx(d2, rel=1e-5)
    x = z.copy()
    x[z[:, 0] > 0.3, 4] = np.nan  # missing where another column is large
    assert not es.little_tests(*sums(x))["mcar"][0]
    assert es.little_tests(*sums(z))["n_patterns"][0] == 1 and es.little_tests(*sums(z))["mcar"][0]
    assert es.little_tests(np.zeros((1, 32)), np.zeros((1, 32, 5)), np.zeros((1, 32, 5, 5)))["mcar"][0]


def test_linkage_separates_close_pairs():
    w = np.zeros((2, 125))
    w[0, 0], w[0, 62], w[0, 124], w[0, 93] = 50, 400, 300, 350
    post, pi = es.linkage_fits(w)
    assert post[0, 0] > 0.95 and post[0, 124] < 0.05 and 0.01 < pi[0] < 0.2 and pi[1] == 0.05
