"""Small iterative fits, on inputs that are bounded by the aggregations before them."""

from __future__ import annotations

import math

import numpy as np

from quakeledger.functions.tails import chi_square_sf


def fit_omori(days: np.ndarray) -> dict:
    """K / (t + c) ** p fitted to aftershock times: geometric bins, count-weighted log regression over a grid of c.

    degenerate: fewer than 5 times or 3 filled bins, no spread, p not above 0, or times no farther from uniform than the
    5 % critical value of the one-sample statistic.
    """
    t = np.sort(days[days > 0])
    n = len(t)
    none = {"p": math.nan, "c": math.nan, "k": math.nan, "n": n, "degenerate": True}
    if n < 5 or t[0] >= t[-1]:
        return none
    edges = omori_edges(n, t[0], t[-1])
    far = np.abs(np.arange(1, n + 1) / n - t / t[-1]).max()
    return fit_binned(n, edges, np.histogram(t, edges)[0], far)


def omori_edges(n: int, first: float, last: float) -> np.ndarray:
    """Edges of the at most 30 geometric bins of n times; a bin holds its lower edge, the last one both."""
    return np.geomspace(first, last, min(30, max(5, n // 3)) + 1)


def fit_binned(n: int, edges: np.ndarray, counts: np.ndarray, far: float) -> dict:
    """fit_omori from the counts of all n times in their bins and their distance from uniform."""
    full = counts > 0
    if full.sum() < 3:
        return {"p": math.nan, "c": math.nan, "k": math.nan, "n": n, "degenerate": True}
    mid, w = ((edges[1:] + edges[:-1]) / 2)[full], counts[full].astype(float)
    y = np.log(w / np.maximum(np.diff(edges)[full], 1e-9))
    c = np.geomspace(1e-3, max(1.0, edges[-1] / 10), 25)
    x = np.log(mid[None, :] + c[:, None])
    mx, my = (x * w).sum(1) / w.sum(), (y * w).sum() / w.sum()
    dx, dy = x - mx[:, None], y - my
    slope = (w * dx * dy).sum(1) / (w * dx * dx).sum(1)
    level = my - slope * mx
    sse = (w * (y - level[:, None] - slope[:, None] * x) ** 2).sum(1)
    best = int(np.argmin(sse))
    p = -slope[best]
    root = math.sqrt(n)
    flat = far < 1.358 / (root + 0.12 + 0.11 / root)
    return {"p": float(p), "c": float(c[best]), "k": math.exp(min(700.0, level[best])), "n": n, "degenerate": bool(not math.isfinite(p) or p <= 0 or flat)}


def correlation_dimension(xy: np.ndarray) -> float:
    """Slope of the log correlation sum over the middle of 20 radii between the 1st and 30th percentile of distances."""
    if len(xy) < 20:
        return math.nan
    d = np.sort(np.concatenate([np.hypot(*(xy[i + 1 :] - xy[i]).T) for i in range(len(xy) - 1)]))
    d = d[d > 0]
    if len(d) < 10:
        return math.nan
    low, high = np.percentile(d, [1, 30])
    if low <= 0 or high <= low:
        return math.nan
    r = np.geomspace(low, high, 20)
    share = np.searchsorted(d, r, side="left") / len(d)
    r, share = np.log(r[share > 0]), np.log(share[share > 0])
    k = len(r)
    if k < 4:
        return math.nan
    a, b = int(k * 0.2), int(k * 0.8)
    if b - a < 3:
        a, b = 0, k
    return float(np.polyfit(r[a:b], share[a:b], 1)[0])


def mann_kendall_z(v: np.ndarray) -> tuple[float, float]:
    """(S, z) of a series in order: sum of signs of all later differences, tie-corrected and continuity-corrected."""
    n = len(v)
    if n < 4:
        return math.nan, math.nan
    s = float(sum(int((v[i + 1 :] > v[i]).sum()) - int((v[i + 1 :] < v[i]).sum()) for i in range(n - 1)))
    ties = np.unique(v, return_counts=True)[1].astype(float)
    var = (n * (n - 1) * (2 * n + 5) - (ties * (ties - 1) * (2 * ties + 5)).sum()) / 18
    return s, 0.0 if var <= 0 or s == 0 else (s - math.copysign(1, s)) / math.sqrt(var)


def sen_slope(x: np.ndarray, y: np.ndarray) -> float:
    """Median slope of all pairs with different x."""
    slopes = []
    for i in range(len(x) - 1):
        dx = x[i + 1 :] - x[i]
        ok = dx != 0
        slopes.append((y[i + 1 :] - y[i])[ok] / dx[ok])
    slopes = np.concatenate(slopes) if slopes else np.zeros(0)
    return float(np.median(slopes)) if len(slopes) else math.nan


def max_curvature_mc(values: np.ndarray, counts: np.ndarray, width: float = 0.1) -> float:
    """Lower edge of the fullest bin (the lowest on ties), bins anchored at the least value."""
    values = values[counts > 0]
    counts = counts[counts > 0]
    if counts.sum() < 2:
        return math.nan
    low = values.min()
    if values.max() == low:
        return float(low)
    bins = np.floor((values - low) / width + 1e-9).astype(int)
    return float(low + np.bincount(bins, counts).argmax() * width)


def mc_bootstrap_se(values: np.ndarray, counts: np.ndarray, draws: int = 200, seed: int = 42) -> float:
    """Standard deviation of Mc over resamples; a resample of n rows is one multinomial draw over the distinct values.

    values ascend. Every resample's bins are anchored at its own least value; all draws are binned together.
    """
    n = int(counts.sum())
    if n < 10:
        return math.nan
    got = np.random.default_rng(seed).multinomial(n, counts / n, size=draws)
    low = values[(got > 0).argmax(1)]
    bins = np.maximum(np.floor((values[None, :] - low[:, None]) / 0.1 + 1e-9).astype(np.int64), 0)
    width = int(bins.max()) + 1
    at = np.unique(bins + width * np.arange(draws)[:, None], return_inverse=True)
    sums = np.bincount(at[1].ravel(), got.ravel().astype(float))
    row, pos = at[0] // width, at[0] % width
    order = np.lexsort((pos, -sums, row))  # of each draw the fullest bin, the lowest on ties
    first = np.r_[True, row[order][1:] != row[order][:-1]]
    return float((low + pos[order][first] * 0.1).std(ddof=1))


#: The patterns of observed columns among five, by number: bit i for column i.
PATTERNS = (np.arange(32)[:, None] >> np.arange(5) & 1).astype(bool)


def little_tests(n: np.ndarray, sums: np.ndarray, products: np.ndarray) -> dict[str, np.ndarray]:
    """Little's tests of missing completely at random for many data sets at once, from sums by pattern.

    n (c, 32), sums (c, 32, 5), products (c, 32, 5, 5) of the observed values of each pattern (0 elsewhere). The normal
    model with missing values is fitted by expectation maximisation: what a row's missing values add is linear in its
    observed ones, so the sums are all it needs. All data sets and patterns are inverted in one batch; those that have
    converged rest.
    """
    n = n.astype(float).copy()
    n[:, 0] = 0.0  # rows without any value tell nothing
    c, p, ridge = len(n), 5, 1e-8
    m = PATTERNS.astype(float)
    both, eye = m[:, :, None] * m[:, None, :], np.eye(p)
    total = np.maximum(n.sum(1), 1.0)
    have = n @ m
    mu = np.where(have > 0, (sums * (n > 0)[:, :, None]).sum(1) / np.maximum(have, 1.0), 0.0)
    cross = sums[:, :, :, None] * mu[:, None, None, :]
    centred = (products - cross - np.swapaxes(cross, 2, 3) + n[:, :, None, None] * (mu[:, None, :, None] * mu[:, None, None, :])) * both * (n > 0)[:, :, None, None]
    sigma = centred.sum(1) / total[:, None, None] + ridge * eye
    n_patterns = (n > 0).sum(1)
    converged = np.zeros(c, bool)
    live = np.nonzero(n_patterns >= 2)[0]

    def inverses(s: np.ndarray, extra: float) -> np.ndarray:
        """Inverses of the observed blocks, 0 elsewhere."""
        full = s[:, None] * both + (1 - m)[:, :, None] * eye + extra * m[:, :, None] * eye
        try:
            return np.linalg.inv(full) * both
        except np.linalg.LinAlgError:  # a column without spread
            return np.linalg.pinv(full, hermitian=True) * both

    for _ in range(200):
        if not len(live):
            break
        s, u, k = sigma[live], mu[live], n[live]
        g = s[:, None] @ inverses(s, ridge)  # regression of all columns on the observed ones
        fill = np.where(m[None, :, :, None] > 0, (eye * m[:, None, :])[None], g)
        a = np.where(m[None] > 0, 0.0, u[:, None] - (g @ (u[:, None] * m)[..., None])[..., 0])
        bs = (fill @ sums[live][..., None])[..., 0]
        left = (1 - m)[:, :, None] * (1 - m)[:, None, :] * (s[:, None] - g @ (s[:, None] * m[:, :, None]))
        sx = (bs + k[..., None] * a).sum(1)
        ba = bs[..., :, None] * a[..., None, :]
        sxx = (fill @ products[live] @ np.swapaxes(fill, 2, 3) + ba + np.swapaxes(ba, 2, 3) + k[..., None, None] * (a[..., :, None] * a[..., None, :] + left)).sum(1)
        mu2 = sx / total[live][:, None]
        sigma2 = sxx / total[live][:, None, None] - mu2[:, :, None] * mu2[:, None, :]
        sigma2 = (sigma2 + np.swapaxes(sigma2, 1, 2)) / 2 + ridge * eye
        change = np.maximum(np.abs(mu2 - u).max(1), np.abs(sigma2 - s).max((1, 2)))
        mu[live], sigma[live] = mu2, sigma2
        converged[live[change < 1e-8]] = True
        live = live[change >= 1e-8]
    diff = np.where(n[..., None] > 0, sums / np.maximum(n, 1.0)[..., None] - mu[:, None] * m, 0.0)
    d2 = (n * (diff[..., None, :] @ inverses(sigma, 0.0) @ diff[..., :, None])[..., 0, 0]).sum(1)
    df = ((n > 0) @ m.sum(1)).astype(int) - p
    tested = (n_patterns >= 2) & (df > 0)
    value = np.array([chi_square_sf(x, k) if t else math.nan for x, k, t in zip(d2, df, tested)])
    return {"d2": np.where(n_patterns >= 2, d2, math.nan), "df": np.where(n_patterns >= 2, df, 0), "p_value": value, "n_patterns": n_patterns, "mcar": ~(value < 0.05), "converged": converged | (n_patterns < 2)}


#: Comparison levels of a pair's three fields by the number of the triple.
TRIPLES = np.stack(np.unravel_index(np.arange(125), (5, 5, 5)), axis=1)


def linkage_fits(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of a match by triple (c, 125), share of matches (c)) of many data sets at once.

    weights (c, 125): how many pairs show each triple of comparison levels. A model of two classes with fields that are
    independent within a class is fitted by expectation maximisation; those that have converged rest.
    """
    hot = np.stack([TRIPLES[:, f][:, None] == np.arange(5) for f in range(3)], axis=1).reshape(125, 15).astype(float)
    c = len(weights)
    start = 0.5 ** np.arange(5) / (0.5 ** np.arange(5)).sum()
    pi, m, u = np.full(c, 0.05), np.tile(np.tile(start, 3), (c, 1)), np.full((c, 15), 0.2)
    before, post = np.full(c, -np.inf), np.full((c, 125), 0.05)
    live = np.nonzero(weights.sum(1) > 0)[0]
    log = lambda x: np.log(np.maximum(x, 1e-300))
    for _ in range(200):
        if not len(live):
            break
        w = weights[live]
        a = log(pi[live])[:, None] + log(m[live]) @ hot.T
        b = log(1 - pi[live])[:, None] + log(u[live]) @ hot.T
        either = np.logaddexp(a, b)
        post[live] = np.exp(a - either)
        ll = (w * either).sum(1)
        wp, wq = w * post[live], w * (1 - post[live])
        yes, no = wp.sum(1), wq.sum(1)
        pi[live] = yes / w.sum(1)
        m[live] = np.where(yes[:, None] > 0, wp @ hot / np.maximum(yes, 1e-300)[:, None], 0.2)
        u[live] = np.where(no[:, None] > 0, wq @ hot / np.maximum(no, 1e-300)[:, None], 0.2)
        done = np.abs(ll - before[live]) < 1e-8 * np.maximum(1.0, np.abs(ll))
        before[live] = ll
        live = live[~done]
    return post, pi
