"""Vectorised numeric helpers that Spark has no function for."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def norm_ppf(u: np.ndarray) -> np.ndarray:
    """Standard normal quantile; 0 and 1 give infinities, outside or nan: nan.

    Equal values are computed once.
    """
    u = np.asarray(u, dtype=float)
    out = np.full(u.shape, np.nan)
    out[u == 0], out[u == 1] = -np.inf, np.inf
    inside = (u > 0) & (u < 1)
    distinct, back = np.unique(u[inside], return_inverse=True)
    inverse = NormalDist().inv_cdf
    out[inside] = np.array([inverse(float(p)) for p in distinct])[back] if distinct.size else []
    return out


def _beta_fraction(a: np.ndarray, b: np.ndarray | float, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Continued fraction of the incomplete beta function by Lentz's method."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, rounds):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def t_two_sided(t: np.ndarray, dof: np.ndarray | float) -> np.ndarray:
    """Two-sided p-value of Student's t; nan where t is nan or there is no degree of freedom."""
    t, dof = np.broadcast_arrays(np.asarray(t, float), np.asarray(dof, float))
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(dof) & (dof > 0) & ~np.isnan(t)
    out[ok & np.isinf(t)] = 0.0
    ok &= np.isfinite(t)
    if not ok.any():
        return out
    v, x = dof[ok], dof[ok] / (dof[ok] + t[ok] ** 2)
    a, b = v / 2, 0.5
    lead = np.array([math.lgamma(y + b) - math.lgamma(y) - math.lgamma(b) for y in a])
    with np.errstate(divide="ignore"):
        front = np.exp(lead + a * np.log(x) + b * np.log1p(-x))
    direct = x < (a + 1) / (a + b + 2)
    p = np.empty_like(x)
    p[direct] = (front * _beta_fraction(a, b, np.where(direct, x, 0.5)) / a)[direct]
    far = ~direct
    if far.any():
        p[far] = 1 - front[far] * _beta_fraction(np.full(int(far.sum()), b), a[far], 1 - x[far]) / b
    out[ok] = np.clip(p, 0, 1)
    return out


def t_quantile(p: float, dof: float) -> float:
    """Quantile of Student's t by bisection; nan without a degree of freedom."""
    if not dof > 0:
        return math.nan
    if p < 0.5:
        return -t_quantile(1 - p, dof)
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        if 1 - float(t_two_sided(np.array([mid]), dof)[0]) / 2 < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted non-decreasing least-squares fit."""
    blocks: list[list[float]] = []
    for v, w in zip(np.asarray(values, float), np.asarray(weights, float), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.array([v for v, _, n in blocks for _ in range(int(n))])


def elastic_net(gram: np.ndarray, moment: np.ndarray, penalty: float, l1_ratio: float, factors: np.ndarray | None = None, start: np.ndarray | None = None, rounds: int = 5000, tolerance: float = 1e-9) -> np.ndarray:
    """Coefficients that minimise b'Gb/2 - b'm + penalty * sum_j f_j (l1|b_j| + (1-l1) b_j^2 / 2), by coordinate descent.

    `gram` and `moment` are averages over the (weighted) rows, so no row is needed; a factor of 0 leaves a coefficient unpenalised.
    """
    p = len(moment)
    f = np.ones(p) if factors is None else np.asarray(factors, float)
    b = np.zeros(p) if start is None else np.array(start, float)
    slope = gram @ b
    for _ in range(rounds):
        largest = 0.0
        for j in range(p):
            curve = gram[j, j] + penalty * f[j] * (1 - l1_ratio)
            if curve <= 0:
                continue
            rho = moment[j] - slope[j] + gram[j, j] * b[j]
            new = math.copysign(max(abs(rho) - penalty * f[j] * l1_ratio, 0.0), rho) / curve
            if new != b[j]:
                slope += gram[:, j] * (new - b[j])
                largest = max(largest, abs(new - b[j]))
                b[j] = new
        if largest < tolerance:
            break
    return b


def two_gaussians(x: np.ndarray, n: np.ndarray | None = None, inner: np.ndarray | None = None, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, standard deviations and shares of a two-component mixture, lower mean first; EM from the quartiles.

    x: ascending if they are means of bins with `n` values each and a variance `inner` inside.
    """
    x = np.asarray(x, float)
    if n is None:
        x, n = np.sort(x), np.ones(len(x))
    mean, sd, share = gaussian_pairs(np.zeros(1, int), x, n, np.zeros(len(x)) if inner is None else inner, rounds)
    return mean[:, 0], sd[:, 0], share[:, 0]


def gaussian_pairs(starts: np.ndarray, x: np.ndarray, n: np.ndarray, inner: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`two_gaussians` of many groups at once, as arrays (2, groups): a group's ascending bins begin at its start; each ends its rounds by itself."""
    upto, of = np.cumsum(n), np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    upto, total = upto - (upto - n)[starts][of], np.add.reduceat(n, starts)
    at = lambda i: x[starts + np.add.reduceat((upto <= i[of]).astype(int), starts)]
    place = np.array([[0.25], [0.75]]) * (total - 1)
    low, high = (np.stack([at(i) for i in f(place)]) for f in (np.floor, np.ceil))
    mean = low + (place - np.floor(place)) * (high - low)
    mean += np.where(mean[0] == mean[1], [[-1e-3], [1e-3]], 0.0)
    middle = np.add.reduceat(n * x, starts) / total
    sd = np.tile(np.maximum(np.sqrt(np.add.reduceat(n * ((x - middle[of]) ** 2 + inner), starts) / total), 1e-3), (2, 1))
    share = np.full_like(mean, 0.5)
    out, left = np.stack([mean, sd, share]), np.arange(len(starts))
    for _ in range(rounds):
        log = (np.log(share) - np.log(sd))[:, of] - (x - mean[:, of]) ** 2 / (2 * sd**2)[:, of]
        r = np.exp(log - log.max(axis=0))
        r *= n / r.sum(axis=0)
        each = np.add.reduceat(r, starts, axis=1) + 1e-12
        new = np.add.reduceat(r * x, starts, axis=1) / each
        sd = np.sqrt(np.add.reduceat(r * ((x - new[:, of]) ** 2 + inner), starts, axis=1) / each + 1e-6)
        share, moving, mean = each / each.sum(axis=0), ~(np.abs(new - mean).max(axis=0) < 1e-10), new
        if not moving.all():
            out[:, :, left] = mean, sd, share
            left, stay, size = left[moving], moving[of], np.diff(np.append(starts, len(x)))[moving]
            if not len(left):
                break
            x, n, inner, mean, sd, share = x[stay], n[stay], inner[stay], mean[:, moving], sd[:, moving], share[:, moving]
            starts, of = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    out[:, :, left] = mean[:, : len(left)], sd[:, : len(left)], share[:, : len(left)]
    order = np.argsort(out[0], axis=0)
    mean, sd, share = (np.take_along_axis(v, order, axis=0) for v in out)
    return mean, sd, share
