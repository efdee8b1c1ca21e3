"""Exact Gaussian likelihood of a regression with autoregressive errors, for many series at once.

The likelihood of ``y = c + beta x + u`` with an autoregression of order p for u depends on
the data through the (p + 1) by (p + 1) sums of products of the series with themselves,
cut at both ends: with g = (1, -phi), minus twice its logarithm is
n log(g' D g / n) - sum over j of j log(1 - r_j^2), where D belongs to u and the r are the
partial autocorrelations that phi follows from. Coefficients and
likelihood thus come from a few numbers a series, and the data are read once.

Passes alternate: the slope and level for fixed r are weighted least squares in those sums;
phi is linear in each r, so each r for fixed others is the one root in (-1, 1) of a cubic. No
pass lowers the likelihood.
"""

from __future__ import annotations

import numpy as np

#: A determinant or pivot below this share of its size counts as 0.
TOLERANCE = 1e-12
SERIES = ("y", "x")


def product_sums(products: dict[tuple[str, str], np.ndarray], first: dict[str, np.ndarray], last: dict[str, np.ndarray], n: np.ndarray):
    """``D[a, b][row, i, j]``, the sum over k of a[i + k] b[j + k] for as many k as both ends leave.

    ``products[a, b][row, h]`` is the sum of a(t - h) b(t); ``first`` and ``last`` hold the outermost
    values (the last one first). The constant series "1" is added.
    """
    rows, size = next(iter(products.values())).shape
    one = np.ones((rows, size))
    first, last = first | {"1": one}, last | {"1": one}
    out = {}
    for a in (*SERIES, "1"):
        for b in (*SERIES, "1"):
            d = np.zeros((rows, size, size))
            for i in range(size):
                for j in range(i, size):
                    h = j - i
                    if a == b == "1":
                        total = np.maximum(n - i - j, 0).astype(float)
                    else:
                        if (a, b) in products:
                            total = products[a, b][:, h].copy()
                        elif b == "1":  # the sum of a but for its last h values; the series have mean 0
                            total = -last[a][:, :h].sum(1)
                        else:
                            total = -first[b][:, :h].sum(1)
                        for k in range(i):
                            total -= first[a][:, k] * first[b][:, k + h]
                            total -= last[a][:, k + h] * last[b][:, k]
                    d[:, i, j] = total
            out[a, b] = d
    below = np.tril(np.ones((size, size), bool), -1)
    return {(a, b): np.where(below, np.swapaxes(out[b, a], 1, 2), out[a, b]) for a, b in out}


def weights(r: np.ndarray) -> np.ndarray:
    """(1, -phi) from partial autocorrelations."""
    rows, p = r.shape
    phi = np.zeros((rows, p))
    for k in range(p):
        before = phi[:, :k].copy()
        phi[:, :k] = before - r[:, k : k + 1] * before[:, ::-1]
        phi[:, k] = r[:, k]
    return np.concatenate([np.ones((rows, 1)), -phi], axis=1)


def form(a: np.ndarray, d: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ri,rij,rj->r", a, d, b)


def inner_root(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray, j: int) -> np.ndarray:
    """The root in (-1, 1) of n (a r - b) (1 - r^2) + j r (a r^2 - 2 b r + c): the middle one of three."""
    fine = a > TOLERANCE * np.abs(c)
    a, b, c = np.where(fine, a, 1.0), np.where(fine, b, 0.0), np.where(fine, c, 1.0)
    k3, k2, k1, k0 = (j - n) * a, (n - 2 * j) * b, n * a + j * c, -n * b
    shift = k2 / (3 * k3)
    p = k1 / k3 - 3 * shift * shift
    q = 2 * shift**3 - shift * k1 / k3 + k0 / k3
    span = np.sqrt(np.maximum(-p / 3, 0))
    angle = np.arccos(np.clip(-q / 2 / np.maximum(span**3, 1e-300), -1, 1))
    root = 2 * span * np.cos(angle / 3 - 2 * np.pi / 3) - shift
    for _ in range(3):
        slope = 3 * k3 * root * root + 2 * k2 * root + k1
        root = root - (((k3 * root + k2) * root + k1) * root + k0) / np.where(slope == 0, 1.0, slope)
    return np.where(fine, np.clip(root, -1 + 1e-12, 1 - 1e-12), 0.0)


def fit_order(d: dict, n: np.ndarray, p: int, with_x: bool, steps: int, tolerance: float):
    """Level, slope, partial autocorrelations, sum of squares, -2 log likelihood, last change, passes used."""
    rows = len(n)
    cut = {key: m[:, : p + 1, : p + 1] for key, m in d.items()}
    r = np.zeros((rows, p))
    c, beta, change, used = np.zeros(rows), np.zeros(rows), np.full(rows, np.inf), np.zeros(rows, np.int64)
    for _ in range(steps):
        g = weights(r)
        q = {key: form(g, m, g) for key, m in cut.items()}
        det = q["1", "1"] * q["x", "x"] - q["1", "x"] ** 2
        usable = with_x & (det > TOLERANCE * q["1", "1"] * q["x", "x"])
        slope = (q["1", "1"] * q["x", "y"] - q["1", "x"] * q["1", "y"]) / np.where(usable, det, 1.0)
        new_beta = np.where(usable, slope, 0.0)
        new_c = (q["1", "y"] - new_beta * q["1", "x"]) / np.where(q["1", "1"] > 0, q["1", "1"], 1.0)
        u = residual_sums(cut, new_c, new_beta)
        new_r = r.copy()
        for j in range(p):
            low, high = new_r.copy(), new_r.copy()
            low[:, j], high[:, j] = 0.0, 1.0
            g0 = weights(low)
            g1 = weights(high) - g0
            new_r[:, j] = inner_root(form(g1, u, g1), -form(g0, u, g1), form(g0, u, g0), n, j + 1)
        change = np.maximum(
            np.abs(new_beta - beta) / np.maximum(np.abs(new_beta), 1e-8), np.abs(new_r - r).max(1) if p else 0.0
        )
        c, beta, r = new_c, new_beta, new_r
        used += change > tolerance
    u = residual_sums(cut, c, beta)
    g = weights(r)
    sse = np.maximum(form(g, u, g), 0.0)
    floor = np.maximum(sse, d["y", "y"][:, 0, 0] * 1e-15)
    with np.errstate(divide="ignore"):
        deviance = n * np.log(floor / n) - sum((j + 1) * np.log1p(-r[:, j] ** 2) for j in range(p))
    return c, beta, r, sse, deviance, change, used


def residual_sums(cut: dict, c: np.ndarray, beta: np.ndarray) -> np.ndarray:
    c, b = c[:, None, None], beta[:, None, None]
    return (
        cut["y", "y"]
        - c * (cut["y", "1"] + cut["1", "y"])
        - b * (cut["y", "x"] + cut["x", "y"])
        + c * c * cut["1", "1"]
        + c * b * (cut["1", "x"] + cut["x", "1"])
        + b * b * cut["x", "x"]
    )


def best_order(d: dict, n: np.ndarray, max_p: int, with_x: bool, steps: int, tolerance: float) -> dict[str, np.ndarray]:
    """The order of smallest information criterion of each row, the lower one where equal, and its fit.

    Orders that leave no degree of freedom, or have more coefficients than the ends leave products, are no candidates.
    """
    rows, k = len(n), 2 if with_x else 1
    out = {
        "p": np.zeros(rows, np.int64),
        "aic": np.full(rows, np.inf),
        "c": np.zeros(rows),
        "beta": np.zeros(rows),
        "phi": np.zeros((rows, max_p)),
        "sse": np.zeros(rows),
        "used": np.zeros(rows, np.int64),
        "converged": np.zeros(rows, bool),
    }
    for p in range(max_p + 1):
        c, beta, r, sse, deviance, change, used = fit_order(d, n, p, with_x, steps, tolerance)
        aic = np.where((n > p + k) & (n > 2 * p + 1), deviance + 2 * (p + k + 1), np.inf)
        better = aic < out["aic"]
        phi = np.zeros((rows, max_p))
        phi[:, :p] = -weights(r)[:, 1:]
        made = {"p": np.full(rows, p), "aic": aic, "c": c, "beta": beta, "phi": phi, "sse": sse, "used": used, "converged": change <= tolerance}
        for name, value in made.items():
            out[name] = np.where(better[:, None] if value.ndim > 1 else better, value, out[name])
    return out
