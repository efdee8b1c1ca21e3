"""Autoregressive moving-average models by conditional least squares, for a batch of series at once.

e(t) = y(t) - c - sum of phi_j y(t - j) - sum of theta_j e(t - j), with e = 0 before the first month that is scored. Its
derivatives follow the same recursion, so one pass over the months gives the sum of squares and the
normal equations of a Gauss-Newton step. A step that raises the sum is halved; one that leaves the
invertible models ends at their border. Series are fitted at mean 0 and deviation 1.
"""

from __future__ import annotations

import numpy as np

#: Partial coefficients of the moving average stay below this.
INVERTIBLE = 0.98


def score(y: np.ndarray, n: np.ndarray, params: np.ndarray, p: int, q: int, start: int):
    """Sum of squares, normal matrix and right side of each row, and the last ``q`` residuals, newest first. Months ``start`` and later count."""
    rows, k = params.shape
    c, phi, theta = params[:, 0], params[:, 1 : 1 + p], params[:, 1 + p :]
    sse, normal, right = np.zeros(rows), np.zeros((rows, k, k)), np.zeros((rows, k))
    e, g = np.zeros((rows, max(q, 1))), np.zeros((rows, max(q, 1), k))
    for t in range(start, y.shape[1]):
        on = t < n
        before = y[:, t - p : t][:, ::-1]
        new = y[:, t] - c - (phi * before).sum(1) - (theta * e[:, :q]).sum(1)
        slope = np.concatenate([-np.ones((rows, 1)), -before, -e[:, :q]], axis=1)
        if q:
            slope = slope - np.einsum("rj,rjk->rk", theta, g)
        new, slope = np.where(on, new, 0.0), np.where(on[:, None], slope, 0.0)
        sse += new * new
        normal += slope[:, :, None] * slope[:, None, :]
        right += slope * new[:, None]
        if q:
            e = np.where(on[:, None], np.concatenate([new[:, None], e[:, :-1]], axis=1), e)
            g = np.where(on[:, None, None], np.concatenate([slope[:, None], g[:, :-1]], axis=1), g)
    return sse, normal, right, e[:, :q]


def partials(theta: np.ndarray) -> np.ndarray:
    """The largest partial coefficient of 1 + theta_1 z + ..., in absolute value; below 1 where it is invertible."""
    most, a = np.zeros(len(theta)), -theta
    for k in range(theta.shape[1], 0, -1):
        last = a[:, k - 1 : k]
        most = np.maximum(most, np.abs(last[:, 0]))
        lower = np.where(np.abs(last) < 1, 1 - last**2, 1.0)
        a = (a[:, : k - 1] + last * a[:, : k - 1][:, ::-1]) / lower
    return most


def inside(theta: np.ndarray) -> np.ndarray:
    """``theta`` with its roots drawn back as far as INVERTIBLE asks, theta_j by the j-th power of one factor."""
    if theta.shape[1] == 1:
        return np.clip(theta, -INVERTIBLE, INVERTIBLE)
    powers = np.arange(1, theta.shape[1] + 1)
    low, high = np.zeros(len(theta)), np.ones(len(theta))
    for _ in range(50):
        middle = (low + high) / 2
        fits = partials(theta * middle[:, None] ** powers) <= INVERTIBLE
        low, high = np.where(fits, middle, low), np.where(fits, high, middle)
    free = partials(theta) <= INVERTIBLE
    return np.where(free[:, None], theta, theta * low[:, None] ** powers)


def fit_order(y: np.ndarray, n: np.ndarray, p: int, q: int, start: int, passes: int):
    """Parameters (c, phi, theta), their sum of squares and last residuals, and the relative size of the next step."""
    rows, k = len(y), 1 + p + q
    counted = (np.arange(y.shape[1]) >= start) & (np.arange(y.shape[1]) < n[:, None])
    base = np.zeros((rows, k))
    base[:, 0] = (y * counted).sum(1) / np.maximum(counted.sum(1), 1)
    least, step, scale, shocks = np.full(rows, np.inf), np.zeros((rows, k)), np.ones(rows), np.zeros((rows, q))
    for pass_ in range(passes):
        tried = base + scale[:, None] * step
        if q:
            tried[:, 1 + p :] = inside(tried[:, 1 + p :])
        with np.errstate(over="ignore", invalid="ignore"):
            sse, normal, right, last = score(y, n, tried, p, q, start)
        # near the minimum rounding decides which sum is smaller; steps are taken there as they are
        better = sse <= least * (1 + 1e-9)
        base, least = np.where(better[:, None], tried, base), np.where(better, sse, least)
        shocks = np.where(better[:, None], last, shocks)
        # without moving-average terms residuals and values tell the same: the first step is that of the
        # autoregression. At the limit, terms that would go on stay where they are.
        theta = tried[:, 1 + p :]
        still = (partials(theta) > INVERTIBLE * (1 - 1e-12)) & ((-right[:, 1 + p :] * theta).sum(1) > 0) if pass_ else np.ones(rows, bool)
        normal[still, 1 + p :], right[still, 1 + p :] = 0.0, 0.0
        normal[still, :, 1 + p :] = 0.0
        if better.any():
            inverse = np.linalg.pinv(normal[better], rcond=1e-12, hermitian=True)
            step[better] = -np.einsum("rij,rj->ri", inverse, right[better])
        scale = np.where(better, 1.0, scale / 2)
    change = (np.abs(scale[:, None] * step) / (1 + np.abs(base))).max(1)
    return base, least, shocks, change


def best_order(y: np.ndarray, n: np.ndarray, max_p: int, max_q: int, passes: int, tolerance: float) -> dict[str, np.ndarray]:
    """The order of smallest information criterion of each row; where equal, the one with the smaller p, then q."""
    rows, m = len(y), n - max_p
    known = np.arange(y.shape[1]) < n[:, None]
    mean = (y * known).sum(1) / n
    deviation = np.sqrt(((y - mean[:, None]) ** 2 * known).sum(1) / n)
    deviation = np.where(deviation > 0, deviation, 1.0)
    y = np.where(known, (y - mean[:, None]) / deviation[:, None], 0.0)
    out = {
        "p": np.zeros(rows, np.int64), "q": np.zeros(rows, np.int64), "aic": np.full(rows, np.inf), "c": np.zeros(rows),
        "phi": np.zeros((rows, max_p)), "theta": np.zeros((rows, max_q)), "shocks": np.zeros((rows, max_q)),
        "sse": np.zeros(rows), "converged": np.zeros(rows, bool),
    }
    for p in range(max_p + 1):
        for q in range(max_q + 1):
            params, sse, shocks, change = fit_order(y, n, p, q, max_p, passes)
            k, sse = 1 + p + q, sse * deviation**2
            with np.errstate(divide="ignore", invalid="ignore"):
                aic = np.where(m > k, m * np.log(sse / np.maximum(m, 1)) + 2 * (k + 1), np.inf)
            better = aic < out["aic"]
            pad = lambda a, size: np.pad(a, ((0, 0), (0, size - a.shape[1])))
            made = {
                "p": np.full(rows, p), "q": np.full(rows, q), "aic": aic, "c": params[:, 0] * deviation + mean * (1 - params[:, 1 : 1 + p].sum(1)), "phi": pad(params[:, 1 : 1 + p], max_p),
                "theta": pad(params[:, 1 + p :], max_q), "shocks": pad(shocks * deviation[:, None], max_q), "sse": sse, "converged": change <= tolerance,
            }
            for name, value in made.items():
                out[name] = np.where(better[:, None] if value.ndim > 1 else better, value, out[name])
    return out
