"""Seasonal-trend decomposition by local regression of one series, as numpy arrays."""

from __future__ import annotations

import numpy as np


def local_fit(y: np.ndarray, at: np.ndarray, span: int, degree: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Local constant (degree 0) or line (1) through the ``span`` nearest of the points 1 to n, at the places ``at``.

    Tricube weights over the distance of the furthest point, which grows if the span is longer than the
    series. NaN where all weights are 0.
    """
    n = len(y)
    size = min(span, n)
    first = np.clip(at - (span + 1) // 2 + 1, 1, n - size + 1).astype(int) if span < n else np.ones(len(at), int)
    x = first[:, None] + np.arange(size)
    far = np.maximum(at - first, first + size - 1 - at) + (max(span - n, 0) // 2)
    gap = np.abs(x - at[:, None])
    scaled = np.divide(gap, far[:, None], out=np.zeros(gap.shape), where=far[:, None] > 0)
    w = np.where(gap <= 0.001 * far[:, None], 1.0, (1 - scaled**3) ** 3)
    w = np.where(gap <= 0.999 * far[:, None], w, 0.0)
    if weight is not None:
        w = w * weight[x - 1]
    total = w.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = w / total[:, None]
        if degree:
            centre = (w * x).sum(1)
            spread = (w * (x - centre[:, None]) ** 2).sum(1)
            tilt = np.where(np.sqrt(spread) > 0.001 * (n - 1), (at - centre) / spread, 0.0)
            w = w * (1 + tilt[:, None] * (x - centre[:, None]))
        return np.where(total > 0, (w * y[x - 1]).sum(1), np.nan)


def moving_mean(y: np.ndarray, size: int) -> np.ndarray:
    sums = np.cumsum(np.append(0.0, y))
    return (sums[size:] - sums[:-size]) / size


def seasonal_trend(
    y: np.ndarray, period: int, season_span: int, trend_span: int, low_span: int, inner: int, robust: int
) -> tuple[np.ndarray, np.ndarray]:
    """(trend, season) after ``inner`` passes, and as many again for each of the ``robust`` rounds of new weights."""
    n = len(y)
    places = np.arange(1, n + 1)
    trend, weight = np.zeros(n), None
    season = np.zeros(n)
    for round_ in range(robust + 1):
        for _ in range(inner):
            cycle = np.empty(n + 2 * period)
            detrended = y - trend
            for m in range(period):
                own = detrended[m::period]
                at = np.arange(len(own) + 2)
                fit = local_fit(own, at, season_span, 0, None if weight is None else weight[m::period])
                # where every weight is 0 the value stays; at the ends, its neighbour's
                fit[1:-1] = np.where(np.isnan(fit[1:-1]), own, fit[1:-1])
                fit[0], fit[-1] = (fit[i] if np.isnan(fit[j]) else fit[j] for i, j in ((1, 0), (-2, -1)))
                cycle[m::period] = fit
            low = moving_mean(moving_mean(moving_mean(cycle, period), period), 3)
            season = cycle[period : period + n] - local_fit(low, places, low_span, 1)
            rest = y - season
            fit = local_fit(rest, places, trend_span, 1, weight)
            trend = np.where(np.isnan(fit), rest, fit)
        if round_ < robust:
            size = np.abs(y - trend - season)
            limit = 6 * np.median(size)
            share = np.divide(size, limit, out=np.zeros(n), where=limit > 0)
            weight = np.where(size <= 0.001 * limit, 1.0, np.where(size <= 0.999 * limit, (1 - share**2) ** 2, 0.0))
    return trend, season
