"""Statistics that neither Spark nor numpy has: normal quantiles, STL."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _loess(x: np.ndarray, y: np.ndarray, w: np.ndarray, span: int, at: np.ndarray, degree: int = 1) -> np.ndarray:
    """Local regression at each of ``at`` over the ``span`` nearest points with tricube weights."""
    n, q = len(x), min(span, len(x))
    d = np.abs(x[None, :] - at[:, None])
    far = np.maximum(np.partition(d, q - 1, axis=1)[:, q - 1] * max(1.0, span / n), 1e-12)
    k = w * np.clip(1 - (d / far[:, None]) ** 3, 0, None) ** 3
    total = k.sum(1)
    safe = np.where(total > 0, total, 1.0)
    mx, my = (k @ x) / safe, (k @ y) / safe
    dx = x[None, :] - mx[:, None]
    vx = (k * dx * dx).sum(1)
    slope = np.where((vx > 1e-12) & bool(degree), (k * dx * (y[None, :] - my[:, None])).sum(1) / np.where(vx > 1e-12, vx, 1.0), 0.0)
    return np.where(total > 0, my + slope * (at - mx), y.mean())


def stl(y: np.ndarray, season: int, seasonal: int = 7, inner: int = 2, outer: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal part and rest by robust seasonal-trend decomposition with loess (Cleveland et al., 1990)."""
    n = len(y)
    x = np.arange(n, dtype=float)
    wide = int(np.ceil(1.5 * season / (1 - 1.5 / seasonal)))
    wide += 1 - wide % 2
    low = season + 1 - season % 2
    w, trend, seas = np.ones(n), np.zeros(n), np.zeros(n)
    for _ in range(outer):
        for _ in range(inner):
            flat = y - trend
            cyc = np.empty(n + 2 * season)
            for p in range(season):
                own = np.arange(p, n, season)
                k = np.arange(len(own), dtype=float)
                cyc[p :: season][: len(own) + 2] = _loess(k, flat[own], w[own], seasonal, np.arange(-1, len(own) + 1, dtype=float))
            m = np.convolve(np.convolve(np.convolve(cyc, np.ones(season) / season, "valid"), np.ones(season) / season, "valid"), np.ones(3) / 3, "valid")
            seas = cyc[season : season + n] - _loess(np.arange(len(m), dtype=float), m, np.ones(len(m)), low, np.arange(len(m), dtype=float))[:n]
            trend = _loess(x, y - seas, w, wide, x)
        rest = y - trend - seas
        h = 6 * np.median(np.abs(rest))
        w = np.clip(1 - (np.abs(rest) / h) ** 2, 0, None) ** 2 if h > 0 else np.ones(n)
    return trend, seas, y - trend - seas
