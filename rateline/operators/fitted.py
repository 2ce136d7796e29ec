"""Models whose fit is iterative and that arrays of Spark cannot hold well, in one function over whole series (MOD10, MOD11, MOD13, BT5): a series is shipped to Python once, and a form that several models choose from is fitted once. SES, Holt, DampedHolt and Theta are in ``smoothing``, and their folds and forecasts are joined to these here.

Given the weights, one-step errors are linear in the first level, slope and
additive season, so these come from normal equations; a multiplicative season
starts from the first cycle. Weights minimise the squared one-step errors on a
coarse grid, and then one at a time around the best so far, at a distance that
is halved in each round. AICc is n ln(SSE / n) + 2k with the small-sample term,
so forms of one series can be compared with each other.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..shipping import ship
from . import backtest as T
from . import smoothing as S

#: Coarse weights: level, trend, season, damping; how far apart they lie, and bounds.
GRID = (0.05, 0.2, 0.4, 0.6, 0.8, 0.95), (0.05, 0.35, 0.65, 0.95), (0.05, 0.35, 0.65, 0.95), (0.8, 0.9, 0.98)
GAPS, LOWEST, HIGHEST, ROUNDS = np.array([0.2, 0.3, 0.3, 0.08]), np.array([0.001, 0.001, 0.001, 0.7]), np.array([0.999, 0.999, 0.999, 0.995]), 6
#: Share of a normal matrix's size that is added where level and season cannot be told apart.
RIDGE = 1e-10


@dataclass(frozen=True)
class Shape:
    """A form of smoothing with additive errors; ``season``: none, add or mul."""

    trend: bool = False
    damped: bool = False
    season: str | None = None

    def weights(self) -> np.ndarray:
        axes = [GRID[0], GRID[1] if self.trend else (0.0,), GRID[2] if self.season else (0.0,), GRID[3] if self.damped else (1.0,) if self.trend else (0.0,)]
        return np.array(list(itertools.product(*axes)))

    def free(self) -> list[int]:
        """Which of the four weights are fitted."""
        return [i for i, on in enumerate((True, self.trend, bool(self.season), self.damped)) if on]

    def n_fitted(self, m: int) -> int:
        """Weights and first states."""
        return 2 + 2 * self.trend + self.damped + (1 + m if self.season else 0)


def _passed(y: np.ndarray, p: np.ndarray, stops: set[int], m: int, shape: Shape) -> dict[int, tuple]:
    """State and products of errors for weights ``p`` (k x 4) after each number of values of ``stops``, additive forms.

    States are kept for each of several starts at once: zero, and one for each
    unknown of the first state, whose errors say what that unknown adds.
    """
    a, b, g, phi = (p[:, i, None] for i in range(4))
    size = 1 + shape.trend + (m if shape.season else 0)
    x = np.zeros((len(p), size, 1 + size))
    x[:, np.arange(size), 1 + np.arange(size)] = 1.0
    products, kept, at = np.zeros((len(p), 1 + size, 1 + size)), {}, 1 + shape.trend
    for t in range(max(stops)):
        if t in stops:
            kept[t] = x.copy(), products.copy()
        s = at + t % m if shape.season else None
        slope = phi * x[:, 1] if shape.trend else 0.0
        base = x[:, 0] + slope
        e = -(base if s is None else base + x[:, s])
        e[:, 0] += y[t]
        products += e[:, :, None] * e[:, None, :]
        x[:, 0] = base + a * e
        if shape.trend:
            x[:, 1] = slope + a * b * e
        if s is not None:
            x[:, s] += g * (1 - a) * e
    kept[max(stops)] = x, products
    return kept


def _solved(products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first states of least squared error for each set of weights, and that error."""
    normal, right = products[:, 1:, 1:], -products[:, 1:, 0]
    ridge = RIDGE * np.trace(normal, axis1=1, axis2=2)[:, None, None] * np.eye(normal.shape[1])
    first = np.linalg.solve(normal + ridge, right[..., None])[..., 0]
    sse = products[:, 0, 0] - 2 * np.einsum("ki,ki->k", first, right) + np.einsum("ki,kij,kj->k", first, normal, first)
    return first, np.where(np.isfinite(sse), np.maximum(sse, 0.0), np.inf)


def _multiplied(y: np.ndarray, p: np.ndarray, stops: set[int], m: int, shape: Shape) -> dict[int, tuple]:
    """Squared errors and states of forms with a multiplicative season, from the first cycle's level and season."""
    a, b, g, phi = p.T
    start = y[:m].mean()
    level, slope = np.full(len(p), start), np.full(len(p), (y[m : 2 * m].mean() - start) / m if shape.trend and len(y) >= 2 * m else 0.0)
    season, sse, kept = [np.full(len(p), v / max(start, 1e-12)) for v in y[:m]], np.zeros(len(p)), {}
    safe = lambda v: np.where(np.abs(v) < 1e-9, 1e-9, v)
    for t in range(max(stops)):
        if t in stops:
            kept[t] = sse, level, slope, list(season)
        base, s = level + phi * slope, season[t % m]
        e = y[t] - base * s
        sse = sse + e * e
        old, level = level, a * y[t] / safe(s) + (1 - a) * base
        slope = b * (level - old) + (1 - b) * phi * slope
        season[t % m] = g * y[t] / safe(level) + (1 - g) * s
    kept[max(stops)] = sse, level, slope, season
    return kept


def _errors_at(y: np.ndarray, p: np.ndarray, stops: list[int], m: int, shape: Shape) -> np.ndarray:
    """Squared errors (weights x stops) with the best first states."""
    if shape.season == "mul":
        got = _multiplied(y, p, set(stops), m, shape)
        return np.column_stack([np.where(np.isfinite(got[n][0]), got[n][0], np.inf) for n in stops])
    got = _passed(y, p, set(stops), m, shape)
    return np.column_stack([_solved(got[n][1])[1] for n in stops])


def best_weights(y: np.ndarray, stops: list[int], m: int, shape: Shape) -> np.ndarray:
    """Weights (stops x 4) of least squared error on each beginning of ``y`` that ends at one of ``stops``; all are tried on all beginnings in one pass a round, since what is smoothed so far does not depend on what comes."""
    grid, rows = shape.weights(), np.arange(len(stops))
    sse = _errors_at(y, grid, stops, m, shape)
    at = sse.argmin(0)
    best, least = grid[at], sse[at, rows]
    moves = [d for i in shape.free() for d in (np.eye(4)[i], -np.eye(4)[i])]
    for k in range(1, ROUNDS + 1):
        near = np.concatenate([np.clip(best + d * GAPS * 0.5**k, np.where(d != 0, LOWEST, -np.inf), np.where(d != 0, HIGHEST, np.inf)) for d in moves])
        own = np.tile(rows, len(moves))
        sse = _errors_at(y, near, stops, m, shape)[np.arange(len(near)), own].reshape(len(moves), -1)
        at = sse.argmin(0)
        better = sse[at, rows] < least
        best = np.where(better[:, None], near.reshape(len(moves), -1, 4)[at, rows], best)
        least = np.where(better, sse[at, rows], least)
    return best


def smoothing_at(y: np.ndarray, stops: list[int], m: int = 1, shape: Shape = Shape()) -> dict[int, dict]:
    """The best fit of a form on each beginning of ``y`` that ends at one of ``stops``: forecasts ahead, weights, squared error, AICc, first states. Each beginning must hold two seasons, or four values."""
    zero = 0.0 if shape.season == "mul" else float(y[0])
    z = y[: max(stops)] - zero
    weights, k, out = best_weights(z, stops, m, shape), shape.n_fitted(m), {}
    for n, w in zip(stops, weights):
        if shape.season == "mul":
            sse, level, slope, season = ([x[0] for x in v] if isinstance(v, list) else v[0] for v in _multiplied(z, w[None], {n}, m, shape)[n])
            first = None
        else:
            x, products = _passed(z, w[None], {n}, m, shape)[n]
            (first,), (sse,) = _solved(products)
            state = x[0, :, 0] + x[0, :, 1:] @ first
            level, slope, season = state[0], state[1] if shape.trend else 0.0, state[1 + shape.trend :].tolist()
        aicc = n * math.log(max(float(sse) / n, 1e-300)) + 2 * k + (2 * k * (k + 1) / (n - k - 1) if n > k + 1 else math.inf)

        def ahead(h: int, n=n, w=w, level=level, slope=slope, season=season) -> np.ndarray:
            base = level + slope * np.cumsum(w[3] ** np.arange(1, h + 1)) if shape.trend else np.full(h, level)
            own = np.array([season[(n + i) % m] for i in range(h)]) if shape.season else None
            return zero + (base if own is None else base + own if shape.season == "add" else base * own)

        out[n] = {"ahead": ahead, "k": k, "aicc": aicc, "sse": float(sse), "grows": shape.trend, "weights": w, "first": first}
    return out


def smoothing(y: np.ndarray, m: int = 1, shape: Shape = Shape()) -> dict:
    """``smoothing_at`` the end of ``y``, with the one-step fits."""
    got = smoothing_at(y, [len(y)], m, shape)[len(y)]
    (a, b, g, phi), first, fits = got["weights"], got["first"], []
    if first is None:
        level, start = y[:m].mean(), y[:m].mean()
        slope = (y[m : 2 * m].mean() - start) / m if shape.trend and len(y) >= 2 * m else 0.0
        season, zero = [v / max(start, 1e-12) for v in y[:m]], 0.0
    else:
        level, slope, season, zero = first[0], first[1] if shape.trend else 0.0, list(first[1 + shape.trend :]), float(y[0])
    for t, v in enumerate(y - zero):
        base = level + phi * slope
        s = season[t % m] if shape.season else 0.0
        hat = base * s if shape.season == "mul" else base + s
        fits.append(zero + hat)
        old, level = level, base + a * (v / (s or 1e-9) - base if shape.season == "mul" else v - hat)
        slope = b * (level - old) + (1 - b) * phi * slope
        if shape.season:
            season[t % m] = g * (v / (level or 1e-9) if shape.season == "mul" else v - level) + (1 - g) * s
    return got | {"fits": np.array(fits)}


def arima(y: np.ndarray, p_most: int = 2, d_most: int = 1, q_most: int = 2) -> dict:
    """The best by AICc of a grid of orders, by conditional least squares (innovations from a long autoregression)."""
    best = None
    for d in range(d_most + 1):
        z = np.diff(y, d) if d else y.copy()
        mean = z.mean()
        w = z - mean
        long = min(8, len(w) // 4)
        a = np.column_stack([w[long - i - 1 : len(w) - i - 1] for i in range(long)]) if long else np.empty((len(w), 0))
        e = np.concatenate([np.zeros(long), w[long:] - (a @ np.linalg.lstsq(a, w[long:], rcond=None)[0] if long else 0)])
        for p, q in itertools.product(range(p_most + 1), range(q_most + 1)):
            lag = max(p, q, 1) + long
            if len(w) - lag < p + q + 3:
                continue
            x = np.column_stack([*[w[lag - i : len(w) - i] for i in range(1, p + 1)], *[e[lag - i : len(w) - i] for i in range(1, q + 1)]]) if p + q else np.empty((len(w) - lag, 0))
            coef = np.linalg.lstsq(x, w[lag:], rcond=None)[0] if p + q else np.empty(0)
            rest = w[lag:] - x @ coef
            n, k = len(rest), p + q + 2
            aicc = n * math.log(max(rest @ rest / n, 1e-300)) + 2 * k + 2 * k * (k + 1) / max(1, n - k - 1)
            if best is None or aicc < best[0]:
                best = (aicc, d, p, q, coef, mean, w.copy(), np.concatenate([np.zeros(len(w) - len(rest)), rest]))
    if best is None:
        raise ValueError("too few values")
    _, d, p, q, coef, mean, w, rest = best

    def ahead(h: int) -> np.ndarray:
        ws, es, out = w.tolist(), rest.tolist(), []
        for _ in range(h):
            v = sum(coef[i] * ws[-1 - i] for i in range(p)) + sum(coef[p + i] * es[-1 - i] for i in range(q))
            ws.append(v)
            es.append(0.0)
            out.append(v + mean)
        return np.cumsum(out) + y[-1] if d else np.array(out)

    fits = y.astype(float).copy()
    fits[-len(rest) :] -= rest
    return {"ahead": ahead, "fits": fits}


def shapes(name: str, y: np.ndarray, m: int, seasonal: bool) -> list[Shape]:
    """Forms that a model chooses from: MOD10 an additive or, of values above zero, a multiplicative season; MOD11 none, a trend, a damped one, and with a season these two seasons and one without a trend."""
    both = [Shape(True, True, "add"), *([Shape(True, True, "mul")] if (y > 0).all() else [])]
    if name == "HoltWinters":
        return both
    if name != "ETS":
        raise ValueError(f"unknown model {name}")
    return [Shape(), Shape(True), Shape(True, True), *([Shape(season="add"), *both] if seasonal and len(y) >= 2 * m else [])]


def fit_model(name: str, y: np.ndarray, m: int, seasonal: bool = True, made: dict[Shape, dict] | None = None) -> dict:
    """One model on ``y``: ``ahead(h)``, ``fits``, and ``grows`` where its form decides that. ``seasonal`` lets ETS have a season. Forms in ``made`` are taken from there, and others added."""
    if name == "ARIMA":
        return arima(y)
    made, forms = {} if made is None else made, shapes(name, y, m, seasonal)
    for f in forms:
        if f not in made:
            made[f] = smoothing(y, m if f.season else 1, f)
    return min((made[f] for f in forms), key=lambda r: r["aicc"])


def fits_at(name: str, y: np.ndarray, origins: list[int], m: int, seasonal: bool = True, made: dict[tuple[Shape, int], dict] | None = None) -> dict[int, dict]:
    """``fit_model`` on ``y`` before each origin; smoothed models are fitted at all origins together. A fit that fails is left out. Forms and origins in ``made`` are taken from there, and others added."""
    made = {} if made is None else made
    out: dict[int, dict] = {}
    if name == "ARIMA":
        for o in origins:
            try:
                out[o] = fit_model(name, y[:o], m, seasonal)
            except (ValueError, np.linalg.LinAlgError, FloatingPointError):
                continue
        return out
    of: dict[Shape, list[int]] = {}
    for o in origins:
        for f in shapes(name, y[:o], m, seasonal):
            of.setdefault(f, []).append(o)
    for f, own in of.items():
        if new := [o for o in own if (f, o) not in made]:
            made.update({(f, o): got for o, got in smoothing_at(y, new, m if f.season else 1, f).items()})
        for o in own:
            if o not in out or made[f, o]["aicc"] < out[o]["aicc"]:
                out[o] = made[f, o]
    return out


def _names(cfg: EngineConfig) -> dict[str, T.Candidate]:
    return {c.name: c for c in T.all_candidates(cfg) if c.kind == "fitted" and not (c.name == "ETS" and c.below)}


def _open(c: T.Candidate, n_rel: int, cfg: EngineConfig) -> bool:
    """BT1 and PRJ8 for the fitted models; between 15 and the seasonal history ETS competes without a season (CAN3)."""
    if c.name == "ETS":
        return n_rel >= 15
    return n_rel >= max(c.min_history, c.reliable)


def fitted_folds(fit: DataFrame, models: tuple[str, ...] | None = None, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Folds (``backtest.FOLD``) of the fitted models that the series' reliable periods admit, or of those of ``models`` only; a fit that fails leaves a fold without a prediction, which takes the model out of that series, nothing more."""
    h, m, enough = cfg.cv.horizon, cfg.season, cfg.gate.seasonal_min_history
    wanted = [c for n, c in _names(cfg).items() if models is None or n in models]
    smooth, wanted = [c for c in wanted if c.name in S.FORMS], [c for c in wanted if c.name not in S.FORMS]

    def folds(series_id: str, y: np.ndarray, valid: np.ndarray) -> list[tuple]:
        n, n_rel, rows, made = len(y), int(valid.sum()), [], {}
        for c in wanted:
            if not _open(c, n_rel, cfg):
                continue
            origins = list(range(max(c.min_history, 2, n - h - cfg.cv.max_origins + 1), n - h + 1))
            fitted = fits_at(c.name, y, origins, m, n_rel >= enough, made) if origins else {}
            for o in origins:
                hat = np.asarray(fitted[o]["ahead"](h), float) if o in fitted else np.full(h, np.nan)
                told = hat.tolist() if np.isfinite(hat).all() else [None] * h
                rows.append((series_id, c.name, c.ordinal, c.n_params, o, float(np.abs(np.diff(y[:o])).mean()), told, y[o : o + h].tolist(), valid[o : o + h].tolist()))
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for s, y, v in zip(pdf["series_id"], pdf["y"], pdf["valid"]) for r in folds(s, np.asarray(y, float), np.asarray(v, int))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in T.FOLD.split(", ")])

    made = [S.smoothed_folds(fit, smooth, cfg)] if smooth else []
    if wanted:
        ship(fit.sparkSession)
        made.append(S.whole_series(fit).select("series_id", "y", "valid").mapInPandas(run, T.FOLD))
    return reduce(DataFrame.unionByName, made)


def fitted_forecasts(fit: DataFrame, chosen: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """``series_id, model, step, point, sigma, grows`` of the chosen fitted models over the whole history (SEL10); a series may have several. A series too short for a model, and a fit that fails, give no rows."""
    ship(fit.sparkSession)
    h, m, enough, known = cfg.forecast.horizon, cfg.season, cfg.gate.seasonal_min_history, [n for n in (*T.FITTED, "HoltWinters") if n not in S.FORMS]
    grows, least = {n: g for n, (_, _, g) in T.FITTED.items()}, {n: k for n, (k, _, _) in T.FITTED.items()}

    def points(series_id: str, y: np.ndarray, n_rel: int, models: list[str]) -> list[tuple]:
        rows, made = [], {}
        for name in models:
            if len(y) < least.get(name, 2 * m):
                continue
            try:
                got = fit_model(name, y, m, n_rel >= enough, made)
                ahead = np.asarray(got["ahead"](h), float)
            except (ValueError, IndexError, np.linalg.LinAlgError, FloatingPointError):
                continue
            if np.isfinite(ahead).all():
                sigma, wide = float(np.std(y - got["fits"])), bool(got.get("grows", grows.get(name, True)))
                rows += [(series_id, name, i + 1, float(v), sigma, wide) for i, v in enumerate(ahead)]
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for s, y, k, names in zip(pdf["series_id"], pdf["y"], pdf["n_rel"], pdf["models"]) for r in points(s, np.asarray(y, float), int(k), list(names))]
            yield pd.DataFrame(rows, columns=["series_id", "model", "step", "point", "sigma", "grows"])

    own = chosen.where(F.col("model").isin(*known)).groupBy("series_id").agg(F.sort_array(F.collect_set("model")).alias("models"))
    made = S.whole_series(fit, own).select("series_id", "y", "n_rel", "models").mapInPandas(run, "series_id string, model string, step int, point double, sigma double, grows boolean")
    return made.unionByName(S.smoothed_forecasts(fit, chosen, cfg))
