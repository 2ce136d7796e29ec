"""Smoothed models: the arrays of Spark against a direct loop, squared errors against a plain grid, and folds in a run."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from rateline.config import EngineConfig
from rateline.operators import backtest as T
from rateline.operators import fitted as M
from rateline.operators import smoothing as S

FIT = "series_id string, idx int, y double, valid int"


@pytest.fixture(scope="module")
def series():
    rng, t = np.random.default_rng(1), np.arange(72)
    out = {}
    for i in range(4):
        out[f"walk{i}"] = np.cumsum(rng.normal(size=72)) + 20
        out[f"noise{i}"] = 10 + rng.normal(size=72)
        out[f"line{i}"] = 5 + 0.3 * t + rng.normal(size=72)
        out[f"season{i}"] = 50 + t * 0.1 + 6 * np.sin(t * np.pi / 6) + rng.normal(size=72)
    return out | {"flat": np.full(40, 3.0), "ramp": 2.0 * np.arange(30), "short": np.array([1.0, 4.0, 2.0]), "large": 1e7 + 1e3 * rng.normal(size=50), "five": np.array([1.0, 4.0, 2.0, 8.0, 3.0, 5.0, 1.0, 9.0])}


def rows_of(spark, series):
    return spark.createDataFrame([(s, i, float(v), 1) for s, y in series.items() for i, v in enumerate(y)], FIT)


def loop(y, a, b, phi, level, slope):
    """One-step errors, last level and slope, by the plain recurrence."""
    errors = []
    for v in y:
        base = level + phi * slope
        errors.append(v - base)
        old, level = level, base + a * (v - base)
        slope = b * (level - old) + (1 - b) * phi * slope
    return np.array(errors), level, slope


def least_squares(y, a, b, phi, trend):
    """The best first states for given weights, from errors that are linear in them."""
    zero = loop(y, a, b, phi, 0.0, 0.0)[0]
    starts = [(1.0, 0.0), (0.0, 1.0)][: 1 + trend]
    x = np.column_stack([zero - loop(y, a, b, phi, *s)[0] for s in starts])
    first = np.linalg.lstsq(x, zero, rcond=None)[0]
    return loop(y, a, b, phi, first[0], first[1] if trend else 0.0)


@pytest.mark.parametrize("name", ["SES", "Holt", "DampedHolt", "Theta"])
def test_fits_equal_a_loop(spark, series, name):
    form, least = S.FORMS[name], {"SES": 5, "Theta": 8}.get(name, 10)
    rows = S.whole_series(rows_of(spark, series)).where(F.col("n") >= least).withColumns({"last": F.col("n"), "first": F.greatest(F.lit(least), F.col("n") - 3)})
    got = {r["series_id"]: r["fits"] for r in S.fits(rows, name, 4).collect()}
    assert set(got) == {s for s, y in series.items() if len(y) >= least}
    for s, fits in got.items():
        assert [f["origin"] for f in fits] == list(range(max(least, len(series[s]) - 3), len(series[s]) + 1))
        for f in fits:
            o = f["origin"]
            y, z, line = series[s][:o], series[s][:o], np.zeros(o + 4)
            if form.line:
                slope, at = np.polyfit(np.arange(o), y, 1)
                line = at + slope * np.arange(o + 4)
                z = 2 * y - line[:o]
            errors, level, slope = least_squares(z - z[0], f["a"], f["b"], f["phi"], form.trend)
            scale = max(1.0, np.abs(z).max())
            assert f["sse"] == pytest.approx(errors @ errors, rel=1e-6, abs=1e-9 * scale**2)
            ahead = z[0] + level + slope * np.cumsum(f["phi"] ** np.arange(1, 5)) if form.trend else z[0] + np.full(4, level)
            told = 0.5 * ahead + 0.5 * line[o:] if form.line else ahead
            assert np.allclose(f["y_hat"], told, rtol=1e-7, atol=1e-7 * scale)
            assert f["sigma"] == pytest.approx(np.std(errors) * (0.5 if form.line else 1.0), rel=1e-5, abs=1e-6 * scale)
            if not form.line:
                # no worse than a grid of weights from usual first states
                plain = [loop(y, a, b, p, y[:4].mean(), (y[3] - y[0]) / 3 if form.trend else 0.0)[0] for a, b, p in itertools.product(S._TENTHS, S._TENTHS if form.trend else [0.0], form.phi)]
                assert f["sse"] <= min(e @ e for e in plain) * (1 + 1e-9) + 1e-9 * scale**2


def test_folds_and_forecasts(spark, series):
    cfg = EngineConfig()
    fit = rows_of(spark, series).withColumn("weight", F.lit(1.0))
    which = [c for c in T.all_candidates(cfg) if c.name in S.FORMS]
    got = {(r["series_id"], r["model"], r["origin"]): r for r in S.smoothed_folds(fit, which, cfg).collect()}
    native = {(r["series_id"], r["origin"]): r for r in T.fold_rows(fit, cfg, {"Mean"}).collect()}
    for (s, model, o), r in got.items():
        y, c = series[s], next(c for c in which if c.name == model)
        assert len(y) >= max(c.min_history, c.reliable) and max(c.min_history, 2, len(y) - 3 - 7) <= o <= len(y) - 3
        same = native[s, o]
        assert r["actual"] == same["actual"] and r["valid"] == same["valid"] and r["scale"] == pytest.approx(same["scale"])
    assert {m for s, m, _ in got if s == "five"} == {"SES"} and not [k for k in got if k[0] == "short"]
    assert len([k for k in got if k[:2] == ("walk0", "Theta")]) == 8
    chosen = spark.createDataFrame([("walk0", "Holt"), ("walk0", "SES"), ("short", "SES"), ("ramp", "Theta"), ("flat", "DampedHolt"), ("flat", "Naive")], "series_id string, model string")
    made = {}
    for r in S.smoothed_forecasts(fit, chosen, cfg).collect():
        made.setdefault((r["series_id"], r["model"]), {})[r["step"]] = r
    assert set(made) == {("walk0", "Holt"), ("walk0", "SES"), ("ramp", "Theta"), ("flat", "DampedHolt")} and all(set(v) == set(range(1, cfg.forecast.horizon + 1)) for v in made.values())
    assert [r["point"] for _, r in sorted(made["ramp", "Theta"].items())][:3] == pytest.approx([59.0, 60.0, 61.0], abs=1.5) and made["flat", "DampedHolt"][3]["point"] == pytest.approx(3.0) and made["walk0", "Holt"][1]["grows"] and not made["walk0", "SES"][1]["grows"]


@pytest.mark.parametrize("shape", [M.Shape(), M.Shape(True), M.Shape(True, True), M.Shape(season="add"), M.Shape(True, True, "add"), M.Shape(True, True, "mul")])
def test_shapes_improve_on_a_plain_grid(series, shape):
    """First states by normal equations equal those of least squares; no grid of weights from usual first states does better."""
    m = 12
    for s in ("walk1", "line1", "season1", "season2"):
        y = series[s][:60]
        got = M.smoothing(y, m, shape)
        assert got["sse"] == pytest.approx(((y - got["fits"]) ** 2).sum(), rel=1e-4, abs=1e-6)
        start = y[:m].mean() if shape.season else y[:4].mean()
        best = np.inf
        for a, b, g, phi in M.Shape(shape.trend, shape.damped, shape.season).weights():
            level, slope = start, ((y[m : 2 * m].mean() - start) / m if shape.season else (y[3] - y[0]) / 3) if shape.trend else 0.0
            season, sse = [v / start if shape.season == "mul" else v - start for v in y[:m]], 0.0
            for t, v in enumerate(y):
                base, x = level + phi * slope, season[t % m] if shape.season else 0.0
                hat = base * x if shape.season == "mul" else base + x
                sse += (v - hat) ** 2
                old, level = level, base + a * ((v / x - base) if shape.season == "mul" else v - hat)
                slope = b * (level - old) + (1 - b) * phi * slope
                if shape.season:
                    season[t % m] = g * (v / level if shape.season == "mul" else v - level) + (1 - g) * x
            best = min(best, sse)
        assert got["sse"] <= best * (1 + 1e-9), (s, shape)


def test_seasonal_fits_are_of_the_past_only(series):
    y = series["season3"]
    for shape in (M.Shape(season="add"), M.Shape(True, True, "mul")):
        both = M.smoothing_at(y, [40, 55], 12, shape)
        alone = M.smoothing_at(y[:40], [40], 12, shape)
        assert both[40]["sse"] == pytest.approx(alone[40]["sse"]) and np.allclose(both[40]["ahead"](5), alone[40]["ahead"](5))
