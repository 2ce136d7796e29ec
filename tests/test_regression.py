"""Cross products and sweeps against least squares in numpy; tails against the gamma function's own forms."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pytest
from plain import adf_p_value, chi2_tail, context_regression
from pyspark.sql import functions as F

from rateline.functions import tails
from rateline.operators import regression as R


def test_tails(spark):
    rows = [(x, k) for k in (*range(1, 12), 40, 41) for x in (-1.0, 0.0, 1e-6, 0.3, 1.0, 3.84, 7.0, 12.4, 12.6, 30.0, 90.0, 400.0)]
    got = spark.createDataFrame(rows, "x double, k int").select("x", "k", tails.chi2_tail(F.col("x"), F.col("k")).alias("p"), tails.normal_cdf(F.col("x") / 10 - 2).alias("phi")).collect()
    for r in got:
        assert r["p"] == pytest.approx(chi2_tail(r["x"], r["k"]), rel=1e-10, abs=1e-15), r
        assert r["phi"] == pytest.approx(NormalDist().cdf(r["x"] / 10 - 2), rel=1e-10, abs=1e-15)
    none = spark.createDataFrame([(None, 2), (1.0, None)], "x double, k int").select(tails.chi2_tail(F.col("x"), F.col("k")).alias("p")).collect()
    assert [r["p"] for r in none] == [None, None]


def test_sweeps_are_least_squares(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(30), rng.normal(size=(30, 3))])
    y = x @ [1.0, 2.0, -1.0, 0.0] + rng.normal(size=30)
    df = spark.createDataFrame([([[*map(float, r), float(v)] for r, v in zip(x, y)],)], "v array<array<double>>")
    whole = "g"
    for k in range(4):
        whole = R.swept(whole, str(k))
    m = np.array(df.select(F.expr(R.let("g", R.products("v", "5"), whole)).alias("m")).first()["m"])
    coef, sse, *_ = np.linalg.lstsq(x, y, rcond=None)
    assert np.allclose(m[:4, 4], coef) and m[4, 4] == pytest.approx(sse[0]) and np.allclose(-m[:4, :4], np.linalg.inv(x.T @ x))
    back = np.array(df.select(F.expr(R.let("g", R.products("v", "5"), R.swept(R.swept("g", "1"), "1"))).alias("m")).first()["m"])
    g = np.column_stack([x, y]).T @ np.column_stack([x, y])
    assert np.allclose(np.abs(back), np.abs(g)) and np.allclose(np.delete(np.delete(back, 1, 0), 1, 1), np.delete(np.delete(g, 1, 0), 1, 1))  # swept in and out again


def test_unit_root_equals_numpy(spark):
    rng = np.random.default_rng(0)
    series = {"walk": np.cumsum(rng.normal(size=120)), "noise": rng.normal(size=90) + 50, "short": rng.normal(size=9), "shorter": np.array([1.0, 2.0, 1.5]), "line": np.arange(40.0), "flat": np.full(30, 2.0), "season": 100 + 10 * np.sin(np.arange(72) * np.pi / 6) + rng.normal(size=72)}
    series |= {f"ar{i}": np.array([0.0, *rng.normal(size=47)]).cumsum() * 0.3 + rng.normal(size=48) for i in range(12)}
    df = spark.createDataFrame([(s, y.tolist()) for s, y in series.items()], "series_id string, y array<double>")
    got = {r["series_id"]: r for r in R.unit_root(df).collect()}
    assert "flat" not in got and "shorter" not in got
    for s, y in series.items():
        if s not in ("flat", "shorter", "line"):
            assert got[s]["p_value"] == pytest.approx(adf_p_value(y), rel=1e-6, abs=1e-9), s
    fixed = {r["series_id"]: r for r in R.unit_root(df, 1).collect()}
    assert fixed["walk"]["lag"] == 1 and "shorter" not in fixed
    y = series["walk"]
    d = np.diff(y)
    a = np.column_stack([y[1:-1], d[:-1], np.ones(len(d) - 1)])
    b, rest, *_ = np.linalg.lstsq(a, d[1:], rcond=None)
    assert fixed["walk"]["tau"] == pytest.approx(b[0] / math.sqrt(np.linalg.inv(a.T @ a)[0, 0] * rest[0] / (len(a) - 3)))


def test_forward_selection_equals_numpy(spark):
    """Regressors, predictions and deviations as by trying all, also where none helps, one is a copy, one is constant, one is missing, or the fit is exact."""
    rng, rows, want = np.random.default_rng(5), [], {}
    names = ["a", "b", "c", "d", "e", "f"]
    for i in range(14):
        n, h = 40 + i, 3
        x = rng.normal(size=(n + h, 6)) * [1, 10, 1000, 1, 1, 1] + [0, 5, 1e5, 0, 0, 0]
        x[:, 3] = 7.0
        x[:, 4] = x[:, 0] + 1e-3 * rng.normal(size=n + h)
        y = [2 * x[:n, 0] + 0.3 * x[:n, 1] + rng.normal(size=n), rng.normal(size=n), 3 + 2 * x[:n, 1], 0.01 * x[:n, 2] + rng.normal(size=n)][i % 4]
        lost = i % 3 == 0
        for t in range(n + h):
            row = [float(v) for v in x[t]]
            if lost and t == 5:
                row[5] = None
            rows.append((f"s{i}", t, max(0, t - n + 1), float(y[t]) if t < n else None, 1, *row))
        use = [0, 1, 2, 4] + ([] if lost else [5])
        for o in (n - 3, n):
            try:
                got = context_regression(y[:o], x[:o][:, use], x[o : o + 3][:, use] if o < n else x[n:][:, use], max(1, o // 8), 5.0)
                want[f"s{i}", o] = ([use[c] for c in got["chosen"]], got["ahead"](3), np.std(y[:o] - got["fits"]))
            except ValueError:
                want[f"s{i}", o] = None
    ext = spark.createDataFrame(rows, "series_id string, idx int, ahead int, y double, valid int, " + ", ".join(f"{c} double" for c in names))
    arrays = R.condition_arrays(ext, names)
    arrays = arrays.select("*", F.explode(F.array(F.size("past") - 3, F.size("past"))).alias("origin"))
    got = R.regressed(arrays, "if(origin < size(past), slice(past, origin + 1, 3), transform(future, e -> named_struct('idx', e.idx, 'ahead', e.ahead, 'y', e.y, 'valid', e.valid, 'x', e.x)))", 8, 5.0).collect()
    assert len(got) == len(want)
    kinds = set()
    for r in got:
        w = want[r["series_id"], r["origin"]]
        kinds.add(w is None)
        if w is None:
            assert r["told"] is None
        else:
            assert [r["use"][c - 1] for c in r["told"]["chosen"]] == w[0]
            assert np.allclose(r["told"]["y_hat"], w[1], rtol=1e-6, atol=1e-6) and r["told"]["sigma"] == pytest.approx(w[2], rel=1e-5, abs=1e-6)
    assert kinds == {True, False}
