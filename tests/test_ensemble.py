"""Forecasts of ensembles against the mean of their members, and ensembles in the competition against a direct computation."""

from __future__ import annotations

import numpy as np
import pytest

from rateline.config import EngineConfig
from rateline.operators import backtest as T
from rateline.operators import fitted as M
from rateline.plans import run

FIT = "series_id string, idx int, y double, valid int, weight double"


def test_ensemble_keeps_the_season_of_its_members(spark):
    cfg = EngineConfig()
    y = [100.0 + 10 * (i % 12) + i for i in range(36)]
    fit = spark.createDataFrame([("a", i, v, 1, 1.0) for i, v in enumerate(y)], FIT)
    flat = spark.createDataFrame([("a", None, None, None, None, None)], "series_id string, anchor double, prior double, sba double, croston double, tsb double")
    members = ["SeasonalNaive", "Theta", "Drift"]
    scored = spark.createDataFrame([("a", m, 0.5, "ok", i) for i, m in enumerate(members)], "series_id string, model string, mase double, status string, ordinal int")
    chosen = lambda m: spark.createDataFrame([("a", m)], "series_id string, model string")
    points = lambda m: [r["point"] for r in run.point_forecasts(fit, chosen(m), flat, scored, cfg).orderBy("step").collect()]
    alone = [points(m) for m in members]
    got = points("Ensemble")
    assert len(got) == cfg.forecast.horizon and got == pytest.approx([sum(p) / 3 for p in zip(*alone)])
    gone = spark.createDataFrame([("a", m, 0.5, "ok", i) for i, m in enumerate([*members[:2], "StandardRateAnchor"])], scored.schema)
    assert run.point_forecasts(fit, chosen("Ensemble"), flat, gone, cfg).count() == 0  # one member cannot be had


def test_competition_equals_a_direct_computation(spark):
    """Ensembles of native and fitted folds, ranks, ties and infinite errors, one series after the other."""
    rng = np.random.default_rng(6)
    series = {f"s{i}": np.abs(rng.normal(10, 2, 40) + i * np.arange(40) / 10).tolist() for i in range(6)} | {"flat": [3.0] * 39 + [4.0], "short": [1.0, 2.0, 3.0, 2.0, 1.0, 2.0, 3.0]}
    cfg = EngineConfig()
    fit = spark.createDataFrame([(s, i, v, int(i % 7 != 3), 1.0) for s, y in series.items() for i, v in enumerate(y)], FIT)
    rows = T.fold_rows(fit, cfg).unionByName(M.fitted_folds(fit, ("SES", "Theta"), cfg))
    got = {(r["series_id"], r["model"]): r for r in T.competition(rows, cfg).collect()}
    folds: dict = {}
    for r in T.by_step(rows).collect():
        folds.setdefault((r["series_id"], r["model"], r["ordinal"], r["n_params"]), {}).setdefault(r["origin"], []).append(r)

    def score(own: dict) -> tuple[list[float], bool]:
        out = []
        for steps in own.values():
            e = [abs(r["y_hat"] - r["actual"]) for r in steps if r["valid"] == 1]
            if e:
                mae = sum(e) / len(e)
                out.append(mae / steps[0]["scale"] if steps[0]["scale"] > 0 else 0.0 if mae == 0 else float("inf"))
        return out, len(own) >= 3

    n_mixed = 0
    for s in series:
        ranked = []
        for (sid, model, ordinal, k), own in folds.items():
            if sid != s:
                continue
            errors, enough = score(own)
            r = got[s, model]
            assert r["status"] == ("ok" if enough else "skipped") and r["n_origins"] == len(errors)
            if max(errors) == float("inf"):
                assert r["mase"] is None
                continue
            assert r["mase"] == pytest.approx(np.mean(errors)) and r["stability"] == pytest.approx(np.std(errors))
            if enough:
                ranked.append((np.mean(errors), ordinal, model, k))
        top = sorted(ranked)[:3]
        close = len(top) >= 2 and top[0][0] > 0 and top[-1][0] - top[0][0] <= 0.1 * top[0][0]
        assert ((s, "Ensemble") in got) == close, s
        assert {r["model"] for r in T.members(spark.createDataFrame([tuple(x) for k, x in got.items() if k[0] == s], T.competition(rows, cfg).schema)).collect()} == {t[2] for t in top}
        if close:
            n_mixed += 1
            parts = [folds[s, m, o, k] for _, o, m, k in top]
            shared = set.intersection(*(set(p) for p in parts))
            mean = {o: [r.asDict() | {"y_hat": float(np.mean([p[o][j]["y_hat"] for p in parts]))} for j, r in enumerate(parts[0][o])] for o in shared}
            errors, _ = score(mean)
            assert got[s, "Ensemble"]["mase"] == pytest.approx(np.mean(errors)) and got[s, "Ensemble"]["n_params"] == sum(t[3] for t in top)
    assert n_mixed >= 2


def test_fits_that_fail_take_a_model_out_only(spark, monkeypatch):
    fit = spark.createDataFrame([("a", i, float(i % 5), 1, 1.0) for i in range(30)], FIT)
    failing = spark.createDataFrame([("a", "SES", 3, 1, o, 1.0, [None] * 3, [1.0] * 3, [1] * 3) for o in (20, 21, 22)], T.FOLD)
    got = {r["model"]: r for r in T.competition(T.fold_rows(fit).unionByName(failing)).collect()}
    assert got["SES"]["status"] == "failed" and got["SES"]["mase"] is None and got["Naive"]["status"] == "ok"
    assert T.winners(T.competition(failing)).count() == 0
    short = spark.createDataFrame([("b", 0, 1.0, 1, 1.0)], FIT)
    assert M.fitted_forecasts(short, spark.createDataFrame([("b", "HoltWinters")], "series_id string, model string")).count() == 0
    assert M.fitted_folds(short).count() == 0 and T.fold_rows(short).count() == 0
