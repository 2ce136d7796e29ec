"""Operating conditions in the competition: factors that hold for some, models of conditions against a plain loop, what keeps a series from being tested."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from rateline.config import EngineConfig, Forecast
from rateline.operators import backtest as T
from rateline.operators import context as C
from rateline.operators import contextual as X
from rateline.operators import explain as E

CFG = EngineConfig(forecast=Forecast(horizon=3))


def months(n: int) -> list[datetime.date]:
    return [datetime.date(2020 + i // 12, i % 12 + 1, 1) for i in range(n)]


def world(spark, n=40, ahead=3, planned=True, seed=1):
    """One series whose rate has a standing part and depends on whether the second line runs, and the plan for its horizon."""
    rng = np.random.default_rng(seed)
    starts = months(n + ahead)
    own, other = rng.uniform(50, 150, n + ahead), np.where(rng.random(n + ahead) < 0.5, 80.0, 0.0)
    y = 300 / own + 1 + np.where(other > 0, 4.0, 0.0) + 0.05 * rng.standard_normal(n + ahead)
    fit = spark.createDataFrame([("s", "1", "x", "relative", d, i, float(y[i]), 1, float(own[i])) for i, d in enumerate(starts[:n])], "series_id string, line string, output_type string, mode string, period_start date, idx int, y double, valid int, weight double")
    series = spark.createDataFrame([("s", "1", "x", "relative", starts[n - 1], n)], "series_id string, line string, output_type string, mode string, last_start date, n_periods int")
    kind = lambda i: "actual" if i < n else "plan"
    rows = [(d, ln, "x", kind(i), float(v[i])) for ln, v in (("1", own), ("2", other)) for i, d in enumerate(starts) if i < n or planned]
    driver = spark.createDataFrame(rows, "period_start date, line string, output_type string, driver_type string, driver_qty double")
    return fit, series, C.conditions(driver, CFG), own, other, y


def test_factors_of_some_lines_do_not_double_rows(spark):
    rows = spark.createDataFrame([(datetime.date(2024, 1, 1), u, s, "r") for u in "12" for s in "xy"], "period_start date, unit string, stream string, regime_label string")
    cal = [("2024-01", "promo", "1", None, None), ("2024-01", "promo", "5", "1", None), ("2024-01", "promo", "7", None, "y"), ("2024-01", "promo", "9", "1", "x"), ("2024-02", "late", "1", None, None), ("2024-01", "kind", "big", "2", None)]
    factors = C.calendar_factors(spark.createDataFrame(cal, "period string, factor_name string, factor_value string, unit string, stream string"))
    got, names = C.with_calendar(rows, factors)
    assert names == ["ctx_kind_big", "ctx_late", "ctx_promo"] and got.columns[:4] == rows.columns
    assert {(r["unit"], r["stream"]): (r["ctx_promo"], r["ctx_late"], r["ctx_kind_big"]) for r in got.collect()} == {("1", "x"): (9.0, 0.0, 0.0), ("1", "y"): (5.0, 0.0, 0.0), ("2", "x"): (1.0, 0.0, 1.0), ("2", "y"): (7.0, 0.0, 1.0)}
    assert got.count() == 4 and C.with_calendar(rows, factors.limit(0)) == (rows, [])


def test_folds_of_condition_models_equal_a_loop(spark):
    fit, series, rows, own, other, y = world(spark)
    ext = X.extended_rows(fit, series, rows, [], CFG)
    got = {(r["model"], r["origin"]): r["y_hat"] for r in X.context_folds(ext, [], CFG).collect()}
    n, label = 40, np.where(other > 0, "both", "one")
    for o in range(n - 10, n - 2):
        a = np.column_stack([1 / own[:o], np.ones(o)])
        fixed, variable = np.linalg.lstsq(a, y[:o], rcond=None)[0]
        if min(fixed, variable) < 0:  # then one of the two alone is best
            alone = [(a[:, 0] @ y[:o] / (a[:, 0] @ a[:, 0]), 0.0), (0.0, y[:o].mean())]
            fixed, variable = min(alone, key=lambda c: ((y[:o] - a @ np.array(c)) ** 2).sum())
        assert got["FixedPlusVariable", o] == pytest.approx((fixed / own[o : o + 3] + variable).tolist())
        assert got["RegimeConditional", o] == pytest.approx([y[:o][label[:o] == lab].mean() for lab in label[o : o + 3]])
        assert len(got["ContextRegression", o]) == 3 and None not in got["ContextRegression", o]
    res = {r["model"]: r["mase"] for r in T.results(X.context_folds(ext, [], CFG), CFG).collect()}
    assert res["ContextRegression"] < 0.5  # it sees both causes


def test_forecasts_read_the_plan(spark):
    fit, series, rows, own, other, y = world(spark)
    ext = X.extended_rows(fit, series, rows, [], CFG)
    chosen = spark.createDataFrame([("s", m) for m in T.CONTEXT], "series_id string, model string")
    got = {(r["model"], r["step"]): r for r in X.context_forecasts(ext, chosen, [], CFG).collect()}
    assert len(got) == 9
    label = np.where(other > 0, "both", "one")
    for s in (1, 2, 3):
        assert got["RegimeConditional", s]["point"] == pytest.approx(y[:40][label[:40] == label[39 + s]].mean())
        assert got["ContextRegression", s]["point"] == pytest.approx(y[39 + s], abs=1.0)
    levels = {lab: y[:40][label[:40] == lab].mean() for lab in ("both", "one")}
    assert got["RegimeConditional", 1]["sigma"] == pytest.approx(np.std(y[:40] - np.array([levels[lab] for lab in label[:40]])))
    fit, series, rows, *_ = world(spark, planned=False)
    bare = X.extended_rows(fit, series, rows, [], CFG)
    assert X.context_forecasts(bare, chosen, [], CFG).count() == 0


def test_ladder(spark):
    fit, series, rows, *_ = world(spark)
    ext = X.extended_rows(fit, series, rows, [], CFG)
    d = X.diagnosis(ext, CFG).first()
    assert d["skip_reason"] is None and d["material"] == 1 and d["verdict"].startswith("Consumption depends") and d["known_future"]
    why = lambda e, **more: X.diagnosis(e, CFG, **more).first()["skip_reason"]
    assert why(ext, enabled=False) == "operating conditions are switched off" and why(ext, any_driver=False) == "there is no driver" and why(ext, variance=False) == "operating conditions never change"
    assert why(X.extended_rows(fit.withColumn("line", F.lit("9")), series.withColumn("line", F.lit("9")), rows, [], CFG)) == "the line and output are in no driver row"
    assert why(ext.withColumn("valid", (F.col("idx") < 3).cast("int"))) == "too few usable periods"
    assert why(ext.withColumn("regime_label", F.lit("a"))) == "only one operating condition" and why(ext.withColumn("y", F.lit(2.0))) == "the series is constant"
    unplanned = X.diagnosis(X.extended_rows(*[w for w in world(spark, planned=False)][:3], [], CFG), CFG).first()
    assert unplanned["material"] == 0 and "no plan covers" in unplanned["verdict"]
    assert X.for_combination(rows, "1", "x").count() == 43 and X.regime_at(rows, "2020-01", "1", "x") in ("1:x", "1:x+2:x") and X.regime_at(rows, "1999-01", "1", "x") is None


def test_words(spark):
    said = spark.createDataFrame([("1:x+2:y | promo=1 | price=2.5",), ("idle",), ("other",), ("1:x",)], "l string").select(C.humanised(F.col("l")).alias("w")).collect()
    assert [r["w"] for r in said] == ["1 making x and 2 making y with promo on, price 2.5", "nothing running", "other conditions", "1 making x"]
    rows = spark.createDataFrame([("failed", None, 1.0, "SES"), ("ok", 2.0, 1.0, "Drift"), ("ok", 1.0, 1.0, "Mean")], "s string, m double, b double, n string")
    got = [r[0] for r in rows.select(E.rejection_reason(F.col("s"), F.col("m"), F.col("b"), F.col("n"), F.lit(0.1), F.lit(0.1))).collect()]
    assert got == ["it could not be fitted", "100.0 % more error: the trend it assumes does not hold", "as good, but less dependable"]
    with pytest.raises(ValueError):
        E.portfolio_view(rows, sort="nothing")
