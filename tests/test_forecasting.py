"""Small fixtures whose wrong formula gives a visibly wrong number."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from rateline.config import EngineConfig, Scope, window_sweep
from rateline.functions.stats import normal_quantile, stl
from rateline.operators import backtest as T
from rateline.operators import context as C
from rateline.operators import contextual as X
from rateline.operators import explain as E
from rateline.operators import fitted as M
from rateline.operators import forecast as G
from rateline.operators import learn as L
from rateline.operators import prepare as P
from rateline.operators import profile as B
from rateline.operators import validate as V
from rateline.sources.mapping import SchemaError, build_raw_tables, empty

CONS = "date timestamp, item_code string, qty_base double, qty_ton double, cost double, output_type string, line string, rate double, rate_uom string"
DRV = "date timestamp, driver_qty double, driver_uom string, output_type string, line string, driver_type string"


def raw_of(spark, cons, drv=(), items=()):
    raw = build_raw_tables(spark, {"bom": spark.createDataFrame([], "item_code string, item_description string, uom string, `unit_price_$` double, unit_wt_kg double, category_level1 string, category_level2 string, category_level3 string"), "consumption": spark.createDataFrame([], "date timestamp, item_code string, cons_qty_base_uom double, cons_qty_ton double, `cons_$` double, output_type string, production_line string, cons_rate double, cons_rate_uom string")})
    raw.consumption = spark.createDataFrame([(__import__("datetime").datetime.fromisoformat(d), i, q, 0.0, 0.0, o, ln, r, "kg/t") for d, i, ln, o, q, r in cons], CONS)
    raw.driver = spark.createDataFrame([(__import__("datetime").datetime.fromisoformat(d), q, "t", o, ln, t) for d, ln, o, q, t in drv], DRV)
    if items:
        raw.items = spark.createDataFrame(list(items), "item_code string, description string, uom string, unit_price double, unit_wt double, cat_l1 string, cat_l2 string, cat_l3 string, declared_mode string")
    return raw


def fit_frame(spark, y, weight=None, sid="s"):
    rows = [(sid, i, float(v), 1, None if weight is None else float(weight[i])) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series_id string, idx int, y double, valid int, weight double")


FC = "series_id string, item_code string, line string, output_type string, period string, target_value double, lower_80 double, upper_80 double, lower_95 double, upper_95 double, driver_plan double, reconstructed_demand double, demand_lower_80 double, demand_upper_80 double, demand_lower_95 double, demand_upper_95 double, confidence double"


def forecast_rows(spark, rows):
    return spark.createDataFrame([(f"{i}|{ln}|{o}", i, ln, o, p, r, r, r, r, r, d, r * d, r * d, r * d, r * d, r * d, 0.5) for i, ln, o, p, r, d in rows], FC)


def test_rates_are_averaged_by_their_driver(spark):
    f = forecast_rows(spark, [("a", "1", "x", "2024-01", 1.0, 10.0), ("b", "1", "y", "2024-01", 0.01, 1000.0)])
    got = G.roll_up_forecasts(f, ["line"]).first()
    assert got["rate"] == pytest.approx(20 / 1010) and got["demand"] == pytest.approx(20.0)


def test_shared_driver_counts_once(spark):
    f = forecast_rows(spark, [("a", "1", "x", "2024-01", 0.02, 100.0), ("b", "1", "x", "2024-01", 0.06, 100.0)])
    got = G.roll_up_forecasts(f, []).first()
    assert (got["driver_plan"], got["rate"], got["n_series"]) == (100.0, pytest.approx(0.04), 2)
    two = forecast_rows(spark, [("a", "1", "x", "2024-01", 0.02, 100.0), ("a", "2", "x", "2024-01", 0.04, 50.0)])
    got = G.roll_up_forecasts(two, []).first()
    assert (got["driver_plan"], got["rate"]) == (150.0, pytest.approx(4 / 150))


@pytest.mark.parametrize("dims, filters, n", [([], None, 1), (["line"], None, 2), (["output_type"], None, 2), (["line", "output_type"], None, 4), (["line"], {"line": ["1"]}, 1)])
def test_picker_row_counts(spark, dims, filters, n):
    f = forecast_rows(spark, [("a", ln, o, "2024-01", 1.0, 1.0) for ln in "12" for o in "BF"])
    assert G.roll_up_forecasts(f, dims, filters).count() == n


def test_unknown_dimension(spark):
    with pytest.raises(ValueError):
        G.roll_up_forecasts(forecast_rows(spark, [("a", "1", "x", "2024-01", 1.0, 1.0)]), ["color"])


def test_weighted_averages(spark):
    cfg = replace(EngineConfig(), models=replace(EngineConfig().models, lookback_windows=(2,)))
    rows = {r["idx"]: r for r in T.levels(fit_frame(spark, [5, 10, 10], [500, 10, 1000]), cfg).collect()}
    # targets are rates: consumption 5, 10, 10 over drivers 500, 10, 1000
    rates = fit_frame(spark, [0.01, 1.0, 0.01], [500, 10, 1000])
    rows = {r["idx"]: r for r in T.levels(rates, cfg).collect()}
    assert rows[3]["level_6"] == pytest.approx(20 / 1010)
    assert rows[3]["level_7"] == pytest.approx((1 * 10 + 2 * 10) / (1 * 10 + 2 * 1000))


def test_native_folds_equal_a_direct_loop(spark):
    rng = np.random.default_rng(1)
    y, w = rng.uniform(1, 9, 40), rng.uniform(1, 5, 40)
    got = {(r["model"], r["origin"], r["step"]): r["y_hat"] for r in T.folds(fit_frame(spark, y, w)).collect()}
    for o in range(30, 38):
        for s in (1, 2, 3):
            assert got["Naive", o, s] == pytest.approx(y[o - 1])
            assert got["Drift", o, s] == pytest.approx(y[o - 1] + s * (y[o - 1] - y[0]) / (o - 1))
            assert got["Mean", o, s] == pytest.approx((y[:o] * w[:o]).sum() / w[:o].sum())
            assert got["MovingAverage(6)", o, s] == pytest.approx((y[o - 6 : o] * w[o - 6 : o]).sum() / w[o - 6 : o].sum())
            r = np.arange(1, 7) * w[o - 6 : o]
            assert got["WeightedMovingAverage(6)", o, s] == pytest.approx((y[o - 6 : o] * r).sum() / r.sum())
            assert got["SeasonalNaive", o, s] == pytest.approx(y[o + s - 1 - 12])
    assert {k[1] for k in got} == set(range(30, 38))


def test_folds_cannot_see_the_future(spark):
    y = np.arange(30.0)
    a = {(r["model"], r["origin"], r["step"]): r["y_hat"] for r in T.folds(fit_frame(spark, y)).where("origin <= 24").collect()}
    y[25:] = 1e6
    b = {(r["model"], r["origin"], r["step"]): r["y_hat"] for r in T.folds(fit_frame(spark, y)).where("origin <= 24").collect()}
    assert a == b and a


def test_mase_of_a_constant_series(spark):
    got = {r["model"]: r for r in T.results(T.fold_rows(fit_frame(spark, [3.0] * 20))).collect()}
    assert got["Naive"]["mase"] == 0.0
    y = [3.0] * 19 + [4.0]
    got = {r["model"]: r for r in T.results(T.fold_rows(fit_frame(spark, y))).collect()}
    assert got["Naive"]["mase"] is None  # infinite in the last fold


def test_croston_and_tsb_closed_forms(spark):
    y = [0, 0, 5, 0, 3, 0, 0, 4, 0, 0]
    ev = [(i, v) for i, v in enumerate(y) if v]
    gaps = [ev[0][0] + 1, *(b[0] - a[0] for a, b in zip(ev, ev[1:]))]
    size, gap = np.mean([v for _, v in ev]), np.mean(gaps)
    for (_, v), g in zip(ev, gaps):
        size, gap = size + 0.1 * (v - size), gap + 0.1 * (g - gap)
    got = T.croston(fit_frame(spark, y)).first()
    assert got["croston"] == pytest.approx(size / gap) and got["sba"] == pytest.approx(size / gap * 0.95)
    p, size = np.mean([v > 0 for v in y]), np.mean([v for _, v in ev])
    for v in y:
        p += 0.1 * ((v > 0) - p)
        size += 0.15 * (v - size) if v else 0
    assert T.tsb(fit_frame(spark, y)).first()["tsb"] == pytest.approx(p * size)
    assert T.croston(fit_frame(spark, [0, 0, 0])).count() == 0 and T.tsb(fit_frame(spark, [0, 0])).first()["tsb"] == 0


def test_calendar_trap(spark):
    import calendar

    cons = [(f"{y}-{m:02d}-01", "a", "1", "x", 3.0 * calendar.monthrange(y, m)[1], None) for y in (2023, 2024) for m in range(1, 13)]
    p = P.build_series(raw_of(spark, cons))
    assert {round(r["target"], 9) for r in p.observations.select("target").collect()} == {3.0}
    fits = G.final_fits(P.fit_targets(p.observations), p.series.select("series_id", F.lit("Naive").alias("model")))
    rows = {r["period"]: r["reconstructed_demand"] for r in G.reconstruct(G.generate(fits, p.series), p.driver).collect()}
    assert rows["2025-01"] / rows["2025-02"] == pytest.approx(31 / 28)


def test_gap_filling_applicability_and_mode(spark):
    cons = [("2024-01-05", "a", "1", "x", 5.0, 0.5), ("2024-01-20", "a", "1", "x", 5.0, None), ("2024-03-01", "a", "1", "x", 2.0, 0.4), ("2024-01-01", "b", "9", "x", 1.0, 0.1), ("2024-01-01", None, "1", "x", 1.0, None)]
    drv = [("2024-01-01", "1", "x", 100.0, "actual"), ("2024-03-01", "1", "x", 90.0, "actual"), ("2024-04-01", "1", "x", 50.0, "plan"), ("2024-04-01", "1", "x", 50.0, "budget")]
    p = P.build_series(raw_of(spark, cons, drv))
    o = {(r["item_code"], r["period"]): r for r in p.observations.collect()}
    assert o["a", "2024-02"]["is_gap_filled"] == 1 and o["a", "2024-02"]["qty_base"] == 0 and o["a", "2024-02"]["is_applicable"] == 0
    assert o["a", "2024-01"]["rate"] == 0.5 and o["a", "2024-01"]["qty_base"] == 10 and o["a", "2024-01"]["is_reliable"] == 1
    s = {r["item_code"]: r for r in p.series.collect()}
    assert (s["a"]["mode"], s["b"]["mode"], s["b"]["mode_source"], s["b"]["is_orphan"]) == ("relative", "absolute", "no_driver", 1)
    assert s[None]["series_id"] == "|1|x" and s["a"]["n_periods"] == 3
    fit = [r["y"] for r in P.fit_targets(p.observations).where("item_code = 'a'").orderBy("idx").collect()]
    assert fit == pytest.approx([0.5, 0.45, 0.4])
    ui = spark.createDataFrame([("a", "ABSOLUTE")], "item_code string, mode string")
    assert P.build_series(raw_of(spark, cons, drv), overrides=ui).series.where("item_code = 'a'").first()["mode_source"] == "declared_ui"
    assert P.build_series(raw_of(spark, []), EngineConfig()).series.count() == 0


def test_weekly_and_daily_periods(spark):
    cons = [("2024-01-03", "a", "1", "x", 7.0, None), ("2024-01-16", "a", "1", "x", 14.0, None)]
    w = P.build_series(raw_of(spark, cons), EngineConfig(granularity="weekly")).observations.orderBy("idx").collect()
    assert [r["period"] for r in w] == ["2024-01-01/2024-01-07", "2024-01-08/2024-01-14", "2024-01-15/2024-01-21"] and w[0]["target"] == 1.0
    assert P.build_series(raw_of(spark, cons), EngineConfig(granularity="daily")).observations.count() == 14


def test_missing_plan_gives_no_demand(spark):
    cons = [(f"2024-{m:02d}-01", "a", "1", "x", 5.0, 0.5) for m in range(1, 9)]
    drv = [(f"2024-{m:02d}-01", "1", "x", 10.0, "actual") for m in range(1, 9)]
    p = P.build_series(raw_of(spark, cons, drv))
    fits = G.final_fits(P.fit_targets(p.observations), p.series.select("series_id", F.lit("Naive").alias("model")))
    r = G.reconstruct(G.generate(fits, p.series), p.driver).first()
    assert r["reconstructed_demand"] is None and r["target_value"] == 0.5


def test_intervals_are_ordered_and_not_negative(spark):
    rng = np.random.default_rng(2)
    p = P.build_series(raw_of(spark, [(f"20{20 + i // 12}-{i % 12 + 1:02d}-01", "a", "1", "x", float(v), None) for i, v in enumerate(rng.exponential(5, 30))]))
    for model in ("Naive", "Drift", "Mean", "SeasonalNaive", "WeightedMovingAverage(3)"):
        fits = G.final_fits(P.fit_targets(p.observations), p.series.select("series_id", F.lit(model).alias("model")))
        for r in G.generate(fits, p.series).collect():
            assert 0 <= r["lower_95"] <= r["lower_80"] <= r["target_value"] <= r["upper_80"] <= r["upper_95"]


def test_demand_classes_and_break(spark):
    rows = [("s", i, f"p{i:02d}", 1.0 if i < 12 else 9.0 + i % 2, 0, 1, 1) for i in range(24)] + [("z", i, f"p{i:02d}", 5.0 if i % 4 == 0 else 0.0, 0, 1, 1) for i in range(24)]
    o = spark.createDataFrame(rows, "series_id string, idx int, period string, target double, is_gap_filled int, is_reliable int, is_applicable int")
    got = {r["series_id"]: r for r in B.profile(o).collect()}
    assert got["z"]["pattern_class"] == "intermittent" and got["s"]["break_period"] == "p12" and got["z"]["adi"] == 4.0


def test_materiality(spark):
    rng = np.random.default_rng(3)

    def tested(a, b, n):
        y = [*(a + 0.3 * rng.standard_normal(n)), *(b + 0.3 * rng.standard_normal(n))]
        rows = [("s", i, float(v), 1, "on" if i < n else "off") for i, v in enumerate(y)]
        return C.diagnosed(C.significance(spark.createDataFrame(rows, "series_id string, idx int, y double, valid int, regime_label string"))).first()

    assert tested(5, 7, 12)["material"] == 1
    small = tested(5.0, 5.25, 60)
    assert small["p_value"] < 0.05 and small["material"] == 0


def test_two_column_non_negative_fit(spark):
    rows = spark.createDataFrame([("s", float(d), 3.0 / d + 0.5, "relative", float(d), 1) for d in range(5, 20)], "series_id string, driver_qty double, y double, mode string, system_driver double, valid int")
    got = X.standing_fits(rows.withColumn("origin", F.lit(15))).first()
    assert (got["fixed"], got["variable"]) == (pytest.approx(3.0), pytest.approx(0.5))


def test_regimes(spark):
    d = P.aggregate_driver(raw_of(spark, [], [("2024-01-01", "1", "x", 10.0, "actual"), ("2024-01-01", "2", "x", 30.0, "actual"), ("2024-02-01", "1", "x", 10.0, "actual"), ("2024-02-01", "2", "x", 0.0, "actual"), ("2024-02-01", "1", "x", 99.0, "plan")]).driver)
    got = {(r["period"], r["unit"]): r for r in C.conditions(d).collect()}
    assert got["2024-01", "1"]["regime_label"] == "1:x+2:x" and got["2024-02", "1"]["is_solo"] == 1 and got["2024-02", "1"]["driver_qty"] == 10
    assert got["2024-01", "1"]["mix_entropy"] == pytest.approx(-(0.25 * math.log(0.25) + 0.75 * math.log(0.75)))


def test_rules_find_what_they_should(spark):
    cons = [("2024-01-01", "a", "1", "x", -1.0, 0.1), ("2024-01-01", "a", "1", "x", None, None), ("2024-02-01", "b", "2", "x", 1.0, 0.2)]
    drv = [("2024-01-01", "1", "x", 0.0, "actual"), ("2024-01-01", "1", "x", 1.0, "other")]
    codes = {r["code"] for r in V.run_all(raw_of(spark, cons, drv, [("a", "A", "kg", 1.0, 1.0, None, None, None, "maybe")] * 2)).collect()}
    assert codes == {"DUPLICATE_PERIOD_ROWS", "NEGATIVE_VALUE", "MISSING_QUANTITY", "ORPHAN_SERIES", "NONPOSITIVE_DRIVER", "ITEM_NOT_IN_BOM", "MIXED_MODE_SERIES", "INSUFFICIENT_HISTORY", "INVALID_DRIVER_TYPE", "INVALID_DECLARED_MODE", "DUPLICATE_BOM_ITEM"}


def test_coercion_and_schema(spark):
    bom = spark.createDataFrame([("a ", "A", "kg", "x", "1", "", None, None)], "item_code string, item_description string, uom string, `unit_price_$` string, unit_wt_kg string, category_level1 string, category_level2 string, category_level3 string")
    cons = spark.createDataFrame([("never", "a", "1", "1", "1", "x", "1", None, None)], "date string, item_code string, cons_qty_base_uom string, cons_qty_ton string, `cons_$` string, output_type string, production_line string, cons_rate string, cons_rate_uom string")
    raw = build_raw_tables(spark, {"bom": bom, "consumption": cons})
    got = {r["column_name"]: r["n"] for r in raw.failures.collect()}
    assert got["bom.unit_price"] == 1 and got["consumption.date"] == 1 and raw.items.first()["item_code"] == "a" and raw.items.first()["cat_l1"] is None
    assert V.has_fatal(V.coercion(raw)) and raw.driver.count() == 0
    with pytest.raises(SchemaError):
        build_raw_tables(spark, {"bom": bom})
    with pytest.raises(SchemaError):
        build_raw_tables(spark, {"bom": bom.drop("uom"), "consumption": cons})
    assert "declared_mode" in empty(spark, "bom").columns


def test_learning_loop(spark):
    rows = [("s", f"2024-{m:02d}", "r", 10.0, 9.0 if m < 4 else 5.0, 1.0 if m < 4 else 5.0, 100 / 9 if m < 4 else 100.0) for m in range(1, 7)]
    h = spark.createDataFrame(rows, "series_id string, period string, run_id string, forecast_value double, actual_value double, error double, abs_pct_error double")
    assert L.drift(h.withColumn("abs_pct_error", F.lit(7.0))).first()["drifting"] == 0 and L.drift(h.withColumn("abs_pct_error", F.lit(None).cast("double"))).count() == 0
    assert L.drift_warnings(L.drift(h)).first()["code"] == "ACCURACY_DRIFT"
    assert L.drift(h).first()["drifting"] == 1 and L.drift(h.where("period <= '2024-03'")).first()["drifting"] == 0
    again = L.upserted(L.upserted(h, h), h.withColumn("actual_value", F.lit(1.0)).withColumn("forecast_value", F.lit(2.0)))
    assert again.count() == 6 and {(r["actual_value"], r["forecast_value"]) for r in again.collect()} == {(1.0, 10.0)}


def test_numeric_library():
    assert normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    t = np.arange(60)
    trend, seas, rest = stl(0.1 * t + 3 * np.sin(2 * np.pi * t / 12), 12)
    assert np.abs(rest).max() < 0.5 and np.corrcoef(seas, np.sin(2 * np.pi * t / 12))[0, 1] > 0.99 and trend[-1] > trend[0]


def test_fitted_models():
    t = np.arange(48.0)
    y = 10 + 0.5 * t + 4 * np.sin(2 * np.pi * t / 12)
    future = 10 + 0.5 * (48 + np.arange(6)) + 4 * np.sin(2 * np.pi * (48 + np.arange(6)) / 12)
    for name, worst in (("HoltWinters", 0.1), ("ETS", 0.1), ("ARIMA", 8)):
        got = M.fit_model(name, y, 12)
        assert np.abs(got["ahead"](6) - future).mean() < worst, name


def test_fits_at_all_origins_equal_single_fits():
    rng = np.random.default_rng(9)
    y = 20 + 0.2 * np.arange(44) + 5 * np.sin(np.arange(44) * np.pi / 6) + rng.standard_normal(44)
    y[37] = -1.0  # from here on no multiplicative season
    for name in ("HoltWinters", "ETS"):
        got = M.fits_at(name, y, list(range(30, 42)), 12)
        for o in range(30, 42):
            assert np.allclose(got[o]["ahead"](3), M.fit_model(name, y[:o], 12)["ahead"](3)), (name, o)
    early = M.fits_at("ETS", y, [15, 16, 23], 12, seasonal=False)
    assert all(np.allclose(early[o]["ahead"](3), M.fit_model("ETS", y[:o], 12, False)["ahead"](3)) for o in (15, 16, 23))


def test_config_and_texts(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"granularity": "weekly", "cv": {"horizon": 4}, "models": {"lookback_windows": [4]}}')
    cfg = EngineConfig.from_json(str(p))
    assert cfg.season == 52 and cfg.cv.horizon == 4 and cfg.models.lookback_windows == (4,)
    with pytest.raises(ValueError):
        EngineConfig.from_dict({"cv": {"nope": 1}})
    assert Scope().note() == "all items" and Scope(("x",), True).note() == "1 item (x), bom-listed only" and window_sweep(3, 12) == [3, 5, 7, 8, 10, 12] and window_sweep(1, 1) == [2]
    row = spark.createDataFrame([("competition_winner", "Naive", 0.5, 3)], "c string, m string, e double, n int").select(E.selection_reason(F.col("c"), F.col("m"), F.col("e"), F.col("n")).alias("t")).first()["t"]
    assert row.startswith("Naive was the most dependable") and "3 back-test windows" in row
