"""Queries of back-testing, selection, forecasts and roll-ups."""

from __future__ import annotations

import re
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig, Forecast
from ..functions.stats import normal_quantile
from ..operators import backtest as T
from ..operators import forecast as G
from ..operators import prepare as P
from ..operators import profile as B
from ..sources import star_schema
from . import profiled
from .oracle_base import with_steps
from .prepared import demand_gaps, prepared, r6, r9

#: The driver's plan covers 8 months.
CFG = replace(EngineConfig(), forecast=Forecast(horizon=7))


def _fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fit_targets(prepared(spark, sf_dir).observations)


def _model(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold predictions of one model."""
    rows = T.folds(_fit(spark, sf_dir), CFG, {name})
    return rows.select("series_id", "origin", "step", *r9("y_hat", "actual"))


def mase_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.results(T.fold_rows(_fit(spark, sf_dir), CFG), CFG).select("series_id", "model", *r9("mase", "mae", "rmse", "mape", "smape", "bias", "stability"), "n_origins", "status")


def ensemble_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.competition(T.fold_rows(_fit(spark, sf_dir), CFG), CFG).where("model = 'Ensemble'").select("series_id", "n_params", "n_origins", *r9("mase", "stability", "bias"))


def winner_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners among the models that are window frames, and ensembles of them; whole runs (``run_forecasts``) have all candidates."""
    return T.winners(T.competition(T.fold_rows(_fit(spark, sf_dir), CFG), CFG), CFG).select("series_id", "model", *r9("mase"))


def top_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD3: the five models that win most series."""
    return winner_rank(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "model").limit(5)


def _rated(spark: SparkSession, sf_dir: str) -> tuple[P.Prepared, DataFrame]:
    """Series with their class and engineered rate."""
    raw = star_schema.load(spark, sf_dir)
    p = P.build_series(raw)
    cls = B.descriptive(B.applicable_rows(p.observations)).select("series_id", "pattern_class")
    std = raw.standard_rates.select("item_code", "line", "output_type", "std_rate")
    return p, p.series.join(cls, "series_id").join(std, ["item_code", "line", "output_type"], "left")


def candidate_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAN1-CAN4, BT1, PRJ8: who may compete for each series, or be routed to."""
    return T.candidate_sets(_rated(spark, sf_dir)[1], CFG).select("series_id", "route", "model", F.coalesce("ordinal", F.lit(-1)).alias("ordinal"))


def anchor_competes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEL1, MOD18: the engineered rate back-tested beside the mean."""
    p, rated = _rated(spark, sf_dir)
    fit = P.fit_targets(p.observations).join(rated.select("series_id", F.when(F.col("mode") == "relative", F.col("std_rate")).alias("anchor")), "series_id")
    got = T.results(T.fold_rows(fit, CFG, {"StandardRateAnchor", "Mean"}), CFG)
    return got.select("series_id", "model", *r9("mase", "bias"), "n_origins", "status")


def croston_sba(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.croston(_fit(spark, sf_dir)).select("series_id", *r9("size", "interval", "croston", "sba"))


def tsb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tsb(_fit(spark, sf_dir)).select("series_id", *r9("probability", "size", "tsb"))


def intermittent_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = _fit(spark, sf_dir)
    gaps = demand_gaps(fit).join(fit.groupBy("series_id").agg(F.max(F.col("y") > 0).alias("some")), "series_id")
    return gaps.select("series_id", T.intermittent_route(F.col("trailing_zeros"), F.col("median_interval"), F.col("some")).alias("route"))


def history_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BT1, AGG18: how many series compete, start cold, or are routed."""
    p = prepared(spark, sf_dir)
    cls = B.descriptive(B.applicable_rows(p.observations)).select("series_id", "pattern_class")
    return p.series.join(cls, "series_id").select(T.gate(F.col("n_reliable"), F.col("pattern_class")).alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def category_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    return T.category_priors(p.series, p.observations, star_schema.load(spark, sf_dir).items).select("mode", "level", "category", *r9("prior"), "n_items")


def prior_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, items = prepared(spark, sf_dir), star_schema.load(spark, sf_dir).items
    return T.prior_ladder(p.series, items, T.category_priors(p.series, p.observations, items)).select("series_id", *r9("prior"), "level")


def cold_start_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = star_schema.load(spark, sf_dir)
    p = P.build_series(raw)
    fit = P.fit_targets(p.observations).groupBy("series_id").agg(F.max_by("y", "idx").alias("last"))
    prior = T.prior_ladder(p.series, raw.items, T.category_priors(p.series, p.observations, raw.items))
    rows = p.series.join(raw.standard_rates.select("item_code", "line", "output_type", "std_rate"), ["item_code", "line", "output_type"], "left").join(prior, "series_id", "left").join(fit, "series_id")
    got = rows.select("series_id", T.cold_start(F.col("mode") == "relative", F.col("std_rate"), F.col("prior"), F.col("last")).alias("c"))
    return got.select("series_id", "c.model", (F.round("c.level", 9) + 0.0).alias("level"))


def forecasts(spark: SparkSession, sf_dir: str, model: str = "MovingAverage(3)") -> DataFrame:
    p = prepared(spark, sf_dir)
    fit = P.fit_targets(p.observations)
    fits = G.final_fits(fit, p.series.select("series_id", F.lit(model).alias("model")), CFG, {model})
    return G.reconstruct(G.generate(fits, p.series, CFG), p.driver, CFG)


def forecast_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(spark, sf_dir).select("series_id", "period", "step", *r9("target_value", *G.BANDS))


def drift_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD3: bands that widen with the root of the step."""
    return forecasts(spark, sf_dir, "Drift").select("series_id", "period", *r9("target_value", *G.BANDS))


def reconstruct_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(spark, sf_dir).select("series_id", "period", *r9("driver_plan", "reconstructed_demand", "demand_lower_80", "demand_upper_95"))


def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    best = T.winners(T.results(T.fold_rows(P.fit_targets(p.observations), CFG), CFG), CFG).select("series_id", "mase")
    made = p.series.join(B.profile(p.observations, CFG).select("series_id", "forecastability", "data_quality"), "series_id").join(best, "series_id", "left")
    score = G.confidence_score(F.col("mase"), F.col("n_reliable"), F.col("forecastability"), F.col("data_quality"), F.lit(False))
    return made.select("series_id", (F.round(score, 9) + 0.0).alias("confidence"), G.confidence_label(score).alias("label"))


PICK = ["n_series", "demand", "demand_lower_80", "demand_upper_95", "driver_plan", "rate", "rate_lower_80"]


def _picker(dims: list[str], spark: SparkSession, sf_dir: str, filters: dict | None = None) -> DataFrame:
    got = G.roll_up_forecasts(forecasts(spark, sf_dir), dims, filters)
    return got.select("period", *dims, "n_series", *r6(*PICK[1:]))


def picker_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picker(["line"], spark, sf_dir, {"item_code": ["Brand#11", "Brand#2"], "output_type": []})


def picker_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cube_demand(forecasts(spark, sf_dir)).select("period", "item_code", "line", "output_type", "n_series", *r6("demand"))


def _history(dims: list[str], spark: SparkSession, sf_dir: str) -> DataFrame:
    got = G.roll_up_observations(prepared(spark, sf_dir).observations, dims)
    return got.select("period", *dims, "n_series", *r6("qty_base", "rate", "driver_qty"))


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand of each line in each coming month, from series to roll-up."""
    return _picker(["line"], spark, sf_dir)


MODELS = {"bt_naive": "Naive", "bt_snaive": "SeasonalNaive", "bt_drift": "Drift", "bt_mean": "Mean", "bt_ma3": "MovingAverage(3)", "bt_wma3": "WeightedMovingAverage(3)", "bt_ma12": "MovingAverage(12)", "bt_wma6": "WeightedMovingAverage(6)"}
PICKERS = {"picker_by_line": ["line"], "picker_by_item_output": ["item_code", "output_type"], "picker_all": [], "picker_atomic": ["item_code", "line", "output_type"]}
HISTORY = {"history_by_line": ["line"], "history_by_item": ["item_code"], "history_all": []}

QUERIES = {
    **{k: partial(_model, v) for k, v in MODELS.items()},
    **{f.__name__: f for f in (mase_by_model, ensemble_score, winner_rank, top_models, candidate_sets, anchor_competes, croston_sba, tsb, intermittent_routing, history_gate, category_priors, prior_ladder, cold_start_ladder, forecast_intervals, drift_intervals, reconstruct_demand, confidence_scores, picker_filtered, picker_cube)},
    **{k: partial(_picker, v) for k, v in PICKERS.items()},
    **{k: partial(_history, v) for k, v in HISTORY.items()},
}


def _mean(w: int | None, recency: bool = False) -> str:
    """A (weighted) mean of what stands before a row, over w rows or all."""
    f = f"(PARTITION BY series_id ORDER BY idx ROWS BETWEEN {w if w else 'UNBOUNDED'} PRECEDING AND 1 PRECEDING)"
    if recency:
        return f"""CASE WHEN sum(wt) OVER {f} > 0 THEN (sum(idx * wt * y) OVER {f} - (idx - {w} - 1) * sum(wt * y) OVER {f}) / (sum(idx * wt) OVER {f} - (idx - {w} - 1) * sum(wt) OVER {f})
    ELSE (sum(idx * y) OVER {f} - (idx - {w} - 1) * sum(y) OVER {f}) / {w * (w + 1) / 2} END"""
    return f"CASE WHEN sum(wt) OVER {f} > 0 THEN sum(wt * y) OVER {f} / sum(wt) OVER {f} ELSE avg(y) OVER {f} END"


W = "(PARTITION BY series_id ORDER BY idx)"
W0 = "(PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
CANDS = T.candidates(CFG)


def _level(c: T.Candidate) -> str:
    if c.name in ("Naive", "Drift"):
        return f"lag(y) OVER {W}"
    if c.seasonal:
        return "NULL"
    return _mean(c.window, c.name.startswith("Weighted"))


STEPS = {
    **profiled.STEPS,
    "sent": "SELECT series_id, idx, y, valid, coalesce(weight, 0.0) AS wt FROM fit UNION ALL SELECT series_id, max(idx) + 1, NULL, 0, 0.0 FROM fit GROUP BY series_id",
    "diff": f"SELECT *, abs(y - lag(y) OVER {W}) AS dy, max(idx) OVER (PARTITION BY series_id) AS n, sum(valid) OVER (PARTITION BY series_id) AS n_rel FROM sent",
    "lv": "SELECT series_id, idx, n, n_rel, y, valid, avg(dy) OVER " + W0 + " AS scale, " + ", ".join(f"{_level(c)} AS l{c.ordinal}" for c in CANDS if not c.seasonal) + f", (lag(y) OVER {W} - first_value(y) OVER {W}) / nullif(idx - 1, 0) AS slope FROM diff",
    "cand": "SELECT * FROM (VALUES " + ", ".join(f"('{c.name}', {c.ordinal}, {c.n_params}, {max(c.min_history, 2)}, {max(c.min_history, c.reliable)})" for c in CANDS) + ") t(model, ordinal, n_params, least, rel)",
    "orig": "SELECT * FROM lv WHERE idx <= n - 3 AND idx >= n - 3 - 8 + 1",
    "folds": "SELECT o.series_id, c.model, c.ordinal, c.n_params, o.idx AS origin, s.step, o.scale, a.y AS actual, a.valid, CASE c.model " + " ".join(f"WHEN '{c.name}' THEN " + ("z.y" if c.seasonal else f"o.l{c.ordinal}" + (" + o.slope * s.step" if c.grows else "")) for c in CANDS) + """ END AS y_hat
  FROM orig o JOIN cand c ON o.idx >= c.least AND o.n_rel >= c.rel CROSS JOIN (VALUES (1), (2), (3)) s(step) JOIN sent a ON a.series_id = o.series_id AND a.idx = o.idx + s.step - 1 LEFT JOIN sent z ON z.series_id = o.series_id AND z.idx = o.idx + s.step - 1 - 12""",
    "fs": """SELECT series_id, model, ordinal, n_params, origin, scale, avg(abs(y_hat - actual)) AS mae, sqrt(avg(pow(y_hat - actual, 2))) AS rmse, avg(y_hat - actual) AS bias, 100 * avg(CASE WHEN actual <> 0 THEN abs(y_hat - actual) / abs(actual) END) AS mape,
  100 * avg(CASE WHEN abs(actual) + abs(y_hat) <> 0 THEN 2 * abs(y_hat - actual) / (abs(actual) + abs(y_hat)) END) AS smape FROM folds WHERE valid = 1 AND y_hat IS NOT NULL GROUP BY ALL""",
    "fs2": "SELECT *, CASE WHEN scale > 0 THEN mae / scale WHEN mae = 0 THEN 0.0 END AS mase FROM fs",
    "res": """SELECT f.series_id, f.model, f.ordinal, f.n_params, CASE WHEN count(mase) = count(*) THEN avg(mase) END AS mase, CASE WHEN count(mase) = count(*) THEN stddev_pop(mase) END AS stability, avg(mae) AS mae, avg(rmse) AS rmse, avg(mape) AS mape, avg(smape) AS smape, avg(bias) AS bias, count(*) AS n_origins,
  CASE WHEN max(t.tried) < 3 THEN 'skipped' ELSE 'ok' END AS status FROM fs2 f JOIN (SELECT series_id, model, count(DISTINCT origin) AS tried FROM folds GROUP BY ALL) t ON f.series_id = t.series_id AND f.model = t.model GROUP BY f.series_id, f.model, f.ordinal, f.n_params""",
    "top3": "SELECT *, min(mase) OVER p AS best, max(mase) OVER p AS worst, count(*) OVER p AS k, sum(n_params) OVER p AS params FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mase, ordinal) AS r FROM res WHERE status = 'ok' AND mase IS NOT NULL) WHERE r <= 3 WINDOW p AS (PARTITION BY series_id)",
    "mix": "SELECT f.series_id, f.origin, f.step, f.actual, f.valid, f.scale, t.k, t.params, avg(f.y_hat) AS y_hat FROM folds f JOIN top3 t ON f.series_id = t.series_id AND f.model = t.model WHERE t.k >= 2 AND t.best > 0 AND t.worst - t.best <= 0.10 * t.best GROUP BY ALL HAVING count(*) = t.k",
    "mixf": "SELECT series_id, params, origin, scale, avg(abs(y_hat - actual)) AS mae, avg(y_hat - actual) AS bias FROM mix WHERE valid = 1 GROUP BY ALL",
    "ens": "SELECT series_id, 'Ensemble' AS model, CAST(params AS INT) AS n_params, avg(mae / scale) AS mase, stddev_pop(mae / scale) AS stability, avg(bias) AS bias, count(*) AS n_origins FROM mixf WHERE scale > 0 GROUP BY ALL HAVING count(*) >= 3",
    "pool": "SELECT *, min(mase) OVER (PARTITION BY series_id) AS best FROM (SELECT series_id, model, n_params, mase, stability, bias FROM res WHERE status = 'ok' AND mase IS NOT NULL UNION ALL SELECT series_id, model, n_params, mase, stability, bias FROM ens)",
    "win": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(stability, 6), round(abs(bias), 9), n_params, model) AS r FROM pool WHERE mase <= CASE WHEN best > 0 THEN best * 1.05 ELSE 0.05 END) WHERE r = 1",
    "pool1": "SELECT *, min(mase) OVER (PARTITION BY series_id) AS best FROM res WHERE status = 'ok' AND mase IS NOT NULL",
    "win1": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(stability, 6), round(abs(bias), 9), n_params, model) AS r FROM pool1 WHERE mase <= CASE WHEN best > 0 THEN best * 1.05 ELSE 0.05 END) WHERE r = 1",
    "prior": """SELECT mode, level, category, avg(m) AS prior, count(DISTINCT item_code) AS n_items FROM (SELECT s.mode, s.item_code, o.m, l.level, CASE l.level WHEN 1 THEN cat_l1 WHEN 2 THEN cat_l2 ELSE cat_l3 END AS category
  FROM series s JOIN (SELECT series_id, avg(target) AS m FROM obs WHERE is_reliable = 1 GROUP BY series_id) o USING (series_id) JOIN items i ON s.item_code = i.item_code CROSS JOIN (VALUES (1), (2), (3)) l(level) WHERE s.n_reliable >= 6) GROUP BY ALL""",
    "ladder": """SELECT s.series_id, coalesce(a.prior, b.prior, c.prior) AS prior, CASE WHEN a.prior IS NOT NULL THEN 3 WHEN b.prior IS NOT NULL THEN 2 WHEN c.prior IS NOT NULL THEN 1 END AS level FROM series s JOIN items i ON s.item_code = i.item_code
  LEFT JOIN prior a ON a.level = 3 AND a.mode = s.mode AND a.category = i.cat_l3 LEFT JOIN prior b ON b.level = 2 AND b.mode = s.mode AND b.category = i.cat_l2 LEFT JOIN prior c ON c.level = 1 AND c.mode = s.mode AND c.category = i.cat_l1""",
}


def _fc(model: T.Candidate) -> dict[str, str]:
    k = model.ordinal
    z80, z95 = normal_quantile(0.9), normal_quantile(0.975)
    grow = "sqrt(step)" if model.grows else "1.0"
    last = "max(CASE WHEN idx = n THEN slope END) OVER (PARTITION BY series_id)" if model.grows else "0.0"
    return {
        "ff0": f"SELECT *, y - (l{k} + {last}) AS miss FROM lv",
        "ff": f"SELECT series_id, max(CASE WHEN idx = n THEN l{k} END) AS level, max(CASE WHEN idx = n THEN slope END) AS slope, CASE WHEN count(miss) >= 2 THEN stddev_pop(miss) ELSE stddev_pop(y) END AS sigma FROM ff0 GROUP BY series_id",
        "fp": f"SELECT s.series_id, s.item_code, s.line, s.output_type, s.mode, CAST(s.last_start + to_months(CAST(h.step AS INT)) AS DATE) AS period_start, h.step, f.level {'+ f.slope * h.step' if model.grows else ''} AS p, f.sigma * {grow} AS wide FROM ff f JOIN series s USING (series_id) CROSS JOIN (SELECT unnest(generate_series(1, 7)) AS step) h",
        "fc0": f"SELECT *, strftime(period_start, '%Y-%m') AS period, greatest(p, 0.0) AS target_value, least(greatest(p - {z80!r} * wide, 0.0), greatest(p, 0.0)) AS lower_80, greatest(greatest(p + {z80!r} * wide, 0.0), greatest(p, 0.0)) AS upper_80 FROM fp",
        "fc1": f"SELECT *, least(greatest(p - {z95!r} * wide, 0.0), lower_80) AS lower_95, greatest(greatest(p + {z95!r} * wide, 0.0), upper_80) AS upper_95 FROM fc0",
        "fc2": "SELECT f.*, CASE WHEN f.mode = 'relative' THEN d.driver_qty END AS driver_plan, CASE WHEN f.mode = 'relative' THEN d.driver_qty ELSE day(last_day(f.period_start)) END AS x FROM fc1 f LEFT JOIN driver d ON d.driver_type = 'plan' AND d.period_start = f.period_start AND d.line = f.line AND d.output_type = f.output_type",
        "fc": "SELECT *, target_value * x AS reconstructed_demand, lower_80 * x AS demand_lower_80, upper_95 * x AS demand_upper_95 FROM fc2",
    }


def _q(select: str, model: str = "MovingAverage(3)") -> str:
    return with_steps("fit", select, {**STEPS, **_fc(next(c for c in CANDS if c.name == model))})


def _pick(dims: list[str], where: str = "true") -> str:
    g = "".join(f", {d}" for d in dims)
    once = ", ".join(dict.fromkeys(["period", *dims, "line", "output_type"]))
    same = " AND ".join(f"a.{d} IS NOT DISTINCT FROM b.{d}" for d in ["period", *dims])
    return _q(f"""SELECT a.*, b.driver_plan FROM (SELECT period{g}, count(DISTINCT series_id) AS n_series, round(coalesce(sum(reconstructed_demand), 0.0), 6) AS demand, round(coalesce(sum(demand_lower_80), 0.0), 6) AS demand_lower_80, round(coalesce(sum(demand_upper_95), 0.0), 6) AS demand_upper_95,
  round(CASE WHEN sum(driver_plan) > 0 THEN sum(target_value * driver_plan) / sum(driver_plan) END, 6) AS rate, round(CASE WHEN sum(driver_plan) > 0 THEN sum(lower_80 * driver_plan) / sum(driver_plan) END, 6) AS rate_lower_80 FROM fc WHERE {where} GROUP BY period{g}) a
JOIN (SELECT period{g}, round(coalesce(sum(one), 0.0), 6) AS driver_plan FROM (SELECT {once}, max(driver_plan) AS one FROM fc WHERE {where} GROUP BY {once}) GROUP BY period{g}) b ON {same}""")


def _hist(dims: list[str]) -> str:
    g = "".join(f", {d}" for d in dims)
    once = ", ".join(dict.fromkeys(["period", *dims, "line", "output_type"]))
    same = " AND ".join(f"a.{d} IS NOT DISTINCT FROM b.{d}" for d in ["period", *dims])
    return with_steps("obs", f"""SELECT a.*, b.driver_qty FROM (SELECT period{g}, count(DISTINCT series_id) AS n_series, round(sum(qty_base), 6) AS qty_base, round(CASE WHEN sum(CASE WHEN rate IS NOT NULL THEN driver_qty END) > 0 THEN sum(rate * driver_qty) / sum(CASE WHEN rate IS NOT NULL THEN driver_qty END) END, 6) AS rate FROM obs GROUP BY period{g}) a
JOIN (SELECT period{g}, round(coalesce(sum(one), 0.0), 6) AS driver_qty FROM (SELECT {once}, max(driver_qty) AS one FROM obs GROUP BY {once}) GROUP BY period{g}) b ON {same}""")


ALL_ROWS = ", ".join([f"('compete', '{c.name}', {c.ordinal}, {max(c.min_history, c.reliable)}, {c.below or 1_000_000})" for c in T.all_candidates(CFG) if c.kind in ("frame", "fitted")] + [f"('anchor', '{T.ANCHOR.name}', {T.ANCHOR.ordinal}, 0, 1000000)"] + [f"('routed', '{n}', {i}, 0, 1000000)" for i, n in enumerate(T.INTERMITTENT)])
BAND_SQL = "round(target_value, 6) AS target_value, round(lower_80, 6) AS lower_80, round(upper_80, 6) AS upper_80, round(lower_95, 6) AS lower_95, round(upper_95, 6) AS upper_95"
SCORE = f"coalesce(0.35 / (1 + mase), 0.14) + 0.30 * least(1.0, n_reliable / 24.0) + 0.20 * {profiled.FORECASTABILITY} + 0.15 * {profiled.QUALITY}"

ORACLE = {
    **{k: _q(f"SELECT series_id, CAST(origin AS INT) AS origin, step, round(y_hat, 6) AS y_hat, round(actual, 6) AS actual FROM folds WHERE model = '{v}'") for k, v in MODELS.items()},
    "mase_by_model": _q("SELECT series_id, model, round(mase, 6) AS mase, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape, 6) AS mape, round(smape, 6) AS smape, round(bias, 6) AS bias, round(stability, 6) AS stability, n_origins, status FROM res"),
    "ensemble_score": _q("SELECT series_id, n_params, n_origins, round(mase, 6) AS mase, round(stability, 6) AS stability, round(bias, 6) AS bias FROM ens"),
    "winner_rank": _q("SELECT series_id, model, round(mase, 6) AS mase FROM win"),
    "top_models": _q("SELECT model, count(*) AS n FROM win GROUP BY model ORDER BY n DESC, model LIMIT 5"),
    "croston_sba": _q("""SELECT series_id, round(size, 6) AS size, round(iv, 6) AS interval, round(size / iv, 6) AS croston, round(size / iv * 0.95, 6) AS sba FROM (
  SELECT series_id, pow(0.9, max(k)) * avg(y) + sum(0.1 * pow(0.9, k - i) * y) AS size, greatest(1.0, pow(0.9, max(k)) * avg(gap) + sum(0.1 * pow(0.9, k - i) * gap)) AS iv FROM (
    SELECT series_id, y, row_number() OVER w AS i, count(*) OVER (PARTITION BY series_id) AS k, idx - coalesce(lag(idx) OVER w, -1) AS gap FROM fit WHERE y > 0 WINDOW w AS (PARTITION BY series_id ORDER BY idx)) GROUP BY series_id)"""),
    "tsb": _q("""SELECT series_id, round(p, 6) AS probability, round(size, 6) AS size, round(p * size, 6) AS tsb FROM (
  SELECT series_id, pow(0.9, max(n)) * avg(hit) + sum(0.1 * pow(0.9, n - 1 - idx) * hit) AS p, coalesce(pow(0.85, max(k)) * avg(CASE WHEN hit = 1 THEN y END) + sum(CASE WHEN hit = 1 THEN 0.15 * pow(0.85, k - i) * y END), 0.0) AS size FROM (
    SELECT series_id, idx, y, CAST(y > 0 AS INT) AS hit, count(*) OVER p AS n, sum(CAST(y > 0 AS INT)) OVER p AS k, sum(CAST(y > 0 AS INT)) OVER (PARTITION BY series_id ORDER BY idx) AS i FROM fit WINDOW p AS (PARTITION BY series_id)) GROUP BY series_id)"""),
    "intermittent_routing": _q("""SELECT series_id, CASE WHEN max(y) <= 0 THEN 'ZeroForecast' WHEN count(*) - 1 - coalesce(max(CASE WHEN y > 0 THEN idx END), -1) >= greatest(4.0, 2 * coalesce(median(CASE WHEN y > 0 THEN idx - prev END), 0.0)) THEN 'TSB' ELSE 'SBA' END AS route
FROM (SELECT series_id, idx, y, max(CASE WHEN y > 0 THEN idx END) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM fit) GROUP BY series_id"""),
    "history_gate": _q("SELECT CASE WHEN pattern_class IN ('intermittent', 'lumpy') THEN 'routed' WHEN n_reliable < 6 THEN 'cold_start' ELSE 'compete' END AS route, count(*) AS n FROM series JOIN desc2 USING (series_id) GROUP BY 1"),
    "candidate_sets": _q(f"""SELECT s.series_id, CASE WHEN pattern_class IN ('intermittent', 'lumpy') THEN 'routed' WHEN n_reliable < 6 THEN 'cold_start' ELSE 'compete' END AS route, a.model, coalesce(a.ordinal, -1) AS ordinal FROM series s JOIN desc2 USING (series_id) LEFT JOIN std r ON s.item_code = r.item_code AND s.line = r.line AND s.output_type = r.output_type
  LEFT JOIN (SELECT * FROM (VALUES {ALL_ROWS}) t(way, model, ordinal, least, below)) a ON CASE WHEN pattern_class IN ('intermittent', 'lumpy') THEN a.way = 'routed' WHEN n_reliable < 6 THEN false WHEN a.way = 'anchor' THEN s.mode = 'relative' AND r.std_rate IS NOT NULL ELSE a.way = 'compete' AND n_reliable >= a.least AND n_reliable < a.below END"""),
    "anchor_competes": _q("""SELECT series_id, model, round(mase, 6) AS mase, round(bias, 6) AS bias, n_origins, status FROM res WHERE model = 'Mean'
UNION ALL SELECT series_id, 'StandardRateAnchor', round(CASE WHEN count(m) = count(*) THEN avg(m) END, 9) + 0.0, round(avg(bias), 9) + 0.0, count(*), CASE WHEN max(tried) < 3 THEN 'skipped' ELSE 'ok' END FROM (
  SELECT *, CASE WHEN scale > 0 THEN mae / scale WHEN mae = 0 THEN 0.0 END AS m FROM (SELECT o.series_id, o.idx, o.scale, max(o.tried) AS tried, avg(abs(r.std_rate - a.y)) AS mae, avg(r.std_rate - a.y) AS bias FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS tried FROM orig WHERE idx >= 2) o JOIN series s USING (series_id)
    JOIN std r ON s.mode = 'relative' AND s.item_code = r.item_code AND s.line = r.line AND s.output_type = r.output_type JOIN sent a ON a.series_id = o.series_id AND a.idx BETWEEN o.idx AND o.idx + 2 AND a.valid = 1 GROUP BY o.series_id, o.idx, o.scale)) GROUP BY series_id"""),
    "category_priors": _q("SELECT mode, level, category, round(prior, 6) AS prior, n_items FROM prior"),
    "prior_ladder": _q("SELECT series_id, round(prior, 6) AS prior, level FROM ladder"),
    "cold_start_ladder": _q("""SELECT s.series_id, CASE WHEN s.mode = 'relative' AND r.std_rate IS NOT NULL THEN 'StandardRateAnchor' WHEN l.prior IS NOT NULL THEN 'CategoryPrior' WHEN f.y <> 0 THEN 'Naive' ELSE 'ZeroForecast' END AS model,
  round(CASE WHEN s.mode = 'relative' AND r.std_rate IS NOT NULL THEN r.std_rate WHEN l.prior IS NOT NULL THEN l.prior WHEN f.y <> 0 THEN f.y ELSE 0.0 END, 6) AS level FROM series s LEFT JOIN std r ON s.item_code = r.item_code AND s.line = r.line AND s.output_type = r.output_type
  LEFT JOIN ladder l USING (series_id) JOIN (SELECT series_id, y, row_number() OVER (PARTITION BY series_id ORDER BY idx DESC) AS q FROM fit) f ON f.series_id = s.series_id AND f.q = 1"""),
    "forecast_intervals": _q(f"SELECT series_id, period, CAST(step AS INT) AS step, {BAND_SQL} FROM fc"),
    "drift_intervals": _q(f"SELECT series_id, period, {BAND_SQL} FROM fc", "Drift"),
    "reconstruct_demand": _q("SELECT series_id, period, round(driver_plan, 6) AS driver_plan, round(reconstructed_demand, 6) AS reconstructed_demand, round(demand_lower_80, 6) AS demand_lower_80, round(demand_upper_95, 6) AS demand_upper_95 FROM fc"),
    "confidence_scores": _q(f"SELECT series_id, round(c, 6) AS confidence, CASE WHEN c < 0.40 THEN 'low' WHEN c < 0.70 THEN 'medium' ELSE 'high' END AS label FROM (SELECT series_id, {SCORE} AS c FROM desc2 JOIN (SELECT series_id, n_reliable FROM series) USING (series_id) LEFT JOIN outl USING (series_id) LEFT JOIN (SELECT series_id, mase FROM win1) USING (series_id))"),
    "picker_filtered": _pick(["line"], "item_code IN ('Brand#11', 'Brand#2')"),
    "picker_cube": _q("SELECT period, item_code, line, output_type, count(DISTINCT series_id) AS n_series, round(coalesce(sum(reconstructed_demand), 0.0), 6) AS demand FROM fc GROUP BY GROUPING SETS ((period, item_code, line, output_type), (period, item_code, line), (period, item_code, output_type), (period, line, output_type), (period, item_code), (period, line), (period, output_type), (period))"),
    **{k: _pick(v) for k, v in PICKERS.items()},
    **{k: _hist(v) for k, v in HISTORY.items()},
}

ORACLE = {k: v if k.startswith(("picker", "history_by", "history_all")) else re.sub(r", 6\) AS", ", 9) + 0.0 AS", v) for k, v in ORACLE.items()}
