"""Queries of accuracy, explanation, the portfolio and imports, and of the fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest as T
from ..operators import context as C
from ..operators import explain as E
from ..operators import fitted as M
from ..operators import forecast as G
from ..operators import learn as L
from ..operators import prepare as P
from ..operators import profile as B
from ..sources import star_schema
from ..staging import staged
from . import forecasting, run
from .forecasting import CFG, forecasts
from .oracle_base import with_steps
from .prepared import prepared, r6, r9


def _actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was consumed behind the cut."""
    return L.actuals(star_schema.load(spark, sf_dir, "2002-01-01").consumption)


def _accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.accuracy(forecasts(spark, sf_dir), _actuals(spark, sf_dir))


def accuracy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accuracy(spark, sf_dir).select("series_id", "period", *r6("actual_value", "forecast_value", "error", "abs_pct_error"))


def drift_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.drift(_accuracy(spark, sf_dir)).select("series_id", "n", *r6("early", "late"), "drifting")


def accuracy_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two imports of one run: the later actuals hold, what was forecast does not change."""
    rows = _accuracy(spark, sf_dir).select("series_id", "period", F.lit("r1").alias("run_id"), "forecast_value", "actual_value", "error")
    later = rows.where("period >= '2001-03'").withColumn("actual_value", F.col("actual_value") + 1).withColumn("forecast_value", F.lit(0.0)).withColumn("error", F.col("error") - 1)
    return L.upserted(rows.where("period <= '2001-05'"), later).select("series_id", "period", *r6("forecast_value", "actual_value", "error"))


def badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    prof = B.profile(p.observations).select("series_id", "data_quality", "break_period")
    chosen = p.series.select("series_id", (F.col("n_reliable") / 100).alias("confidence"))
    return E.portfolio(p.series, prof, chosen, L.drift(_accuracy(spark, sf_dir))).groupBy("badge").agg(F.count(F.lit(1)).alias("n"))


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    rows = E.expanded(p.series.select("series_id", "n_periods"))
    listed = star_schema.load(spark, sf_dir).items.where("item_code <> 'Brand#5'")
    return E.described(rows, listed)


def import_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = star_schema.load(spark, sf_dir).items.select("item_code", "uom", "cat_l1")
    new = items.limit(0).select("item_code").unionByName(items.where("item_code LIKE 'Brand#2%'").select(F.concat("item_code", F.lit("x")).alias("item_code"), F.lit(1).alias("odd")).select("item_code", "odd").drop("odd"))
    return E.extended(items, new)


def rejected_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = T.results(T.fold_rows(P.fit_targets(prepared(spark, sf_dir).observations), CFG), CFG)
    got = E.rejected_json(scored, T.winners(scored, CFG))
    listed = F.from_json("rejected", "array<struct<model:string,mase:double,reason:string>>")
    return got.select("series_id", F.size(listed).alias("n"), F.get_json_object("rejected", "$[0].model").alias("first"), F.array_join(F.transform(listed, lambda x: F.concat(x["model"], F.lit(": "), F.when(x["reason"].endswith(" % more error"), "worse").otherwise(x["reason"]))), "; ").alias("reasons"))


def validation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEL2, SEL9, ORD5: the candidates of each series in their order, unscored ones last."""
    scored = T.results(T.fold_rows(P.fit_targets(prepared(spark, sf_dir).observations), CFG), CFG)
    return E.candidate_table(scored).select("series_id", "model", "status", "rank")


def import_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET2, SET3: a table put in the place of another under its columns, and what columns were unknown."""
    items = star_schema.load(spark, sf_dir).items.select("item_code", "uom", "cat_l1")
    new = items.where("item_code LIKE 'Brand#3%'").select(F.col("cat_l1"), F.col("item_code"), F.lit(1).alias("odd"))
    return E.extended(items, new, replace=True).withColumn("unknown", F.lit(", ".join(E.unknown_columns(items, new))))


def portfolio_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    prof = B.profile(p.observations).select("series_id", "data_quality", "break_period", "pattern_class")
    chosen = p.series.select("series_id", (F.col("n_reliable") / 100).alias("confidence"))
    return E.portfolio(p.series, prof, chosen, L.drift(_accuracy(spark, sf_dir)))


def portfolio_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ6, ORD4, JN18: a view of the portfolio, filtered by badge, mode, class and confidence, sorted by data quality."""
    rows = E.portfolio_view(portfolio_rows(spark, sf_dir), badges=("review", "structural", "declining"), modes=("relative",), classes=("smooth", "erratic", "lumpy"), confidences=("low", "medium"), sort="data_quality")
    return rows.select("series_id", "badge", "mode", "pattern_class", "confidence_label", *r6("data_quality"))


def picker_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP4."""
    raw = star_schema.load(spark, sf_dir)
    return E.picker_labels(raw.items.where("item_code <> 'Brand#5'"), raw.consumption)


def drift_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL21."""
    return L.drift_warnings(L.drift(_accuracy(spark, sf_dir))).select("series_id", "code", "severity")


def caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP3, VAL20: notes on series, the model a rule of their id."""
    p = prepared(spark, sf_dir)
    fit = P.fit_targets(p.observations)
    model = F.when(F.col("item_code").endswith("1"), "Theta").when(F.col("item_code").endswith("2"), "TSB").otherwise("Naive")
    low = p.observations.groupBy("series_id").agg(F.sum("is_low_driver").alias("n_low"))
    code = F.when(F.col("model") == "TSB", "routed_tsb_obsolescence").otherwise("competition_winner")
    rows = p.series.withColumn("model", model).withColumn("reason_code", code).join(C.driver_variation(fit), "series_id", "left").join(low, "series_id", "left")
    return E.caveats(rows).select("series_id", "code", "severity")


def data_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG19: items by mode."""
    return prepared(spark, sf_dir).series.groupBy("mode").agg(F.countDistinct("item_code").alias("items"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP6: names of conditions and badges as a planner says them."""
    names = ["n_active", "ctx_promotion", "ctx_season_summer", "quality", "other"]
    return spark.createDataFrame([(n,) for n in names], "name string").select("name", E.in_words(F.col("name")).alias("said"))


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP1: the reason of each code, for all series of one route."""
    codes = ["competition_winner", "planner_override", "cold_start_standard_rate", "cold_start_category_prior", "cold_start_naive", "cold_start_zero", "routed_sba", "routed_tsb_obsolescence", "routed_zero", "else"]
    rows = spark.createDataFrame([(c,) for c in codes], "code string")
    return rows.select("code", E.selection_reason(F.col("code"), F.lit("Mean"), F.lit(0.5), F.lit(8), F.lit(4)).alias("reason"))


def run_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole competition and its forecasts, from raw rows: all candidates of CAN1-CAN3, anchors, models of conditions, ensembles, routes and cold starts; a set of forecasts for each series. Steps that several later ones read are staged, as a run stores them."""
    raw = star_schema.load(spark, sf_dir)
    p = P.build_series(raw, CFG)
    obs = staged(p.observations, "observations")
    series = staged(P.series_of(obs, raw.consumption).join(B.descriptive(B.applicable_rows(obs), CFG).select("series_id", "pattern_class"), "series_id"), "series")
    driver = staged(p.driver, "driver")
    fit = staged(P.fit_targets(obs), "fit")
    known = run.operating_conditions(fit, series, driver, raw.calendar, CFG)
    known.ext, known.diagnosis = staged(known.ext, "conditions"), staged(known.diagnosis, "diagnosis")
    rated = staged(run.with_rates(series, raw), "rated")
    flat = staged(run.single_levels(fit, rated, raw, obs, CFG), "levels")
    scored = staged(run.scored_candidates(fit, rated, CFG, known), "scored")
    chosen = staged(run.selections(rated, flat, scored, CFG), "winners")
    made = staged(run.point_forecasts(fit, chosen, flat, scored, CFG, known), "points")
    rows = G.reconstruct(G.horizon(made, series, CFG), driver, CFG)
    return rows.join(chosen.select("series_id", "route", "reason_code"), "series_id").select("series_id", "route", "reason_code", "model", "period", "step", *r6("target_value", "lower_80", "upper_95", "reconstructed_demand"))


def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.number_format(prepared(spark, sf_dir).observations, ["qty_base", "cost", "target", "driver_qty", "rate", "idx"], (("target", "rate"),))


def data_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG19."""
    c = star_schema.load(spark, sf_dir).consumption
    return c.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_code").alias("items"), F.date_format(F.min("date"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("last"), F.count("rate").alias("rated"))


def _few(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fit_targets(prepared(spark, sf_dir).observations)


def fitted_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD7-MOD9, MOD12 against each other over the same folds as the native models."""
    return T.results(M.fitted_folds(_few(spark, sf_dir), ("SES", "DampedHolt", "Theta", "Holt"), CFG), CFG).select("series_id", "model", *r9("mase", "bias"), "n_origins", "status")


QUERIES = {f.__name__: f for f in (accuracy_join, drift_flag, accuracy_upsert, badges, portfolio_filtered, identity, picker_labels, import_extend, import_replace, rejected_json, validation_table, drift_warnings, caveats, words, reasons, number_formats, data_summary, data_modes, fitted_models, run_forecasts)}

STEPS = {
    **forecasting.STEPS,
    **forecasting._fc(next(c for c in forecasting.CANDS if c.name == "MovingAverage(3)")),
    "later": "SELECT l_shipdate AS date, p_brand AS item_code, o_orderstatus AS output_type, line, l_quantity AS qty_base FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN place ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey WHERE l_shipdate < TIMESTAMP '2002-01-01'",
    "act": "SELECT item_code || '|' || line || '|' || output_type AS series_id, strftime(date, '%Y-%m') AS period, sum(qty_base) AS actual_value FROM later GROUP BY ALL",
    "acc": "SELECT f.series_id, f.period, a.actual_value, f.reconstructed_demand AS forecast_value, f.reconstructed_demand - a.actual_value AS error, CASE WHEN a.actual_value <> 0 THEN 100 * abs(f.reconstructed_demand - a.actual_value) / abs(a.actual_value) END AS abs_pct_error FROM fc f JOIN act a ON f.series_id = a.series_id AND f.period = a.period WHERE f.reconstructed_demand IS NOT NULL",
    "dr0": "SELECT series_id, abs_pct_error AS e, row_number() OVER (PARTITION BY series_id ORDER BY period, abs_pct_error) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM acc WHERE abs_pct_error IS NOT NULL",
    "dr": "SELECT series_id, count(*) AS n, avg(CASE WHEN i <= n // 2 THEN e END) AS early, avg(CASE WHEN i > n // 2 THEN e END) AS late FROM dr0 GROUP BY series_id",
    "dr2": "SELECT *, CAST(coalesce(n >= 4 AND late > 1.5 * greatest(early, 1e-9), false) AS INT) AS drifting FROM dr",
}


def _q(select: str) -> str:
    return with_steps("fit", select, STEPS)


ORACLE = {
    "accuracy_join": _q("SELECT series_id, period, round(actual_value, 6) AS actual_value, round(forecast_value, 6) AS forecast_value, round(error, 6) AS error, round(abs_pct_error, 6) AS abs_pct_error FROM acc"),
    "drift_flag": _q("SELECT series_id, n, round(early, 6) AS early, round(late, 6) AS late, drifting FROM dr2"),
    "accuracy_upsert": _q("SELECT series_id, period, round(CASE WHEN period <= '2001-05' THEN forecast_value ELSE 0.0 END, 6) AS forecast_value, round(actual_value + CASE WHEN period >= '2001-03' THEN 1 ELSE 0 END, 6) AS actual_value, round(error - CASE WHEN period >= '2001-03' THEN 1 ELSE 0 END, 6) AS error FROM acc"),
    "badges": _q(f"SELECT badge, count(*) AS n FROM (SELECT CASE WHEN {forecasting.profiled.QUALITY} < 0.6 OR s.is_orphan = 1 THEN 'quality' WHEN break_period IS NOT NULL THEN 'structural' WHEN coalesce(drifting, 0) = 1 THEN 'declining' WHEN s.n_reliable / 100 < 0.40 THEN 'review' ELSE 'ok' END AS badge FROM series s LEFT JOIN desc2 USING (series_id) LEFT JOIN outl USING (series_id) LEFT JOIN brk USING (series_id) LEFT JOIN dr2 USING (series_id)) GROUP BY badge"),
    "identity": _q("SELECT s.item_code, CASE WHEN s.item_code = 'Brand#5' THEN '(not in bom)' ELSE 'item ' || s.item_code END AS description, line, output_type, series_id, n_periods FROM series s"),
    "import_extend": with_steps("items", "SELECT item_code, uom, cat_l1 FROM items UNION ALL SELECT item_code || 'x', NULL, NULL FROM items WHERE item_code LIKE 'Brand#2%'"),
    "rejected_json": _q("SELECT series_id, CAST(count(*) AS INT) AS n, arg_min(model, (coalesce(round(mase, 9), 1e300), model)) AS first, string_agg(model || ': ' || why, '; ' ORDER BY coalesce(round(mase, 9), 1e300), model) AS reasons FROM (SELECT r.series_id, r.model, r.mase, CASE WHEN r.status = 'skipped' THEN 'too few back-test windows' WHEN r.mase IS NULL THEN 'its error is not finite' WHEN r.mase <= w.mase THEN 'as good, but less dependable' ELSE 'worse' END AS why FROM res r JOIN win1 w ON r.series_id = w.series_id WHERE r.model <> w.model) GROUP BY series_id"),
    "validation_table": _q("SELECT series_id, model, status, CAST(row_number() OVER (PARTITION BY series_id ORDER BY mase NULLS LAST, ordinal) AS INT) AS rank FROM res"),
    "import_replace": with_steps("items", "SELECT item_code, NULL::VARCHAR AS uom, cat_l1, 'odd' AS unknown FROM items WHERE item_code LIKE 'Brand#3%'"),
    "portfolio_filtered": _q(f"SELECT * FROM (SELECT s.series_id, CASE WHEN {forecasting.profiled.QUALITY} < 0.6 OR s.is_orphan = 1 THEN 'quality' WHEN break_period IS NOT NULL THEN 'structural' WHEN coalesce(drifting, 0) = 1 THEN 'declining' WHEN s.n_reliable / 100 < 0.40 THEN 'review' ELSE 'ok' END AS badge, s.mode, pattern_class, CASE WHEN s.n_reliable / 100 < 0.40 THEN 'low' WHEN s.n_reliable / 100 < 0.70 THEN 'medium' ELSE 'high' END AS confidence_label, round({forecasting.profiled.QUALITY}, 6) AS data_quality FROM series s LEFT JOIN desc2 USING (series_id) LEFT JOIN outl USING (series_id) LEFT JOIN brk USING (series_id) LEFT JOIN dr2 USING (series_id)) WHERE badge IN ('review', 'structural', 'declining') AND mode = 'relative' AND pattern_class IN ('smooth', 'erratic', 'lumpy') AND confidence_label IN ('low', 'medium')"),
    "picker_labels": with_steps("items", "SELECT DISTINCT c.item_code, c.item_code || CASE WHEN c.item_code = 'Brand#5' THEN ' (not in bom)' ELSE ': item ' || c.item_code END AS label FROM consumption c"),
    "drift_warnings": _q("SELECT series_id, 'ACCURACY_DRIFT' AS code, 'warning' AS severity FROM dr2 WHERE drifting = 1"),
    "caveats": _q("""SELECT series_id, 'SMOOTHING_BIAS_RISK' AS code, 'warning' AS severity FROM (SELECT series_id, any_value(item_code) AS item_code, count(d) AS k, avg(d) AS m, stddev_pop(d) AS sd FROM (SELECT series_id, item_code, CASE WHEN valid = 1 THEN driver_qty END AS d FROM fit) GROUP BY series_id) WHERE right(item_code, 1) = '1' AND k >= 4 AND m > 0 AND sd / m > 0.5
UNION ALL SELECT series_id, 'OBSOLESCENCE_SIGNAL', 'warning' FROM series WHERE right(item_code, 1) = '2' UNION ALL SELECT series_id, 'ORPHAN_RECONSTRUCTION', 'warning' FROM series WHERE is_orphan = 1
UNION ALL SELECT series_id, 'LOW_DRIVER_EXCLUDED', 'info' FROM obs GROUP BY series_id HAVING sum(is_low_driver) > 0"""),
    "words": "SELECT * FROM (VALUES ('n_active', 'how many lines ran'), ('ctx_promotion', 'promotion'), ('ctx_season_summer', 'season summer'), ('quality', 'its data are poor'), ('other', 'other')) t(name, said)",
    "data_modes": with_steps("series", "SELECT mode, count(DISTINCT item_code) AS items FROM series GROUP BY mode"),
    "number_formats": with_steps("obs", """SELECT u.column_name, CAST(d AS INT) AS decimals, CASE WHEN d = 0 THEN '#,##0' ELSE '#,##0.' || repeat('0', CAST(d AS BIGINT)) END AS format FROM (SELECT g, CASE WHEN NOT bool_or(v <> floor(v)) THEN 0 ELSE least(6, greatest(2, 3 - floor(log10(median(abs(nullif(v, 0))))), 0 - floor(log10(min(abs(nullif(v, 0))))))) END AS d FROM (
  SELECT unnest(['qty_base', 'cost', 'rates', 'driver_qty', 'rates', 'idx']) AS g, unnest([qty_base, cost, target, driver_qty, rate, idx]) AS v FROM obs) WHERE v IS NOT NULL GROUP BY g) JOIN (VALUES ('qty_base', 'qty_base'), ('cost', 'cost'), ('target', 'rates'), ('driver_qty', 'driver_qty'), ('rate', 'rates'), ('idx', 'idx')) u(column_name, g) USING (g)"""),
    "data_summary": with_steps("consumption", "SELECT count(*) AS n, count(DISTINCT item_code) AS items, strftime(min(date), '%Y-%m-%d') AS first, strftime(max(date), '%Y-%m-%d') AS last, count(rate) AS rated FROM consumption"),
}
