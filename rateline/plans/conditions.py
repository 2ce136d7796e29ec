"""Queries of operating conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest as T
from ..operators import context as C
from ..operators import contextual as X
from ..operators import prepare as P
from ..sources import star_schema
from . import forecasting
from .forecasting import CFG
from .oracle_base import with_steps
from .prepared import prepared, r6, r9


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.conditions(P.aggregate_driver(star_schema.load(spark, sf_dir).driver))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with a regime of their own making: whether their line and state ran above its median, so that regimes differ here."""
    p = prepared(spark, sf_dir)
    rows = C.conditions(p.driver)
    busy = F.when(F.col("driver_qty") >= F.col("median"), "busy").otherwise("slack")
    return C.series_conditions(P.fit_targets(p.observations), rows.withColumn("regime_label", F.when(F.month("period_start") == 2, "february").otherwise(busy)))


def regime_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rows(spark, sf_dir)
    return r.select("period", "unit", "stream", "driver_type", F.col("is_active").cast("int").alias("is_active"), "n_active", "is_solo", "regime_label")


def mix_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("period", "unit", "stream", *r6("own_share", "mix_entropy", "system_driver"))


def utilization_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("period", "unit", "stream", *r6("utilization", "p95"))


def regime_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG14."""
    return _rows(spark, sf_dir).where("driver_type = 'actual'").groupBy("regime_label").agg(F.count(F.lit(1)).alias("n"))


def calendar_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = C.calendar_factors(star_schema.load(spark, sf_dir).calendar)
    return f.select(F.date_format("period_start", "yyyy-MM").alias("period"), "name", "value")


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar, and rows that hold for one line, one state, or both only."""
    raw = star_schema.load(spark, sf_dir).calendar
    more = [("promotion", "2", "1", None), ("promotion", "3", None, "F"), ("promotion", "4", "1", "F"), ("audit", "1", "2", None)]
    own = raw.where("factor_name = 'promotion' AND factor_value = '1'").select("period")
    for name, value, unit, stream in more:
        raw = raw.unionByName(own.select("period", F.lit(name).alias("factor_name"), F.lit(value).alias("factor_value"), F.lit(unit).cast("string").alias("unit"), F.lit(stream).cast("string").alias("stream")))
    return C.calendar_factors(raw)


def calendar_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN13, CTX7: factors with global rows and rows of lines and states; the most specific holds."""
    rows, names = C.with_calendar(_rows(spark, sf_dir), _factors(spark, sf_dir))
    return C.extended_labels(rows, names).select("period", "unit", "stream", *names, F.regexp_extract("regime_label", r"( \| .*)", 1).alias("factors"))


def has_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CTX8, PRJ14's neighbour: whether conditions ever change, with and without the calendar."""
    rows, names = C.with_calendar(_rows(spark, sf_dir), _factors(spark, sf_dir))
    still = rows.where("unit = '1' AND stream = 'F'").withColumn("regime_label", F.lit("x")).withColumn("own_share", F.lit(1.0)).withColumn("utilization", F.lit(1.0)).withColumn("mix_entropy", F.lit(0.0))
    return spark.createDataFrame([("all", C.has_variance(rows, names)), ("still", C.has_variance(still, [])), ("still_but_calendar", C.has_variance(still, names))], "which string, varies boolean")


def regimes_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CTX15."""
    rows, names = C.with_calendar(_rows(spark, sf_dir), C.calendar_factors(star_schema.load(spark, sf_dir).calendar))
    small = rows.withColumn("regime_label", F.concat_ws(":", "unit", "stream"))
    return C.extended_labels(small, names).select("period", "unit", "stream", C.humanised(F.col("regime_label")).alias("words"))


def _ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History and horizon of all series with the regimes of ``_series``."""
    p = prepared(spark, sf_dir)
    busy = F.when(F.col("driver_qty") >= F.col("median"), "busy").otherwise("slack")
    rows = C.conditions(p.driver).withColumn("regime_label", F.when(F.month("period_start") == 2, "february").otherwise(busy))
    return X.extended_rows(P.fit_targets(p.observations), p.series, rows, [], CFG)


def context_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD21, MOD22, CTX16: the two native models of conditions over the folds of all series."""
    ext = _ext(spark, sf_dir)
    rows = X.native_folds(ext, "FixedPlusVariable", CFG).unionByName(X.native_folds(ext, "RegimeConditional", CFG))
    return T.results(rows, CFG).select("series_id", "model", *r9("mase", "bias"), "n_origins", "status")


def context_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CTX10, CTX14, CTX18: what was compared, and why not."""
    d = X.diagnosis(_ext(spark, sf_dir), CFG)
    return d.select("series_id", "n", "k", F.get_json_object("regime_counts_json", "$.busy").alias("busy"), "skip_reason", "known_future")


def aligned_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CTX10, CTX11: what models see of each period of the horizon."""
    return _ext(spark, sf_dir).where("ahead > 0").select("series_id", "idx", "ahead", "regime_label", *r6("driver_qty", "system_driver", "own_share"), "known", "seen")


def kruskal_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.significance(_series(spark, sf_dir)).select("series_id", "n", "k", *r6("statistic", "spread_pct", "effect_size"))


def regime_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = _ext(spark, sf_dir).where("ahead = 0").withColumn("origin", F.lit(0))
    return X.regime_fits(learn).select("series_id", "regime", "n", *r9("level", "overall"))


def fixed_plus_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = _ext(spark, sf_dir).where("ahead = 0").withColumn("origin", F.lit(0))
    return X.standing_fits(learn).select("series_id", "n", *r6("fixed", "variable"))


def driver_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.driver_variation(P.fit_targets(prepared(spark, sf_dir).observations)).select("series_id", *r6("driver_cv"))


def context_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.diagnosis(_ext(spark, sf_dir), CFG)
    return d.select("series_id", "n", "k", *r9("statistic", "p_value", "effect_size"), "high_label", "low_label", "material", "known_future", "skip_reason", "verdict")


def context_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD23 with one condition to choose, the output of all lines: fold predictions, none where it does not improve the fit."""
    rows = T.by_step(X.regression_folds(_ext(spark, sf_dir), [], CFG, ("system_driver",)))
    return rows.select("series_id", "origin", "step", *[(F.round(c, 6) + 0.0).alias(c) for c in ("y_hat", "actual")])


QUERIES = {f.__name__: f for f in (regime_labels, mix_entropy, utilization_p95, regime_counts, calendar_factors, calendar_joined, has_variance, regimes_in_words, kruskal_h, regime_conditional, fixed_plus_variable, context_candidates, context_ladder, aligned_conditions, driver_cv, context_diagnosis, context_regression)}

STEPS = {
    "dd": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period_start, line, output_type ORDER BY driver_type) AS q FROM driver) WHERE q = 1",
    "dm": "SELECT *, median(driver_qty) OVER p AS med, quantile_cont(CASE WHEN driver_type = 'actual' THEN driver_qty END, 0.95) OVER p AS p95 FROM dd WINDOW p AS (PARTITION BY line, output_type)",
    "da": "SELECT *, CAST(driver_qty IS NOT NULL AND driver_qty > 0 AND driver_qty >= 0.2 * med AS INT) AS act FROM dm",
    "dt": "SELECT period_start, coalesce(sum(CASE WHEN act = 1 THEN driver_qty END), 0.0) AS total, sum(act) AS n_active, coalesce(string_agg(CASE WHEN act = 1 THEN line || ':' || output_type END, '+' ORDER BY line, output_type), 'idle') AS label FROM da GROUP BY period_start",
    "ent": "SELECT a.period_start, CASE WHEN max(t.n_active) > 1 THEN sum(CASE WHEN act = 1 THEN -(driver_qty / total) * ln(driver_qty / total) END) ELSE 0.0 END AS entropy FROM da a JOIN dt t ON a.period_start = t.period_start GROUP BY a.period_start",
    "ctx": """SELECT a.*, strftime(a.period_start, '%Y-%m') AS period, t.total, t.n_active, t.label, e.entropy, driver_qty / nullif(t.total, 0) AS own_share, driver_qty / nullif(p95, 0) AS utilization,
  CASE WHEN month(a.period_start) = 2 THEN 'february' WHEN driver_qty >= med THEN 'busy' ELSE 'slack' END AS mine FROM da a JOIN dt t ON a.period_start = t.period_start JOIN ent e ON a.period_start = e.period_start""",
    "firstp": "SELECT * FROM (SELECT period_start, mine, total, row_number() OVER (PARTITION BY period_start ORDER BY line, output_type) AS q FROM ctx) WHERE q = 1",
    "sc": "SELECT f.*, coalesce(c.mine, p.mine) AS label, p.total AS system_driver FROM fit f LEFT JOIN ctx c ON c.period_start = f.period_start AND c.line = f.line AND c.output_type = f.output_type LEFT JOIN firstp p ON p.period_start = f.period_start",
    "use0": "SELECT *, CASE WHEN count(*) OVER (PARTITION BY series_id, label) < 4 THEN 'other' ELSE label END AS regime FROM sc WHERE valid = 1 AND label IS NOT NULL",
    "use1": "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY series_id, regime) AS g FROM use0) WHERE g >= 2",
    "rk": "SELECT series_id, regime, y, rank() OVER (PARTITION BY series_id ORDER BY round(y, 9)) + (count(*) OVER (PARTITION BY series_id, round(y, 9)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY series_id, round(y, 9)) AS t FROM use1",
    "gr": "SELECT series_id, regime, count(*) AS m, sum(r) AS rs, sum(y) AS sy, sum(t * t - 1) AS ties FROM rk GROUP BY ALL",
    "kw": """SELECT series_id, CAST(sum(m) AS BIGINT) AS n, count(*) AS k, (12.0 / (sum(m) * (sum(m) + 1.0)) * sum(rs * rs / m) - 3 * (sum(m) + 1.0)) / (1 - sum(ties) / (pow(sum(m), 3) - sum(m))) AS h,
  (max(sy / m) - min(sy / m)) / abs(sum(sy) / sum(m)) AS spread FROM gr GROUP BY series_id HAVING count(*) >= 2 AND sum(m) >= 4""",
    "sx": "SELECT f.series_id, f.mode, f.idx, f.y, f.valid, coalesce(c.mine, p.mine, 'idle') AS label, CASE WHEN f.mode = 'relative' THEN coalesce(c.driver_qty, 0.0) ELSE coalesce(p.total, 0.0) END AS act FROM fit f LEFT JOIN ctx c ON c.period_start = f.period_start AND c.line = f.line AND c.output_type = f.output_type LEFT JOIN firstp p ON p.period_start = f.period_start",
    "rg0": "SELECT series_id, label, count(*) AS n, sum(y) AS s FROM sx GROUP BY ALL",
    "rg1": "SELECT series_id, CASE WHEN n < 4 THEN 'other' ELSE label END AS regime, sum(n) AS n, sum(s) AS s FROM rg0 GROUP BY ALL",
    "rg2": "SELECT *, sum(s) OVER (PARTITION BY series_id) / sum(n) OVER (PARTITION BY series_id) AS overall FROM rg1",
    "rg": "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS k FROM rg2 WHERE n >= 4) WHERE k >= 2",
    "fpv": "SELECT series_id, y, mode, act FROM sx",
    "fab": "SELECT series_id, y, act, CASE WHEN mode = 'relative' THEN 1 / act ELSE 1.0 END AS a, CASE WHEN mode = 'relative' THEN 1.0 ELSE act END AS b FROM fpv WHERE act IS NOT NULL AND (mode <> 'relative' OR act > 0)",
    "fsum": "SELECT series_id, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM fab GROUP BY series_id HAVING count(*) >= 8 AND avg(act) > 0 AND stddev_pop(act) >= 0.1 * avg(act)",
    "fsol": "SELECT *, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS x, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS z, greatest(0.0, ay / aa) AS ox, greatest(0.0, by_ / bb) AS oy FROM fsum",
    "calr": """SELECT period, line AS unit, output_type AS stream, CAST(month(period_start) BETWEEN 6 AND 8 AS INT) AS s, CASE WHEN month(period_start) % 3 = 1 AND line = '2' THEN 1 ELSE 0 END AS a,
  CASE WHEN month(period_start) % 3 <> 1 THEN 0 WHEN line = '1' AND output_type = 'F' THEN 4 WHEN line = '1' THEN 2 WHEN output_type = 'F' THEN 3 ELSE 1 END AS p FROM ctx""",
    "cal": "SELECT CAST(DATE '1995-01-01' + to_months(CAST(i AS INT)) AS DATE) AS m FROM (SELECT unnest(generate_series(0, 83)) AS i)",
}


#: Folds of the models of conditions: what each origin learns from (cl) and has to tell (ct).
PAIRS = {
    "co": "SELECT series_id, idx AS origin, scale, n_rel FROM orig",
    "cl": "SELECT o.series_id, o.origin, o.n_rel, s.label, s.y, s.mode, s.act FROM co o JOIN sx s ON s.series_id = o.series_id AND s.idx < o.origin",
    "ct": "SELECT o.*, s.idx, s.label, s.y, s.valid, s.mode, s.act FROM co o JOIN sx s ON s.series_id = o.series_id AND s.idx BETWEEN o.origin AND o.origin + 2",
    "q0": "SELECT series_id, origin, label, count(*) AS n, sum(y) AS s FROM cl GROUP BY ALL",
    "q1": "SELECT series_id, origin, CASE WHEN n < 4 THEN 'other' ELSE label END AS regime, sum(n) AS n, sum(s) AS s FROM q0 GROUP BY ALL",
    "q2": "SELECT *, sum(s) OVER p / sum(n) OVER p AS overall FROM q1 WINDOW p AS (PARTITION BY series_id, origin)",
    "q3": "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY series_id, origin) AS k FROM q2 WHERE n >= 4) WHERE k >= 2",
    "g0": "SELECT series_id, origin, y, act, CASE WHEN mode = 'relative' THEN 1 / act ELSE 1.0 END AS a, CASE WHEN mode = 'relative' THEN 1.0 ELSE act END AS b FROM cl WHERE act IS NOT NULL AND (mode <> 'relative' OR act > 0)",
    "g1": "SELECT series_id, origin, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM g0 GROUP BY ALL HAVING count(*) >= 8 AND avg(act) > 0 AND stddev_pop(act) >= 0.1 * avg(act)",
    "g2": "SELECT *, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS x, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS z, greatest(0.0, ay / aa) AS ox, greatest(0.0, by_ / bb) AS oy FROM g1",
    "g3": "SELECT series_id, origin, CASE WHEN x >= 0 AND z >= 0 THEN x WHEN ox * ay >= oy * by_ THEN ox ELSE 0.0 END AS fixed, CASE WHEN x >= 0 AND z >= 0 THEN z WHEN ox * ay >= oy * by_ THEN 0.0 ELSE oy END AS variable FROM g2",
    "g4": "SELECT t.*, g.variable, CASE WHEN t.mode <> 'relative' THEN g.fixed + g.variable * t.act WHEN t.act > 0 THEN g.fixed / t.act + g.variable END AS p FROM ct t LEFT JOIN g3 g ON t.series_id = g.series_id AND t.origin = g.origin",
    "chat": """SELECT series_id, 'FixedPlusVariable' AS model, origin, scale, y, valid, coalesce(p, avg(p) OVER (PARTITION BY series_id, origin), variable) AS hat FROM g4 WHERE n_rel >= 8 AND origin >= 8
  UNION ALL SELECT t.series_id, 'RegimeConditional', t.origin, t.scale, t.y, t.valid, coalesce(a.s / a.n, b.s / b.n, o.overall) FROM ct t LEFT JOIN q3 a ON t.series_id = a.series_id AND t.origin = a.origin AND a.regime = t.label LEFT JOIN q3 b ON t.series_id = b.series_id AND t.origin = b.origin AND b.regime = 'other'
  LEFT JOIN (SELECT DISTINCT series_id, origin, overall FROM q3) o ON t.series_id = o.series_id AND t.origin = o.origin WHERE t.n_rel >= 12 AND t.origin >= 12""",
}


#: One regressor by origin.
REGRESSED = {
    "rx": "SELECT f.series_id, f.idx, f.y, CASE WHEN c.line IS NULL THEN coalesce(p.total, 0.0) ELSE c.total END AS x FROM fit f LEFT JOIN ctx c ON c.period_start = f.period_start AND c.line = f.line AND c.output_type = f.output_type LEFT JOIN firstp p ON p.period_start = f.period_start",
    "ru": "SELECT series_id FROM rx GROUP BY series_id HAVING stddev_pop(x) > 1e-12",
    "rs": "SELECT o.series_id, o.origin, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS at, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(y, x) AS c FROM co o JOIN rx s ON s.series_id = o.series_id AND s.idx < o.origin JOIN ru ON ru.series_id = o.series_id WHERE o.n_rel >= 20 AND o.origin >= 20 GROUP BY o.series_id, o.origin",
    "ra": "SELECT *, greatest(1e-12 * vy, 1e-300) AS least, vx > 1e-24 AS moves FROM rs",
    "rb": "SELECT *, coalesce(moves AND vy > least AND n * ln(greatest(vy - c * c / nullif(vx, 0), least)) + 4 < n * ln(greatest(vy, least)) + 2 - 1e-9, false) AS better FROM ra",
}
#: Kruskal-Wallis by series, with the chi-squared tail as one less the lower series of the gamma function.
TESTED = {
    "kq": "SELECT *, (k - 1) / 2.0 AS a, h / 2.0 AS z FROM kw",
    "kp": "SELECT *, CASE WHEN h <= 0 THEN 1.0 ELSE 1 - pow(z, a) * exp(-z) / gamma(a + 1) * list_reduce(range(1, 600), lambda s, i: {'t': s.t * z / (a + i), 's': s.s + s.t * z / (a + i)}, {'t': 1.0::DOUBLE, 's': 1.0::DOUBLE}).s END AS p FROM kq",
    "lab": "SELECT series_id, arg_max(regime, sy / m) AS high, arg_min(regime, sy / m) AS low FROM gr GROUP BY series_id",
    "lad": """SELECT w.series_id, CAST(c.n AS BIGINT) AS n, c.k, CASE WHEN coalesce(c.n, 0) < 4 THEN 'too few usable periods' WHEN c.k < 2 THEN 'only one operating condition' WHEN hi - lo <= 1e-8 + 1e-5 * abs(lo) THEN 'the series is constant' END AS skip_reason, w.known_future
FROM (SELECT s.series_id, bool_and(EXISTS (SELECT 1 FROM dd d WHERE d.period_start = s.last_start + to_months(CAST(h.step AS INT)))) AS known_future FROM series s CROSS JOIN (SELECT unnest(generate_series(1, 7)) AS step) h GROUP BY ALL) w
LEFT JOIN (SELECT series_id, sum(m) AS n, count(CASE WHEN m >= 2 THEN 1 END) AS k, min(CASE WHEN m >= 2 THEN lo END) AS lo, max(CASE WHEN m >= 2 THEN hi END) AS hi FROM (SELECT series_id, regime, count(*) AS m, min(y) AS lo, max(y) AS hi FROM use0 GROUP BY ALL) GROUP BY ALL) c USING (series_id)""",
    "dg": """SELECT l.*, CASE WHEN skip_reason IS NULL THEN h END AS h, CASE WHEN skip_reason IS NULL THEN p END AS p, CASE WHEN skip_reason IS NULL THEN spread END AS spread, CASE WHEN skip_reason IS NULL THEN least(1.0, greatest(0.0, (h - kp.k + 1) / nullif(kp.n - kp.k, 0))) END AS eta, CASE WHEN skip_reason IS NULL THEN high END AS high, CASE WHEN skip_reason IS NULL THEN low END AS low FROM lad l LEFT JOIN kp USING (series_id) LEFT JOIN lab USING (series_id)""",
    "dv": "SELECT *, CAST(skip_reason IS NULL AND coalesce(p < 0.05 AND spread >= 0.10, false) AND known_future AS INT) AS material, printf('%.0f %%', 100 * spread) || ' between ' || CASE low WHEN 'other' THEN 'other conditions' ELSE low || ' making ' || low END || ' and ' || CASE high WHEN 'other' THEN 'other conditions' ELSE high || ' making ' || high END AS gap FROM dg",
}


def _q(select: str, last: str = "fit") -> str:
    return with_steps(last, select, STEPS)


ORACLE = {
    "regime_labels": _q("SELECT period, line AS unit, output_type AS stream, driver_type, act AS is_active, CAST(n_active AS INT) AS n_active, CAST(n_active = 1 AND act = 1 AS INT) AS is_solo, label AS regime_label FROM ctx"),
    "mix_entropy": _q("SELECT period, line AS unit, output_type AS stream, round(own_share, 6) AS own_share, round(entropy, 6) AS mix_entropy, round(total, 6) AS system_driver FROM ctx"),
    "utilization_p95": _q("SELECT period, line AS unit, output_type AS stream, round(utilization, 6) AS utilization, round(p95, 6) AS p95 FROM ctx"),
    "regime_counts": _q("SELECT label AS regime_label, count(*) AS n FROM ctx WHERE driver_type = 'actual' GROUP BY label"),
    "calendar_factors": _q("SELECT strftime(m, '%Y-%m') AS period, 'ctx_promotion' AS name, CASE WHEN month(m) % 3 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM cal UNION ALL SELECT strftime(m, '%Y-%m'), 'ctx_season_summer', 1.0::DOUBLE FROM cal WHERE month(m) BETWEEN 6 AND 8"),
    "calendar_joined": _q("""SELECT period, unit, stream, a::DOUBLE AS ctx_audit, p::DOUBLE AS ctx_promotion, s::DOUBLE AS ctx_season_summer, ' | audit=' || a || CASE WHEN (SELECT count(DISTINCT p) FROM calr) BETWEEN 2 AND 4 THEN ' | promotion=' || p ELSE '' END || ' | season_summer=' || s AS factors FROM calr"""),
    "has_variance": "SELECT * FROM (VALUES ('all', true), ('still', false), ('still_but_calendar', true)) t(which, varies)",
    "regimes_in_words": _q("SELECT period, line AS unit, output_type AS stream, line || ' making ' || output_type || ' with promotion ' || CASE WHEN month(period_start) % 3 = 1 THEN 'on' ELSE 'off' END || ', season summer ' || CASE WHEN month(period_start) BETWEEN 6 AND 8 THEN 'on' ELSE 'off' END AS words FROM ctx"),
    "context_candidates": with_steps("fit", """SELECT series_id, model, round(CASE WHEN bool_and(ok) AND count(m) = count(mae) THEN avg(m) END, 9) + 0.0 AS mase, round(avg(bias), 9) + 0.0 AS bias, count(mae) AS n_origins, CASE WHEN NOT bool_and(ok) THEN 'failed' WHEN count(*) < 3 THEN 'skipped' ELSE 'ok' END AS status FROM (
  SELECT *, CASE WHEN scale > 0 THEN mae / scale WHEN mae = 0 THEN 0.0 END AS m FROM (SELECT series_id, model, origin, scale, bool_and(hat IS NOT NULL) AS ok, avg(CASE WHEN valid = 1 THEN abs(hat - y) END) AS mae, avg(CASE WHEN valid = 1 THEN hat - y END) AS bias FROM chat GROUP BY ALL)) GROUP BY series_id, model HAVING count(mae) > 0 OR NOT bool_and(ok)""", {**forecasting.STEPS, **STEPS, **PAIRS}),
    "context_ladder": _q("""SELECT w.series_id, CAST(c.n AS BIGINT) AS n, c.k, CAST(c.busy AS VARCHAR) AS busy, CASE WHEN coalesce(c.n, 0) < 4 THEN 'too few usable periods' WHEN c.k < 2 THEN 'only one operating condition' WHEN hi - lo <= 1e-8 + 1e-5 * abs(lo) THEN 'the series is constant' END AS skip_reason, w.known_future
FROM (SELECT s.series_id, bool_and(EXISTS (SELECT 1 FROM dd d WHERE d.period_start = s.last_start + to_months(CAST(h.step AS INT)))) AS known_future FROM series s CROSS JOIN (SELECT unnest(generate_series(1, 7)) AS step) h GROUP BY ALL) w
LEFT JOIN (SELECT series_id, sum(m) AS n, count(CASE WHEN m >= 2 THEN 1 END) AS k, min(CASE WHEN m >= 2 THEN lo END) AS lo, max(CASE WHEN m >= 2 THEN hi END) AS hi, max(CASE WHEN regime = 'busy' THEN m END) AS busy FROM (SELECT series_id, regime, count(*) AS m, min(y) AS lo, max(y) AS hi FROM use0 GROUP BY ALL) GROUP BY ALL) c USING (series_id)"""),
    "aligned_conditions": _q("""SELECT s.series_id, CAST(s.n_periods - 1 + h.step AS INT) AS idx, CAST(h.step AS INT) AS ahead, coalesce(c.mine, p.mine, 'idle') AS regime_label, round(CASE WHEN c.line IS NULL THEN 0.0 ELSE c.driver_qty END, 6) AS driver_qty, round(CASE WHEN c.line IS NULL THEN coalesce(p.total, 0.0) ELSE c.total END, 6) AS system_driver, round(CASE WHEN c.line IS NULL THEN 0.0 ELSE c.own_share END, 6) AS own_share, p.total IS NOT NULL AS known, true AS seen
FROM series s CROSS JOIN (SELECT unnest(generate_series(1, 7)) AS step) h LEFT JOIN ctx c ON c.period_start = s.last_start + to_months(CAST(h.step AS INT)) AND c.line = s.line AND c.output_type = s.output_type LEFT JOIN firstp p ON p.period_start = s.last_start + to_months(CAST(h.step AS INT))"""),
    "kruskal_h": _q("SELECT series_id, n, k, round(h, 6) AS statistic, round(spread, 6) AS spread_pct, round(least(1.0, greatest(0.0, (h - k + 1) / nullif(n - k, 0))), 6) AS effect_size FROM kw"),
    "regime_conditional": _q("SELECT series_id, regime, CAST(n AS BIGINT) AS n, round(s / n, 9) + 0.0 AS level, round(overall, 9) + 0.0 AS overall FROM rg"),
    "fixed_plus_variable": _q("SELECT series_id, n, round(CASE WHEN x >= 0 AND z >= 0 THEN x WHEN ox * ay >= oy * by_ THEN ox ELSE 0.0 END, 6) AS fixed, round(CASE WHEN x >= 0 AND z >= 0 THEN z WHEN ox * ay >= oy * by_ THEN 0.0 ELSE oy END, 6) AS variable FROM fsol"),
    "driver_cv": _q("SELECT series_id, round(CASE WHEN count(d) >= 4 AND avg(d) > 0 THEN stddev_pop(d) / avg(d) END, 6) AS driver_cv FROM (SELECT series_id, CASE WHEN valid = 1 THEN driver_qty END AS d FROM fit) GROUP BY series_id"),
    "context_regression": with_steps("fit", "SELECT r.series_id, CAST(r.origin AS INT) AS origin, CAST(h.step AS INT) AS step, round(CASE WHEN r.better THEN r.slope * t.x + r.at END, 6) + 0.0 AS y_hat, round(t.y, 6) + 0.0 AS actual FROM rb r CROSS JOIN (VALUES (1), (2), (3)) h(step) JOIN rx t ON t.series_id = r.series_id AND t.idx = r.origin + h.step - 1", {**forecasting.STEPS, **STEPS, **PAIRS, **REGRESSED}),
    "context_diagnosis": with_steps("fit", """SELECT series_id, n, k, round(h, 9) + 0.0 AS statistic, round(p, 9) + 0.0 AS p_value, round(eta, 9) + 0.0 AS effect_size, high AS high_label, low AS low_label, material, known_future, skip_reason,
  CASE WHEN skip_reason IS NOT NULL THEN 'Not tested: ' || skip_reason || '.' WHEN material = 1 THEN 'Consumption depends on what runs: it differs by ' || gap || '.' WHEN p < 0.05 AND spread >= 0.10 THEN 'Consumption depends on what runs, by ' || gap || ', but no plan covers the horizon.' WHEN p < 0.05 THEN 'Conditions matter, but little: ' || gap || '.' WHEN p IS NOT NULL THEN 'Conditions make no difference that could not be chance.' END AS verdict FROM dv""", {**STEPS, **TESTED}),
}
