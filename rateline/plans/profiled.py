"""Queries of behaviour analytics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as B
from .oracle_base import with_steps
from .prepared import prepared, r9


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.applicable_rows(prepared(spark, sf_dir).observations)


def adi_cv2_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.descriptive(_rows(spark, sf_dir))
    return d.select("series_id", "n_y", *r9("adi", "cv2"), "pattern_class")


def descriptive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.descriptive(_rows(spark, sf_dir))
    return d.select("series_id", *r9("mean", "median", "min", "max", "std", "cv", "missing_pct", "unreliable_pct"), "n_rel")


def autocorr_lag1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.autocorrelation(_rows(spark, sf_dir)).select("series_id", *r9("autocorr_lag1"))


def trend_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT2 of all series; those of two seasons or more are null, since they are decomposed."""
    return B.trend(_rows(spark, sf_dir)).select("series_id", *r9("trend_r2"))


def trend_r2_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT2 of each year of each series as a series of its own, so that the short form has values."""
    rows = _rows(spark, sf_dir).withColumn("series_id", F.concat_ws("|", "series_id", F.year("period_start")))
    return B.trend(rows).select("series_id", *r9("trend_r2"))


def outlier_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.outlier_share(_rows(spark, sf_dir)).select("series_id", *r9("outlier_pct"))


def structural_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.structural_break(_rows(spark, sf_dir)).select("series_id", *r9("break_stat"), "break_period")


def behaviour_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.profile(prepared(spark, sf_dir).observations)
    return p.select("series_id", "pattern_class", *r9("forecastability", "data_quality", "outlier_pct", "autocorr_lag1"), "break_period")


def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG18: series by demand class."""
    return B.descriptive(_rows(spark, sf_dir)).groupBy("pattern_class").agg(F.count(F.lit(1)).alias("n"))


def decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.decomposition(_rows(spark, sf_dir))
    return d.select("series_id", *r9("trend_strength", "seasonal_strength"), "stationary")


def adf_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAT4 with one lagged difference in each series."""
    return B.stationarity(_rows(spark, sf_dir), 1).select("series_id", *r9("tau"), "stationary")


QUERIES = {f.__name__: f for f in (adi_cv2_class, descriptive_stats, autocorr_lag1, trend_r2, trend_r2_yearly, outlier_pct, structural_break, behaviour_profile, class_counts, decomposition, adf_stat)}

STEPS = {
    "app": "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY idx) AS n FROM (SELECT *, max(is_applicable) OVER (PARTITION BY series_id) AS any_app FROM obs) WHERE is_applicable = 1 OR any_app = 0",
    "d0": """SELECT series_id, count(*) AS n_rows, count(target) AS n_y, count(CASE WHEN target > 0 THEN 1 END) AS n_pos, coalesce(avg(yo), 0) AS mean, coalesce(median(yo), 0) AS median, coalesce(min(yo), 0) AS min, coalesce(max(yo), 0) AS max,
  coalesce(stddev_pop(yo), 0) AS std, avg(CASE WHEN target > 0 THEN target END) AS pm, stddev_pop(CASE WHEN target > 0 THEN target END) AS ps, avg(is_gap_filled) AS missing_pct, avg(1 - is_reliable) AS unreliable_pct,
  count(CASE WHEN yo IS NOT NULL AND is_reliable = 1 THEN 1 END) AS n_rel FROM (SELECT *, CASE WHEN is_gap_filled = 0 THEN target END AS yo FROM app) GROUP BY series_id""",
    "desc1": """SELECT *, CASE WHEN n_pos > 0 THEN n_y / n_pos END AS adi, CASE WHEN n_pos > 0 THEN pow(ps / pm, 2) END AS cv2, CASE WHEN mean > 0 THEN std / mean END AS cv FROM d0""",
    "desc2": """SELECT *, CASE WHEN n_y < 6 OR adi IS NULL THEN 'too_short' WHEN adi >= 1.32 AND cv2 >= 0.49 THEN 'lumpy' WHEN adi >= 1.32 THEN 'intermittent' WHEN cv2 >= 0.49 THEN 'erratic' ELSE 'smooth' END AS pattern_class FROM desc1""",
    "ac": """SELECT series_id, CASE WHEN count(*) >= 3 AND max(b) > min(b) AND max(CASE WHEN b IS NOT NULL THEN target END) > min(CASE WHEN b IS NOT NULL THEN target END) THEN corr(b, target) END AS autocorr_lag1
  FROM (SELECT series_id, target, lag(target) OVER (PARTITION BY series_id ORDER BY idx) AS b FROM app WHERE is_gap_filled = 0 AND target IS NOT NULL) GROUP BY series_id""",
    "o1": "SELECT series_id, target, median(target) OVER (PARTITION BY series_id) AS med FROM app WHERE target > 0",
    "o2": "SELECT series_id, abs(target - med) AS dev, median(abs(target - med)) OVER (PARTITION BY series_id) AS mad FROM o1",
    "outl": "SELECT series_id, CASE WHEN count(*) >= 4 THEN avg(CASE WHEN mad > 0 AND 0.6745 * dev > 3.5 * mad THEN 1.0 ELSE 0.0 END) ELSE 0.0 END AS outlier_pct FROM o2 GROUP BY series_id",
    "b0": "SELECT series_id, period, target, row_number() OVER w AS k, count(*) OVER (PARTITION BY series_id) AS m FROM app WHERE target IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY idx)",
    "b1": "SELECT a.series_id, a.k, a.m, any_value(a.period) AS period, count(CASE WHEN b.k < a.k THEN 1 END) AS n1, count(CASE WHEN b.k >= a.k THEN 1 END) AS n2, avg(CASE WHEN b.k < a.k THEN b.target END) AS m1, avg(CASE WHEN b.k >= a.k THEN b.target END) AS m2, var_pop(CASE WHEN b.k < a.k THEN b.target END) AS v1, var_pop(CASE WHEN b.k >= a.k THEN b.target END) AS v2 FROM b0 a JOIN b0 b ON a.series_id = b.series_id GROUP BY a.series_id, a.k, a.m",
    "b2": "SELECT *, abs(m1 - m2) / sqrt((n1 * v1 + n2 * v2) / m) AS stat FROM b1 WHERE n1 >= 4 AND n2 >= 4 AND sqrt((n1 * v1 + n2 * v2) / m) > 1e-9",
    "adf": """SELECT series_id, y, y - b AS d1, after - y AS d FROM (SELECT series_id, target AS y, lag(target) OVER w AS b, lead(target) OVER w AS after, count(*) OVER p AS n, max(target) OVER p > min(target) OVER p AS varies FROM app WHERE target IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY idx), p AS (PARTITION BY series_id)) WHERE b IS NOT NULL AND after IS NOT NULL AND n >= 8 AND varies""",
    "brk": "SELECT series_id, stat AS break_stat, CASE WHEN stat > 2.0 THEN period END AS break_period FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(stat, 9) DESC, k) AS r FROM b2) WHERE r = 1",
}
CLASS_BASE = "CASE pattern_class WHEN 'smooth' THEN 0.9 WHEN 'erratic' THEN 0.55 WHEN 'intermittent' THEN 0.5 WHEN 'lumpy' THEN 0.3 ELSE 0.2 END"
FORECASTABILITY = f"least(1.0, greatest(0.0, {CLASS_BASE} * (0.5 + 0.5 * least(1.0, n_rel / 24.0)) - least(0.3, 0.15 * greatest(0.0, coalesce(cv, 0.0) - 0.5))))"
QUALITY = "least(1.0, greatest(0.0, 1 - 0.4 * missing_pct - 0.4 * unreliable_pct - 0.2 * coalesce(outlier_pct, 0.0)))"


def _q(select: str) -> str:
    return with_steps("obs", select, STEPS)


ORACLE = {
    "adi_cv2_class": _q("SELECT series_id, n_y, round(adi, 6) AS adi, round(cv2, 6) AS cv2, pattern_class FROM desc2"),
    "descriptive_stats": _q("SELECT series_id, round(mean, 6) AS mean, round(median, 6) AS median, round(min, 6) AS min, round(max, 6) AS max, round(std, 6) AS std, round(cv, 6) AS cv, round(missing_pct, 6) AS missing_pct, round(unreliable_pct, 6) AS unreliable_pct, n_rel FROM desc2"),
    "autocorr_lag1": _q("SELECT series_id, round(autocorr_lag1, 6) AS autocorr_lag1 FROM ac"),
    "trend_r2": _q("SELECT series_id, CASE WHEN count(*) >= 4 AND count(*) < 25 THEN round(coalesce(CASE WHEN max(target) > min(target) THEN pow(corr(n, target), 2) END, 0.0), 6) END AS trend_r2 FROM app WHERE target IS NOT NULL GROUP BY series_id"),
    "trend_r2_yearly": _q("SELECT series_id || '|' || year(period_start) AS series_id, CASE WHEN count(*) >= 4 AND count(*) < 25 THEN round(coalesce(CASE WHEN max(target) > min(target) THEN pow(corr(n, target), 2) END, 0.0), 6) END AS trend_r2 FROM app WHERE target IS NOT NULL GROUP BY series_id, year(period_start)"),
    "outlier_pct": _q("SELECT series_id, round(outlier_pct, 6) AS outlier_pct FROM outl"),
    "structural_break": _q("SELECT series_id, round(break_stat, 6) AS break_stat, break_period FROM brk"),
    "behaviour_profile": _q(f"SELECT d.series_id, pattern_class, round({FORECASTABILITY}, 6) AS forecastability, round({QUALITY}, 6) AS data_quality, round(coalesce(outlier_pct, 0.0), 6) AS outlier_pct, round(autocorr_lag1, 6) AS autocorr_lag1, break_period FROM desc2 d LEFT JOIN outl USING (series_id) LEFT JOIN ac USING (series_id) LEFT JOIN brk USING (series_id)"),
    "adf_stat": _q("""SELECT series_id, round(tau, 6) AS tau, CAST(CASE WHEN tau > 2.74 THEN false WHEN tau < -18.83 THEN true WHEN tau <= -1.61 THEN 2.1659 + 1.4412 * tau + 0.038269 * tau * tau < -1.6448536269514722 ELSE 1.7339 + 0.93202 * tau - 0.12745 * tau * tau - 0.010368 * pow(tau, 3) < -1.6448536269514722 END AS INT) AS stationary FROM (
  SELECT series_id, sum(u * w) / sum(u * u) / sqrt((sum(w * w) - pow(sum(u * w), 2) / sum(u * u)) / (count(*) - 3) / sum(u * u)) AS tau FROM (
    SELECT r.series_id, r.y - (f.s1 * r.d1 + f.i1) AS u, r.d - (f.s2 * r.d1 + f.i2) AS w FROM adf r JOIN (SELECT series_id, regr_slope(y, d1) AS s1, regr_intercept(y, d1) AS i1, regr_slope(d, d1) AS s2, regr_intercept(d, d1) AS i2 FROM adf GROUP BY series_id) f USING (series_id)) GROUP BY series_id)"""),
    "class_counts": _q("SELECT pattern_class, count(*) AS n FROM desc2 GROUP BY pattern_class"),
}

# Means of decimals may have an exact 5 behind the sixth place, which sums in another order round apart.
ORACLE = {k: re.sub(r", 6\)( END)? AS", r", 9) + 0.0\1 AS", v) for k, v in ORACLE.items()}
