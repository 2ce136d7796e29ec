"""Queries over the tables and series themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prepare as P
from ..sources import star_schema
from .oracle_base import with_steps


def prepared(spark: SparkSession, sf_dir: str) -> P.Prepared:
    return P.build_series(star_schema.load(spark, sf_dir))


def r6(*cols: str) -> list:
    return [F.round(c, 6).alias(c) for c in cols]


def r9(*cols: str) -> list:
    """For values whose sixth decimal may be followed by an exact 5; no negative zero."""
    return [(F.round(c, 9) + F.lit(0.0)).alias(c) for c in cols]


def dup_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.collapse_duplicates(star_schema.load(spark, sf_dir).consumption)
    return rows.select("item_code", "line", "output_type", F.date_format("period_start", "yyyy-MM").alias("period"), *r6("qty_base", "qty_ton", "rate"), F.round("cost", 2).alias("cost"))


def driver_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.aggregate_driver(star_schema.load(spark, sf_dir).driver)
    return rows.select(F.date_format("period_start", "yyyy-MM").alias("period"), "line", "output_type", "driver_type", *r6("driver_qty"), "driver_uom", "n_days_observed", "is_partial")


def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = prepared(spark, sf_dir).observations
    return o.groupBy("item_code", "line", "output_type").agg(F.count(F.lit(1)).alias("n"), F.sum("is_gap_filled").alias("n_gaps"), F.round(F.sum("qty_base"), 4).alias("qty"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = prepared(spark, sf_dir).observations
    return o.select("series_id", "period", "idx", *r6("qty_base", "rate", "driver_qty", "target"), "is_gap_filled", "is_reliable", "is_applicable")


def mode_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).series.groupBy("mode", "mode_source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_periods").alias("periods"))


def series_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = prepared(spark, sf_dir).series
    return s.select("series_id", "item_code", "line", "output_type", "mode", "mode_source", "target_uom", "first_period", "last_period", "n_periods", "n_observed", "n_reliable", "n_applicable", "is_orphan")


def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = prepared(spark, sf_dir).observations
    return o.groupBy("series_id").agg(F.sum("is_reliable").alias("n_reliable"), F.sum("is_low_driver").alias("n_low"), F.sum("is_applicable").alias("n_applicable"))


def interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fit_targets(prepared(spark, sf_dir).observations).select("series_id", "period", "valid", *r6("y", "weight"))


def trailing_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TS11: the length of the last run without demand. TS12: the median gap between demands."""
    y = P.fit_targets(prepared(spark, sf_dir).observations)
    return demand_gaps(y).select("series_id", "trailing_zeros", *r6("median_interval"))


def demand_gaps(y: DataFrame) -> DataFrame:
    hit = F.when(F.col("y") > 0, F.col("idx"))
    before = F.last(hit, True).over(P.IN_ORDER().rowsBetween(P.Window.unboundedPreceding, -1))
    return y.withColumn("gap", hit - before).groupBy("series_id").agg((F.count(F.lit(1)) - 1 - F.coalesce(F.max(hit), F.lit(-1))).alias("trailing_zeros"), F.median("gap").alias("median_interval"))


def standard_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_schema.load(spark, sf_dir).standard_rates.select("item_code", "line", "output_type", F.round("std_rate", 9).alias("std_rate"))


QUERIES = {f.__name__: f for f in (dup_collapse, driver_agg, gap_fill, observations, mode_resolution, series_metadata, reliability, interpolation, trailing_zeros, standard_rates)}

ORACLE = {
    "dup_collapse": with_steps("dup", "SELECT item_code, line, output_type, strftime(period_start, '%Y-%m') AS period, round(qty_base, 6) AS qty_base, round(qty_ton, 6) AS qty_ton, round(rate, 6) AS rate, round(cost, 2) AS cost FROM dup"),
    "driver_agg": with_steps("driver", "SELECT strftime(period_start, '%Y-%m') AS period, line, output_type, driver_type, round(driver_qty, 6) AS driver_qty, driver_uom, n_days_observed, is_partial FROM driver"),
    "gap_fill": with_steps("gaps", "SELECT item_code, line, output_type, count(*) AS n, CAST(sum(is_gap_filled) AS BIGINT) AS n_gaps, round(sum(qty_base), 4) AS qty FROM gaps GROUP BY ALL"),
    "observations": with_steps("obs", "SELECT series_id, period, CAST(idx AS INT) AS idx, round(qty_base, 6) AS qty_base, round(rate, 6) AS rate, round(driver_qty, 6) AS driver_qty, round(target, 6) AS target, is_gap_filled, is_reliable, is_applicable FROM obs"),
    "mode_resolution": with_steps("series", "SELECT mode, mode_source, count(*) AS n, CAST(sum(n_periods) AS BIGINT) AS periods FROM series GROUP BY ALL"),
    "series_metadata": with_steps("series", "SELECT series_id, item_code, line, output_type, mode, mode_source, CASE WHEN mode = 'relative' THEN 'kg/t' ELSE 'kg' END AS target_uom, first_period, last_period, n_periods, CAST(n_observed AS BIGINT) AS n_observed, CAST(n_reliable AS BIGINT) AS n_reliable, CAST(n_applicable AS BIGINT) AS n_applicable, is_orphan FROM series"),
    "reliability": with_steps("obs", "SELECT series_id, CAST(sum(is_reliable) AS BIGINT) AS n_reliable, CAST(sum(is_low_driver) AS BIGINT) AS n_low, CAST(sum(is_applicable) AS BIGINT) AS n_applicable FROM obs GROUP BY ALL"),
    "interpolation": with_steps("fit", "SELECT series_id, period, valid, round(y, 6) AS y, round(weight, 6) AS weight FROM fit"),
    "trailing_zeros": with_steps("fit", """SELECT series_id, CAST(count(*) - 1 - coalesce(max(CASE WHEN y > 0 THEN idx END), -1) AS BIGINT) AS trailing_zeros, round(median(CASE WHEN y > 0 THEN idx - prev END), 6) AS median_interval
FROM (SELECT series_id, idx, y, max(CASE WHEN y > 0 THEN idx END) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM fit) GROUP BY series_id"""),
    "standard_rates": with_steps("std", "SELECT item_code, line, output_type, round(std_rate, 9) AS std_rate FROM std"),
}
