"""Forecasts against what happened (LRN1-LRN3, AGG16, JN15, JN16, WIN11, VAL21)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import period_label, period_start
from .prepare import series_id


def actuals(consumption: DataFrame, granularity: str = "monthly") -> DataFrame:
    """LRN1."""
    rows = consumption.select(series_id().alias("series_id"), period_label(period_start(F.col("date"), granularity), granularity).alias("period"), "qty_base")
    return rows.where("period IS NOT NULL").groupBy("series_id", "period").agg(F.coalesce(F.sum("qty_base"), F.lit(0.0)).alias("actual_value"))


def accuracy(forecasts: DataFrame, actual: DataFrame, selections: DataFrame | None = None) -> DataFrame:
    """LRN2: error and its share of the actual, null where that is 0; forecasts without a demand are passed over."""
    rows = forecasts.where("reconstructed_demand IS NOT NULL").select("series_id", "period", F.col("reconstructed_demand").alias("forecast_value"), *(["model"] if "model" in forecasts.columns and selections is None else []))
    out = rows.join(actual, ["series_id", "period"])
    if selections is not None:
        out = out.join(selections.select("series_id", "model"), "series_id", "left")
    error = F.col("forecast_value") - F.col("actual_value")
    return out.withColumn("error", error).withColumn("abs_pct_error", F.when(F.col("actual_value") != 0, 100 * F.abs(error) / F.abs(F.nullif("actual_value", F.lit(0.0)))))


def drift(history: DataFrame, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """LRN3: whether percentage errors of the later half are more than half as large again as those of the earlier, over 4 or more that are not null. ``by`` may add the run."""
    w = Window.partitionBy(*by)
    e = F.col("abs_pct_error")
    rows = history.where(e.isNotNull()).withColumn("i", F.row_number().over(w.orderBy("period", *[c for c in ("run_id",) if c in history.columns and c not in by], e))).withColumn("n", F.count(F.lit(1)).over(w))
    half = F.floor(F.col("n") / 2)
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("i") <= half, e)).alias("early"), F.avg(F.when(F.col("i") > half, e)).alias("late"))
    return out.withColumn("drifting", F.coalesce((F.col("n") >= 4) & (F.col("late") > 1.5 * F.greatest(F.col("early"), F.lit(1e-9))), F.lit(False)).cast("int"))


def drift_warnings(drifting: DataFrame) -> DataFrame:
    """VAL21: a note for each series that drifts."""
    text = F.format_string("recent errors are %.1f times the earlier ones: look at this series again", F.col("late") / F.greatest(F.col("early"), F.lit(1e-9)))
    return drifting.where("drifting = 1").select("series_id", F.lit("ACCURACY_DRIFT").alias("code"), F.lit("warning").alias("severity"), text.alias("message"))


def upserted(stored: DataFrame, new: DataFrame, key: tuple[str, ...] = ("series_id", "period", "run_id"), frozen: tuple[str, ...] = ("forecast_value", "model")) -> DataFrame:
    """SNK5: rows of the same key take the new values, but for ``frozen`` columns."""
    cols = stored.columns
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.select(*cols).withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key)
    last = both.withColumn("_r", F.row_number().over(w.orderBy(F.desc("_new"))))
    for c in frozen:
        if c in cols:
            last = last.withColumn(c, F.first(c).over(w.orderBy("_new").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return last.where("_r = 1").select(*cols)
