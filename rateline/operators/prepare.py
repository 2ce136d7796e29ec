"""One gap-filled series for each item, line and output type (AGG1-2, AGG10-11, JN1-3, PRJ1-2, PRJ12, TS4-TS13).

Gaps are filled from each observed period to the one before the next by a
window, not by joining a calendar; everything that a series knows of itself is
a window over the same keys, so one exchange serves all of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.calendar import days_in_period, period_add, period_label, period_range, period_start
from ..sources.mapping import RawTables

KEYS = ("item_code", "line", "output_type")


def BY_SERIES():
    return Window.partitionBy(*KEYS)


def IN_ORDER():
    return BY_SERIES().orderBy("period_start")


@dataclass
class Prepared:
    series: DataFrame
    observations: DataFrame
    driver: DataFrame


def series_id(*cols: str) -> Column:
    """item|line|output, nulls as empty (PRJ12)."""
    return F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in (cols or KEYS)])


def sum0(c: str | Column) -> Column:
    """A sum that is 0, not null, where all values are null."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def collapse_duplicates(consumption: DataFrame, granularity: str = "monthly") -> DataFrame:
    """One row a series and period (AGG1): sums; a rate only where any row had one."""
    rows = consumption.withColumn("period_start", period_start(F.col("date"), granularity)).where("period_start IS NOT NULL")
    return rows.groupBy(*KEYS, "period_start").agg(sum0("qty_base").alias("qty_base"), sum0("qty_ton").alias("qty_ton"), sum0("cost").alias("cost"), F.sum("rate").alias("rate"))


def aggregate_driver(driver: DataFrame, granularity: str = "monthly") -> DataFrame:
    """The driver by period, line, output and type (AGG2), and whether its days cover only a part of the period."""
    rows = driver.where(F.col("driver_type").isin("actual", "plan")).withColumn("period_start", period_start(F.col("date"), granularity))
    out = rows.groupBy("period_start", "line", "output_type", "driver_type").agg(sum0("driver_qty").alias("driver_qty"), F.min("driver_uom").alias("driver_uom"), F.countDistinct(F.to_date("date")).alias("n_days_observed"))
    days = F.col("n_days_observed")
    return out.withColumn("is_partial", ((days > 1) & (days < days_in_period(F.col("period_start"), granularity))).cast("int"))


def fill_gaps(rows: DataFrame, granularity: str = "monthly") -> DataFrame:
    """Every period from a series' first to its last (TS4); those without a row are zeros with ``is_gap_filled``."""
    after = period_add(F.lead("period_start").over(IN_ORDER()), -1, granularity)
    wide = rows.withColumn("upto", F.coalesce(after, "period_start")).withColumn("p", F.explode(period_range(F.col("period_start"), F.col("upto"), granularity)))
    gap = F.col("p") != F.col("period_start")
    zero = [F.when(gap, 0.0).otherwise(F.col(c)).alias(c) for c in ("qty_base", "qty_ton", "cost")]
    others = [c for c in rows.columns if c not in (*KEYS, "period_start", "qty_base", "qty_ton", "cost", "rate")]
    return wide.select(*KEYS, F.col("p").alias("period_start"), *zero, F.when(~gap, F.col("rate")).alias("rate"), gap.cast("int").alias("is_gap_filled"), *others)


def resolved_mode(has_rate: Column, declared_bom: Column, declared_ui: Column, derive: bool, driver_exists: Column) -> Column:
    """struct(mode, mode_source) (PRJ2): what a planner declared, then the item list, then the data."""

    def pair(mode: Column | str, source: str) -> Column:
        return F.struct((mode if isinstance(mode, Column) else F.lit(mode)).alias("mode"), F.lit(source).alias("mode_source"))

    ui, bom = F.lower(declared_ui), F.lower(declared_bom)
    valid = ("relative", "absolute")
    out = F.when(F.coalesce(ui.isin(*valid), F.lit(False)), pair(ui, "declared_ui")).when(F.coalesce(bom.isin(*valid), F.lit(False)), pair(bom, "declared_bom"))
    out = out.when(has_rate & ~driver_exists, pair("absolute", "no_driver")).when(has_rate, pair("relative", "inferred"))
    if derive:
        out = out.when(driver_exists, pair("relative", "derived"))
    return out.otherwise(pair("absolute", "inferred"))


def first_rows(df: DataFrame, keys: tuple[str, ...], order: list) -> DataFrame:
    """One row a key, the first in a given order (SET7)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def build_series(raw: RawTables, cfg: EngineConfig = EngineConfig(), overrides: DataFrame | None = None) -> Prepared:
    """``overrides``: ``item_code, mode`` as a planner declared them (JN24)."""
    g = cfg.granularity
    driver = aggregate_driver(raw.driver, g)
    combos = driver.select("line", "output_type").distinct().withColumn("driver_exists", F.lit(True))
    items = first_rows(raw.items.where("item_code IS NOT NULL"), ("item_code",), ["description", "declared_mode"]).select("item_code", F.col("declared_mode").alias("_bom"), F.col("uom").alias("_uom"))
    rows = collapse_duplicates(raw.consumption, g).withColumn("has_rate", F.max(F.col("rate").isNotNull()).over(BY_SERIES()))
    obs = fill_gaps(rows, g).join(combos, ["line", "output_type"], "left").join(items, "item_code", "left")
    if overrides is not None:
        obs = obs.join(overrides.select("item_code", F.col("mode").alias("_ui")), "item_code", "left")
    else:
        obs = obs.withColumn("_ui", F.lit(None).cast("string"))
    exists = F.coalesce("driver_exists", F.lit(False))
    mode = resolved_mode(F.col("has_rate"), F.col("_bom"), F.col("_ui"), cfg.rate.derive_missing, exists)
    obs = obs.withColumn("is_orphan", (F.col("has_rate") & ~exists).cast("int")).withColumn("_m", mode).withColumn("mode", F.col("_m.mode")).withColumn("mode_source", F.col("_m.mode_source"))
    actual = driver.where("driver_type = 'actual'").select("period_start", "line", "output_type", F.col("driver_qty").alias("_d"))
    obs = obs.join(actual, ["period_start", "line", "output_type"], "left")
    relative, d = F.col("mode") == "relative", F.col("driver_qty")
    obs = obs.withColumn("driver_qty", F.when(relative, F.col("_d")))
    derived = relative & ~F.col("has_rate")
    obs = obs.withColumn("rate", F.when(derived, F.when(d > 0, F.col("qty_base") / F.when(d > 0, d))).when(relative, F.coalesce("rate", F.lit(0.0))).otherwise(F.col("rate")))
    obs = obs.withColumn("target", F.when(relative, F.col("rate")).otherwise(F.col("qty_base") / days_in_period(F.col("period_start"), g)))
    ran = d.isNotNull() & (d > 0)
    idle = ~ran & (F.col("rate").isNull() | (F.col("rate") == 0))
    obs = obs.withColumn("is_applicable", (~(relative & idle)).cast("int"))
    enough = ran & (d >= cfg.driver.floor_fraction * F.median(d).over(BY_SERIES()))
    obs = obs.withColumn("is_reliable", F.when(relative, enough.cast("int")).otherwise(1))
    obs = obs.withColumn("is_low_driver", (relative & d.isNotNull() & ~enough).cast("int")).withColumn("is_derived", (derived & F.col("rate").isNotNull()).cast("int"))
    obs = obs.withColumn("series_id", series_id()).withColumn("period", period_label(F.col("period_start"), g)).withColumn("idx", F.row_number().over(IN_ORDER()) - 1)
    observations = obs.select("series_id", *KEYS, "period_start", "period", "idx", "qty_base", "qty_ton", "cost", "rate", "driver_qty", "target", "is_gap_filled", "is_reliable", "is_applicable", "is_low_driver", "is_derived", "is_orphan", "mode", "mode_source", F.col("_uom").alias("item_uom"))
    return Prepared(series_of(observations, raw.consumption), observations, driver)


def series_of(observations: DataFrame, consumption: DataFrame) -> DataFrame:
    """A row a series, from ``observations`` (which may be stored ones) and the units of ``consumption``."""
    series = observations.groupBy("series_id", *KEYS, "mode", "mode_source", "item_uom").agg(
        F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.max("period_start").alias("last_start"), F.count(F.lit(1)).alias("n_periods"),
        F.sum(1 - F.col("is_gap_filled")).alias("n_observed"), F.sum("is_reliable").alias("n_reliable"), F.sum("is_applicable").alias("n_applicable"), F.max("is_orphan").alias("is_orphan"),
    )
    uoms = consumption.where("rate_uom IS NOT NULL").groupBy(*KEYS).agg(F.expr("mode() WITHIN GROUP (ORDER BY rate_uom)").alias("_r"))
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"u.{k}")) for k in KEYS]
    return series.alias("s").join(uoms.alias("u"), same, "left").select("s.*", F.when(F.col("mode") == "relative", F.coalesce("_r", F.concat(F.coalesce("item_uom", F.lit("qty")), F.lit("/driver")))).otherwise(F.col("item_uom")).alias("target_uom")).drop("item_uom")


def fit_targets(obs: DataFrame) -> DataFrame:
    """``y`` for fitting (TS10): unreliable targets are interpolated between the nearest reliable ones, held beyond the ends, and 0 where none is reliable; ``valid``; ``weight``, the driver where it is usable (TS13)."""
    ok = (F.col("is_reliable") == 1) & F.col("target").isNotNull()
    known, at = F.when(ok, F.col("target")), F.when(ok, F.col("idx"))
    back, ahead = IN_ORDER().rowsBetween(Window.unboundedPreceding, 0), IN_ORDER().rowsBetween(0, Window.unboundedFollowing)
    y0, y1, i0, i1 = F.last(known, True).over(back), F.first(known, True).over(ahead), F.last(at, True).over(back), F.first(at, True).over(ahead)
    line = y0 + (y1 - y0) * (F.col("idx") - i0) / F.nullif(i1 - i0, F.lit(0))
    return obs.withColumn("valid", ok.cast("int")).withColumn("y", F.when(ok, F.col("target")).otherwise(F.coalesce(line, y0, y1, F.lit(0.0)))).withColumn("weight", F.when(ok, F.col("driver_qty")))
