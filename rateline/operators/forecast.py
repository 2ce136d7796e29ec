"""Forecasts with intervals, confidence and demand (FC1-FC5, PRJ9, JN8, SEL10), and their roll-ups (AGG3-AGG5, JN9-JN11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.calendar import days_in_period, period_add, period_label
from ..functions.stats import normal_quantile
from . import backtest as T
from .prepare import sum0

DIMENSIONS = ("item_code", "line", "output_type")
BANDS = ("lower_80", "upper_80", "lower_95", "upper_95")


def confidence_score(mase: Column, n_reliable: Column, forecastability: Column, quality: Column, skipped: Column, enough: int = 24) -> Column:
    """FC4."""
    fit = F.coalesce(0.35 / (1 + mase), F.lit(0.35 * 0.40))
    score = fit + 0.30 * F.least(F.lit(1.0), n_reliable / enough) + 0.20 * forecastability + 0.15 * quality
    return F.when(skipped, F.least(score, F.lit(0.35))).otherwise(score)


def confidence_label(score: Column) -> Column:
    """PRJ9."""
    return F.when(score < 0.40, "low").when(score < 0.70, "medium").otherwise("high")


def final_fits(fit: DataFrame, chosen: DataFrame, cfg: EngineConfig = EngineConfig(), only: set[str] | None = None) -> DataFrame:
    """``series_id, model, level, slope, season, sigma, grows`` of each series' chosen models over its whole history (SEL10); ``sigma`` is the population deviation of what the model missed one step ahead, for the mean of what its last level misses. Frames are made for ``only``, if that is given."""
    rows = T.levels(fit, cfg, only).join(chosen.select("series_id", "model"), "series_id")
    level, slope, grows = F.lit(None).cast("double"), F.lit(0.0), F.lit(False)
    for c in T.candidates(cfg):
        if only is not None and c.name not in only:
            continue
        own = F.col("model") == c.name
        grows = F.when(own, F.lit(c.grows)).otherwise(grows)
        level = F.when(own, F.col("season")[0] if c.seasonal else F.col(f"level_{c.ordinal}")).otherwise(level)
        if not c.seasonal:
            slope = F.when(own, F.col(f"slope_{c.ordinal}")).otherwise(slope)
    rows = rows.withColumn("level", level).withColumn("slope", slope).withColumn("grows", grows)
    end, one = F.col("idx") == F.col("n"), T.Window.partitionBy("series_id", "model")
    last = F.max(F.when(end, F.col("slope"))).over(one)
    fitted = F.when(F.col("model") == "Mean", F.max(F.when(end, F.col("level"))).over(one)).otherwise(F.col("level") + F.when(F.col("model") == "Drift", last).otherwise(0.0))
    rows = rows.withColumn("miss", F.col("y") - fitted)
    return rows.groupBy("series_id", "model").agg(F.max(F.when(end, F.col("level"))).alias("level"), F.max(F.when(end, F.col("slope"))).alias("slope"), F.max_by("season", "idx").alias("season"), F.when(F.count("miss") >= 2, F.stddev_pop("miss")).otherwise(F.stddev_pop("y")).alias("sigma"), F.max("grows").alias("grows"))


def points(fits: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """``series_id, model, step, point, sigma, grows`` of fits by level, slope or season (FC1)."""
    rows = fits.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(cfg.forecast.horizon))))
    again = F.element_at("season", ((F.col("step") - 1) % cfg.season + 1).cast("int"))
    at = F.when(F.col("model") == "SeasonalNaive", again).otherwise(F.col("level") + F.col("slope") * F.col("step"))
    return rows.select("series_id", "model", "step", at.alias("point"), "sigma", "grows")


def averaged(made: DataFrame, members: DataFrame) -> DataFrame:
    """Points of each series' ensemble (MOD20): the mean of its members' (``series_id, model``) at each step; none where a member has none. Its deviation is the mean of theirs, which the deviation of the mean does not exceed."""
    want = members.groupBy("series_id").agg(F.count(F.lit(1)).alias("_want"))
    rows = made.join(members, ["series_id", "model"], "left_semi").groupBy("series_id", "step").agg(F.avg("point").alias("point"), F.avg("sigma").alias("sigma"), F.max("grows").alias("grows"), F.count("point").alias("_have"))
    return rows.join(want, "series_id").where("_have = _want").select("series_id", F.lit("Ensemble").alias("model"), "step", "point", "sigma", "grows")


def horizon(made: DataFrame, series: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Points behind each series' own last period, clipped at 0, bands ordered (FC2, FC3)."""
    g = cfg.granularity
    rows = made.join(series.select("series_id", *DIMENSIONS, "mode", "last_start"), "series_id")
    start = period_add(F.col("last_start"), F.col("step"), g)
    wide = F.col("sigma") * F.when(F.col("grows"), F.sqrt(F.col("step").cast("double"))).otherwise(1.0)
    rows = rows.withColumn("period_start", start).withColumn("period", period_label(F.col("period_start"), g)).withColumn("p", F.col("point")).withColumn("wide", wide)
    at = F.greatest(F.col("p"), F.lit(0.0))
    z80, z95 = (normal_quantile(0.5 + v / 2) for v in cfg.forecast.interval_levels)
    rows = rows.withColumn("target_value", at)
    rows = rows.withColumn("lower_80", F.least(F.greatest(F.col("p") - z80 * F.col("wide"), F.lit(0.0)), at)).withColumn("upper_80", F.greatest(F.greatest(F.col("p") + z80 * F.col("wide"), F.lit(0.0)), at))
    rows = rows.withColumn("lower_95", F.least(F.greatest(F.col("p") - z95 * F.col("wide"), F.lit(0.0)), F.col("lower_80"))).withColumn("upper_95", F.greatest(F.greatest(F.col("p") + z95 * F.col("wide"), F.lit(0.0)), F.col("upper_80")))
    return rows.select("series_id", *DIMENSIONS, "mode", "model", "period_start", "period", "step", "target_value", *BANDS)


def generate(fits: DataFrame, series: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Forecasts of fits with their bands (FC1-FC3)."""
    return horizon(points(fits, cfg), series, cfg)


def reconstruct(forecasts: DataFrame, driver: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """FC5: demand is the rate times the driver's plan, null where there is none, or the daily quantity times the days."""
    plan = driver.where("driver_type = 'plan'").select("period_start", "line", "output_type", F.col("driver_qty").alias("_plan"))
    rows = forecasts.join(plan, ["period_start", "line", "output_type"], "left").withColumn("driver_plan", F.when(F.col("mode") == "relative", F.col("_plan"))).drop("_plan")
    times = F.when(F.col("mode") == "relative", F.col("driver_plan")).otherwise(days_in_period(F.col("period_start"), cfg.granularity).cast("double"))
    rows = rows.withColumn("_x", times)
    for made, source in (("reconstructed_demand", "target_value"), *((f"demand_{b}", b) for b in BANDS)):
        rows = rows.withColumn(made, F.col(source) * F.col("_x"))
    return rows.drop("_x")


def filtered(df: DataFrame, filters: dict[str, list] | None) -> DataFrame:
    """PRJ5: an empty list does not filter."""
    for dim, values in (filters or {}).items():
        if values:
            df = df.where(F.col(dim).isin(values))
    return df


def _checked(dims: list[str]) -> list[str]:
    if bad := set(dims) - set(DIMENSIONS):
        raise ValueError(f"unknown dimensions: {sorted(bad)}")
    return ["period", *dims]


def _divided(total: Column, weight: Column) -> Column:
    return F.when(weight > 0, total / F.when(weight > 0, weight))


def _once(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """AGG5: a driver that several series of a line share counts once within each group."""
    own = list(dict.fromkeys([*keys, "period", "line", "output_type"]))
    return df.groupBy(*own).agg(F.max(column).alias("_one")).groupBy(*keys).agg(sum0("_one").alias(column))


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return left.alias("l").join(right.alias("r"), same).select("l.*", *[f"r.{c}" for c in right.columns if c not in keys])


def roll_up_forecasts(forecasts: DataFrame, dims: list[str], filters: dict[str, list] | None = None) -> DataFrame:
    """AGG3: demand is summed; a rate and its bounds are averaged by the driver."""
    keys, df = _checked(dims), filtered(forecasts, filters)
    weight = F.when(F.col("target_value").isNotNull(), F.col("driver_plan"))
    aggs = [sum0("reconstructed_demand").alias("demand"), *[sum0(f"demand_{b}").alias(f"demand_{b}") for b in BANDS]]
    aggs += [_divided(F.sum(F.col(s) * weight), F.sum(weight)).alias(n) for n, s in (("rate", "target_value"), *((f"rate_{b}", b) for b in BANDS))]
    aggs += [F.countDistinct("series_id").alias("n_series")] + ([F.avg("confidence").alias("confidence")] if "confidence" in df.columns else [])
    return _beside(df.groupBy(*keys).agg(*aggs), _once(df, keys, "driver_plan"), keys)


def roll_up_observations(observations: DataFrame, dims: list[str], filters: dict[str, list] | None = None) -> DataFrame:
    """AGG4: the same for history; the rate is the driver-weighted mean of the recorded rates."""
    keys, df = _checked(dims), filtered(observations, filters)
    weight = F.when(F.col("rate").isNotNull(), F.col("driver_qty"))
    made = df.groupBy(*keys).agg(sum0("qty_base").alias("qty_base"), sum0("qty_ton").alias("qty_ton"), sum0("cost").alias("cost"), _divided(F.sum(F.col("rate") * weight), F.sum(weight)).alias("rate"), F.countDistinct("series_id").alias("n_series"))
    return _beside(made, _once(df, keys, "driver_qty"), keys)


def cube_demand(forecasts: DataFrame) -> DataFrame:
    """Demand and series for every subset of the dimensions at once; ``grouping`` tells them apart."""
    return forecasts.cube("period", *DIMENSIONS).agg(F.grouping_id().alias("grouping"), sum0("reconstructed_demand").alias("demand"), F.countDistinct("series_id").alias("n_series")).where("period IS NOT NULL")
