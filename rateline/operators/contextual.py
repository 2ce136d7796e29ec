"""Models that read operating conditions, as candidates like any other (MOD21-MOD23, CAN5, CTX10, CTX11, CTX14, CTX16).

Rows are a series' history and its horizon, each with the conditions of its
period. A fold pairs its origin with the rows before it and those that it must
tell: each row is copied to the few origins that it serves, so the fits of all
folds are one aggregation by series and origin. The final fit is the fold whose
origin is behind the history; its rows to tell come from the driver's plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.calendar import period_add
from . import backtest as T
from . import context as C
from . import regression as R

#: Conditions that may be regressors, beside the calendar's factors.
FEATURES = ("n_active", "is_solo", "own_share", "system_driver", "utilization", "mix_entropy")
OF_PERIOD = ("n_active", "system_driver", "mix_entropy")
KEYS = ("series_id", "line", "output_type", "mode")


def extended_rows(fit: DataFrame, series: DataFrame, rows: DataFrame, names: list[str], cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """History and horizon of each series with their conditions (``context.conditions`` with ``names`` of calendar factors): ``ahead`` is 0 in history, ``known`` whether anything is known of the period, ``seen`` whether the series' line and output are in the driver at all."""
    horizon = F.explode(F.sequence(F.lit(1), F.lit(cfg.forecast.horizon))).alias("ahead")
    past = fit.select(*KEYS, "period_start", F.col("idx").cast("int").alias("idx"), "y", "valid", F.lit(0).alias("ahead"))
    last = series.select(*KEYS, "last_start", "n_periods", horizon)
    future = last.select(*KEYS, period_add(F.col("last_start"), F.col("ahead"), cfg.granularity).alias("period_start"), (F.col("n_periods") - 1 + F.col("ahead")).cast("int").alias("idx"), F.lit(None).cast("double").alias("y"), F.lit(0).alias("valid"), "ahead")
    both = past.unionByName(future)
    num = [F.col(c).cast("double").alias(c) for c in (*FEATURES, *names)]
    own = rows.select("period_start", F.col("unit").alias("line"), F.col("stream").alias("output_type"), F.struct("regime_label", "driver_qty", *num).alias("_own"))
    first = rows.groupBy("period_start").agg(F.min_by(F.struct("regime_label", *[F.col(c).cast("double").alias(c) for c in (*OF_PERIOD, *names)]), F.struct("unit", "stream")).alias("_p"))
    combos = rows.select(F.col("unit").alias("line"), F.col("stream").alias("output_type")).distinct().withColumn("seen", F.lit(True))
    out = both.join(own, ["period_start", "line", "output_type"], "left").join(first, "period_start", "left").join(combos, ["line", "output_type"], "left")
    absent = F.col("_own").isNull()

    def filled(c: str) -> Column:
        there = F.coalesce(F.col(f"_p.{c}"), F.lit(0.0)) if c in (*OF_PERIOD, *names) else F.lit(0.0)
        return F.when(absent, there).otherwise(F.col(f"_own.{c}")).alias(c)

    label = F.coalesce("_own.regime_label", "_p.regime_label", F.lit(C.IDLE)).alias("regime_label")
    driver = F.when(absent, 0.0).otherwise(F.col("_own.driver_qty")).alias("driver_qty")
    return out.select(*KEYS, "period_start", "idx", "y", "valid", "ahead", label, driver, *[filled(c) for c in (*FEATURES, *names)], F.col("_p").isNotNull().alias("known"), F.coalesce("seen", F.lit(False)).alias("seen"))


def diagnosis(ext: DataFrame, cfg: EngineConfig = EngineConfig(), enabled: bool = True, any_driver: bool = True, variance: bool = True) -> DataFrame:
    """A row a series (CTX12-CTX14): ``n, k, statistic, p_value, spread_pct, effect_size, high_label, low_label, material, known_future, skip_reason``. What keeps a series from being tested comes in the order of the ladder; a material effect that no plan covers is not offered."""
    tested = C.diagnosed(C.significance(ext.where("ahead = 0"), cfg), cfg).drop("n", "k")
    use = C.pooled(ext.where("ahead = 0 AND valid = 1 AND y IS NOT NULL AND regime_label IS NOT NULL"), cfg.context.min_regime_obs).groupBy("series_id", "regime").agg(F.count(F.lit(1)).alias("m"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    kept = F.col("m") >= 2
    counts = use.groupBy("series_id").agg(F.sum("m").alias("n"), F.count_if(kept).alias("k"), F.min(F.when(kept, F.col("lo"))).alias("lo"), F.max(F.when(kept, F.col("hi"))).alias("hi"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("regime", "m"))))).alias("regime_counts_json"))
    whole = ext.groupBy("series_id").agg(F.max("seen").alias("seen"), F.min(F.when(F.col("ahead") > 0, F.col("known"))).alias("known_future"))
    out = whole.join(counts, "series_id", "left").join(tested, "series_id", "left")
    flat = (F.col("hi") - F.col("lo")) <= 1e-8 + 1e-5 * F.abs("lo")
    reason = F.when(F.lit(not enabled), "operating conditions are switched off").when(F.lit(not any_driver), "there is no driver").when(F.lit(not variance), "operating conditions never change").when(~F.col("seen"), "the line and output are in no driver row")
    reason = reason.when(F.coalesce("n", F.lit(0)) < 4, "too few usable periods").when(F.col("k") < 2, "only one operating condition").when(flat, "the series is constant")
    offered = F.coalesce(F.col("material"), F.lit(0)) * F.coalesce(F.col("known_future"), F.lit(False)).cast("int")
    cut = F.col("skip_reason").isNotNull()
    out = out.withColumn("skip_reason", reason).withColumn("material", F.when(cut, 0).otherwise(offered))
    for c in ("statistic", "p_value", "spread_pct", "effect_size", "high_label", "low_label"):
        out = out.withColumn(c, F.when(~cut, F.col(c)))
    return out.drop("lo", "hi", "seen").withColumn("verdict", C.verdict(F.col("skip_reason"), F.col("p_value"), F.col("spread_pct"), F.col("high_label"), F.col("low_label"), F.col("material"), cfg))


def fold_pairs(ext: DataFrame, cfg: EngineConfig = EngineConfig(), final: bool = False) -> tuple[DataFrame, DataFrame]:
    """CTX16, JN25: rows to learn from and rows to tell, each with its ``origin``: the last origins of the history, or the one behind it."""
    h, s = cfg.cv.horizon, Window.partitionBy("series_id")
    rows = ext.withColumn("n", F.max(F.when(F.col("ahead") == 0, F.col("idx") + 1)).over(s)).withColumn("step_abs", F.abs(F.col("y") - F.lag("y").over(s.orderBy("idx"))))
    lo = F.greatest(F.lit(2), F.col("n") - h - cfg.cv.max_origins + 1)
    origins = F.array(F.col("n")) if final else F.when(F.col("n") - h >= lo, F.sequence(lo, F.greatest(lo, F.col("n") - h))).otherwise(F.array().cast("array<int>"))
    reach = cfg.forecast.horizon if final else h
    rows = rows.withColumn("origins", origins)
    learn = rows.where("ahead = 0").withColumn("origin", F.explode(F.filter("origins", lambda o: o > F.col("idx")))).drop("origins")
    tell = rows.withColumn("origin", F.explode(F.filter("origins", lambda o: (o <= F.col("idx")) & (F.col("idx") < o + reach)))).drop("origins")
    return learn, tell


def _activity(rows: DataFrame) -> DataFrame:
    """``act`` and the two regressors ``a`` (of the standing part) and ``b``; null where they are not finite."""
    rel = F.col("mode") == "relative"
    act = F.when(rel, F.col("driver_qty")).otherwise(F.col("system_driver"))
    ok = act.isNotNull() & (~rel | (act > 0))
    return rows.withColumn("act", F.when(ok, act)).withColumn("a", F.when(ok, F.when(rel, 1 / F.when(rel & (act > 0), act)).otherwise(1.0))).withColumn("b", F.when(ok, F.when(rel, F.lit(1.0)).otherwise(act)))


def standing_fits(learn: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """MOD21 by origin: ``series_id, origin, fixed, variable``; no row where fewer than 8 periods have a driver or it hardly varies."""
    use = _activity(learn).where("act IS NOT NULL AND y IS NOT NULL")
    sums = use.groupBy("series_id", "origin").agg(F.count(F.lit(1)).alias("n"), F.avg("act").alias("m"), F.stddev_pop("act").alias("s"), *[F.sum(F.col(p) * F.col(q)).alias(p + q) for p, q in ("aa", "ab", "bb", "ay", "by")])
    fit = sums.where((F.col("n") >= 8) & (F.col("m") > 0) & (F.col("s") >= cfg.context.min_driver_cv * F.col("m")))
    return fit.withColumn("c", C.non_negative(*[F.col(x) for x in ("aa", "ab", "bb", "ay", "by")])).select("series_id", "origin", "n", F.col("c.x").alias("fixed"), F.col("c.y").alias("variable"))


def regime_fits(learn: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """MOD22 by origin: ``series_id, origin, regime, level, n, overall``; regimes of too few periods are pooled, and those that are too few still have no level; no row where fewer than two levels are left."""
    least, both = cfg.context.min_regime_obs, Window.partitionBy("series_id", "origin")
    by = learn.groupBy("series_id", "origin", "regime_label").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    pooled = by.groupBy("series_id", "origin", F.when(F.col("n") < least, C.OTHER).otherwise(F.col("regime_label")).alias("regime")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = pooled.withColumn("overall", F.sum("s").over(both) / F.sum("n").over(both)).where(F.col("n") >= least).withColumn("k", F.count(F.lit(1)).over(both))
    return out.where("k >= 2").select("series_id", "origin", "regime", (F.col("s") / F.col("n")).alias("level"), "n", "overall")


def _told(learn: DataFrame, tell: DataFrame, model: str, cfg: EngineConfig) -> DataFrame:
    """Rows to tell with ``y_hat`` by one of the two native models, null where it could not be fitted."""
    if model == "RegimeConditional":
        fits = regime_fits(learn, cfg).groupBy("series_id", "origin").agg(F.map_from_entries(F.collect_list(F.struct("regime", "level"))).alias("levels"), F.first("overall").alias("overall"))
        level = F.coalesce(F.element_at("levels", F.col("regime_label")), F.element_at("levels", F.lit(C.OTHER)), F.col("overall"))
        return tell.join(fits, ["series_id", "origin"], "left").withColumn("y_hat", level)
    rows = _activity(tell).join(standing_fits(learn, cfg).drop("n"), ["series_id", "origin"], "left").withColumn("_p", F.col("fixed") * F.col("a") + F.col("variable") * F.col("b"))
    mean = F.avg("_p").over(Window.partitionBy("series_id", "origin"))
    return rows.withColumn("y_hat", F.coalesce("_p", mean, "variable"))


def _candidate(model: str, cfg: EngineConfig) -> T.Candidate | None:
    return next((c for c in T.all_candidates(cfg) if c.name == model and c.kind == "context"), None)


def native_folds(ext: DataFrame, model: str, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Folds (``backtest.FOLD``) of FixedPlusVariable or RegimeConditional."""
    c, h = _candidate(model, cfg), cfg.cv.horizon
    enough = F.sum(F.when(F.col("ahead") == 0, F.col("valid"))).over(Window.partitionBy("series_id"))
    ext = ext.withColumn("n_rel", enough).where(T.admitted(c, F.col("n_rel")))
    learn, tell = (r.where(F.col("origin") >= max(c.min_history, 2)) for r in fold_pairs(ext, cfg))
    scale = learn.groupBy("series_id", "origin").agg(F.avg("step_abs").alias("scale"))
    steps = F.sort_array(F.collect_list(F.struct("idx", "y_hat", "y", "valid")))
    rows = _told(learn, tell, model, cfg).groupBy("series_id", "origin").agg(steps.alias("z")).where(F.size("z") == h).join(scale, ["series_id", "origin"])
    each = [F.col(f"z.{n}").alias(to) for n, to in (("y_hat", "y_hat"), ("y", "actual"), ("valid", "valid"))]
    return rows.select("series_id", F.lit(model).alias("model"), F.lit(c.ordinal).alias("ordinal"), F.lit(c.n_params).alias("n_params"), "origin", "scale", *each)


def regression_folds(ext: DataFrame, names: list[str], cfg: EngineConfig = EngineConfig(), features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Folds of ContextRegression (MOD23): forward selection by sweeps, at each origin from the rows before it; without a prediction where no condition improves the fit."""
    c, h = _candidate("ContextRegression", cfg), cfg.cv.horizon
    per, vif = cfg.context.observations_per_regressor, cfg.context.max_vif
    rows = R.condition_arrays(ext, [*features, *names]).where(F.aggregate("past", F.lit(0), lambda s, e: s + e["valid"]) >= c.min_history)
    first, last = F.greatest(F.lit(c.min_history), F.size("past") - h - cfg.cv.max_origins + 1), F.size("past") - h
    rows = rows.withColumn("origin", F.explode_outer(F.when(last >= first, F.sequence(first, last)))).where("origin IS NOT NULL")
    rows = R.regressed(rows, f"slice(past, origin + 1, {h})", per, vif)
    y = F.slice("past.y", 1, F.col("origin"))
    steps = F.aggregate(F.transform(y, lambda v, i: F.coalesce(F.abs(v - F.get("past.y", i - 1)), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    ahead = lambda f: F.slice(f"past.{f}", F.col("origin") + 1, h)
    return rows.select("series_id", F.lit(c.name).alias("model"), F.lit(c.ordinal).alias("ordinal"), F.lit(c.n_params).alias("n_params"), "origin", (steps / (F.col("origin") - 1)).alias("scale"), F.coalesce("told.y_hat", F.array_repeat(F.lit(None).cast("double"), h)).alias("y_hat"), ahead("y").alias("actual"), ahead("valid").alias("valid"))


def context_folds(ext: DataFrame, names: list[str], cfg: EngineConfig = EngineConfig()) -> DataFrame | None:
    """Folds of all context models that are not disabled, for the series in ``ext``."""
    out = None
    for model in T.CONTEXT:
        if _candidate(model, cfg) is not None:
            rows = regression_folds(ext, names, cfg) if model == "ContextRegression" else native_folds(ext, model, cfg)
            out = rows if out is None else out.unionByName(rows)
    return out


POINTS = "series_id string, model string, step int, point double, sigma double, grows boolean"


def context_forecasts(ext: DataFrame, chosen: DataFrame, names: list[str], cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """``series_id, model, step, point, sigma, grows`` of the chosen context models over the whole history, by the conditions that the driver's plan has ahead; none where a model cannot be fitted, or the plan does not reach."""
    covered = ext.groupBy("series_id").agg(F.min(F.when(F.col("ahead") > 0, F.col("known"))).alias("ok")).where("ok").select("series_id")
    ext = ext.join(covered, "series_id", "left_semi")
    out = None
    for model in ("FixedPlusVariable", "RegimeConditional"):
        learn, tell = fold_pairs(ext.join(chosen.where(F.col("model") == model).select("series_id").distinct(), "series_id", "left_semi"), cfg, final=True)
        if model == "RegimeConditional":  # a period's own label may be pooled, as when it was fitted
            n = F.count(F.lit(1)).over(Window.partitionBy("series_id", "regime_label"))
            again = learn.withColumn("regime_label", F.when(n < cfg.context.min_regime_obs, C.OTHER).otherwise(F.col("regime_label")))
        else:
            again = _activity(learn).where("act IS NOT NULL")
        miss = _told(learn, again, model, cfg).groupBy("series_id").agg(F.coalesce(F.stddev_pop(F.col("y") - F.col("y_hat")), F.lit(0.0)).alias("sigma"))
        rows = _told(learn, tell, model, cfg).where("y_hat IS NOT NULL").join(miss, "series_id").select("series_id", F.lit(model).alias("model"), F.col("ahead").alias("step"), F.col("y_hat").alias("point"), "sigma", F.lit(False).alias("grows"))
        out = rows if out is None else out.unionByName(rows)
    per, vif = cfg.context.observations_per_regressor, cfg.context.max_vif
    own = ext.join(chosen.where("model = 'ContextRegression'").select("series_id").distinct(), "series_id", "left_semi")
    arrays = R.condition_arrays(own, [*FEATURES, *names]).withColumn("origin", F.size("past")).where("origin >= 2")
    told = R.regressed(arrays, f"slice(future, 1, {cfg.forecast.horizon})", per, vif).where("told IS NOT NULL")
    steps = told.select("series_id", "told.sigma", F.posexplode("told.y_hat").alias("at", "point"))
    return out.unionByName(steps.select("series_id", F.lit("ContextRegression").alias("model"), (F.col("at") + 1).alias("step"), "point", "sigma", F.lit(False).alias("grows")))


def for_combination(rows: DataFrame, unit: str, stream: str) -> DataFrame:
    """CTX17: the conditions of one line and output, in order."""
    return rows.where((F.col("unit") == unit) & (F.col("stream") == stream)).orderBy("period_start")


def regime_at(rows: DataFrame, period: str, unit: str, stream: str) -> str | None:
    """CTX17: what ran in one period, or None."""
    got = rows.where((F.col("period") == period) & (F.col("unit") == unit) & (F.col("stream") == stream)).select("regime_label").first()
    return got and got[0]
