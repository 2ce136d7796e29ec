"""Native models, rolling-origin back-tests and selection (MOD1-6, MOD18, BT1-BT6, CAN1-CAN5, MET1-4, SEL1-SEL4, SEL9, WIN1-4).

A model that forecasts a level is a window frame that ends one row before: the
row of period t holds what the model, fitted on everything before t, says of t.
So one sorted pass over a series gives all folds, the in-sample fit, and, on a
row appended behind the last period, the final fit; and no fold can see its
test periods. The periods to score are ``lead`` of the same row.

A fold is one row with arrays of its steps. Scores, ranks and the ensemble are
windows and groups that begin with the series, so nothing is shuffled again
behind the first exchange, and nothing is computed twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig

def S():  # a window needs a session, so none is made on import
    return Window.partitionBy("series_id")


def BY():
    return S().orderBy("idx")


def BEFORE():
    return BY().rowsBetween(Window.unboundedPreceding, -1)


@dataclass(frozen=True)
class Candidate:
    """``grows``: whether its interval widens with the horizon. It competes where there are ``min_history`` and ``reliable`` reliable periods, and fewer than ``below``. ``kind``: frame (a window frame), fitted, anchor or context."""

    name: str
    min_history: int
    n_params: int
    ordinal: int
    grows: bool = False
    seasonal: bool = False
    window: int | None = None
    kind: str = "frame"
    reliable: int = 0
    below: int | None = None

    @property
    def family(self) -> str:
        return self.name.split("(")[0]


ANCHOR = Candidate("StandardRateAnchor", 0, 0, 30, kind="anchor")
#: Least history, parameters for the tie-break, and whether intervals widen.
FITTED = {"SES": (5, 1, False), "DampedHolt": (10, 3, True), "Theta": (8, 2, True), "Holt": (10, 2, True), "ETS": (15, 1, True), "ARIMA": (24, 0, True)}
CONTEXT = {"FixedPlusVariable": (8, 2), "RegimeConditional": (12, 3), "ContextRegression": (20, 3)}
INTERMITTENT = ("SBA", "TSB", "Croston", "ZeroForecast")


def _fitted(name: str, ordinal: int, **more) -> Candidate:
    least, k, grows = FITTED[name]
    return Candidate(name, least, k, ordinal, grows=grows, kind="fitted", **more)


def all_candidates(cfg: EngineConfig = EngineConfig()) -> list[Candidate]:
    """CAN1-CAN3, CAN5, SEL1: who may compete, in the order that settles ties of the error."""
    m, enough = cfg.season, cfg.gate.seasonal_min_history
    out = [Candidate("Naive", 1, 0, 0), Candidate("Drift", 2, 1, 1, grows=True), Candidate("Mean", 2, 1, 2), _fitted("SES", 3), _fitted("DampedHolt", 4), _fitted("Theta", 5)]
    for i, w in enumerate(cfg.models.lookback_windows[:1] if cfg.fast_mode else cfg.models.lookback_windows):
        out += [Candidate(f"MovingAverage({w})", w + 1, 1, 6 + 2 * i, window=w), Candidate(f"WeightedMovingAverage({w})", w + 1, 2, 7 + 2 * i, window=w)]
    out += [Candidate("SeasonalNaive", 2 * m, 0, 20, seasonal=True, reliable=enough), _fitted("Holt", 21, reliable=enough), Candidate("HoltWinters", 2 * m, 4, 22, grows=True, kind="fitted", reliable=enough)]
    out += [_fitted("ETS", 23, reliable=enough), _fitted("ETS", 23, reliable=15, below=enough)]
    if cfg.models.enable_arima:
        out.append(_fitted("ARIMA", 24, reliable=enough))
    out += [Candidate(n, least, k, 31 + i, kind="context") for i, (n, (least, k)) in enumerate(CONTEXT.items())]
    return [c for c in out if c.family not in cfg.models.disabled_models] + [ANCHOR]


def candidates(cfg: EngineConfig = EngineConfig()) -> list[Candidate]:
    """The models whose folds are window frames."""
    return [c for c in all_candidates(cfg) if c.kind == "frame"]


def admitted(c: Candidate, n_reliable: Column) -> Column:
    """PRJ8: whether a series has the history for a candidate."""
    ok = n_reliable >= max(c.min_history, c.reliable)
    return ok & (n_reliable < c.below) if c.below else ok


def gate(n_reliable: Column, pattern: Column, cfg: EngineConfig = EngineConfig()) -> Column:
    """BT1: routed, cold_start or compete."""
    return F.when(pattern.isin("intermittent", "lumpy"), "routed").when(n_reliable < cfg.gate.min_history_competition, "cold_start").otherwise("compete")


def candidate_sets(series: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """``series_id, route, model, ordinal`` of who competes for each series (``n_reliable, pattern_class, mode``; ``std_rate`` and ``has_context`` admit anchors and context models); routed series have the models that they may be routed to (CAN4)."""
    rows = series.withColumn("route", gate(F.col("n_reliable"), F.col("pattern_class"), cfg))
    rate = (F.col("mode") == "relative") & F.col("std_rate").isNotNull() if "std_rate" in series.columns else F.lit(False)
    context = F.col("has_context") if "has_context" in series.columns else F.lit(False)
    more = {"anchor": rate, "context": context}
    one = lambda name, ordinal: F.struct(F.lit(name).alias("model"), F.lit(ordinal).alias("ordinal"))
    compete = [F.when(admitted(c, F.col("n_reliable")) & more.get(c.kind, F.lit(True)), one(c.name, c.ordinal)) for c in all_candidates(cfg)]
    routed = [one(n, i) for i, n in enumerate(INTERMITTENT)]
    own = F.when(F.col("route") == "compete", F.filter(F.array(*compete), lambda x: x.isNotNull())).when(F.col("route") == "routed", F.array(*routed))
    return rows.select("series_id", "route", F.explode_outer(own).alias("c")).select("series_id", "route", "c.model", "c.ordinal")


def with_sentinel(fit: DataFrame) -> DataFrame:
    """A row behind the last one of each series, whose frames hold the whole history."""
    rows = fit.select("series_id", "idx", "y", "valid", "weight", (F.col("anchor") if "anchor" in fit.columns else F.lit(None).cast("double")).alias("anchor"))
    end = F.struct((F.col("idx") + 1).alias("idx"), F.lit(None).cast("double").alias("y"), F.lit(0).alias("valid"), F.lit(None).cast("double").alias("weight"), "anchor")
    own = F.struct("idx", "y", "valid", "weight", "anchor")
    rows = rows.withColumn("_last", F.lead("idx").over(BY()).isNull())
    return rows.select("series_id", F.explode(F.when(F.col("_last"), F.array(own, end)).otherwise(F.array(own))).alias("r")).select("series_id", "r.*")


def levels(fit: DataFrame, cfg: EngineConfig = EngineConfig(), only: set[str] | None = None) -> DataFrame:
    """``series_id, idx, n, n_rel, y, valid, scale``, and for each candidate (of ``only``, if given) ``level_i, slope_i``: its forecast from before this row is level + slope * step. The seasonal one has an array ``season`` instead. A column ``anchor`` of ``fit`` makes the engineered rate one of them."""
    rows = with_sentinel(fit)
    w = F.coalesce("weight", F.lit(0.0))
    rows = rows.withColumn("n", F.max("idx").over(S())).withColumn("n_rel", F.sum("valid").over(S())).withColumn("w", w).withColumn("wy", w * F.col("y")).withColumn("jwy", w * F.col("y") * F.col("idx")).withColumn("jw", w * F.col("idx")).withColumn("jy", F.col("y") * F.col("idx"))
    rows = rows.withColumn("step_abs", F.abs(F.col("y") - F.lag("y").over(BY())))
    rows = rows.withColumn("scale", F.avg("step_abs").over(BEFORE()))
    for c in candidates(cfg):
        if c.seasonal or (only is not None and c.name not in only):
            continue
        slope = F.lit(0.0)
        if c.name in ("Naive", "Drift"):
            level = F.lag("y").over(BY())
            if c.grows:
                slope = (level - F.first("y").over(BEFORE())) / F.nullif(F.col("idx") - 1, F.lit(0))
        else:
            f = BY().rowsBetween(-c.window, -1) if c.window else BEFORE()
            total = F.sum("w").over(f)
            if c.name.startswith("Weighted"):
                back = F.col("idx") - c.window - 1
                wt = F.sum("jw").over(f) - back * F.sum("w").over(f)
                plain = (F.sum("jy").over(f) - back * F.sum("y").over(f)) / (c.window * (c.window + 1) / 2)
                level = F.when(total > 0, (F.sum("jwy").over(f) - back * F.sum("wy").over(f)) / F.when(total > 0, wt)).otherwise(plain)
            else:
                level = F.when(total > 0, F.sum("wy").over(f) / F.when(total > 0, total)).otherwise(F.avg("y").over(f))
        rows = rows.withColumn(f"level_{c.ordinal}", level).withColumn(f"slope_{c.ordinal}", slope)
    if only is None or "SeasonalNaive" in only:
        season = F.array(*[F.lag("y", cfg.season - k).over(BY()) for k in range(cfg.season)])
    else:
        season = F.lit(None).cast("array<double>")
    rows = rows.withColumn(f"level_{ANCHOR.ordinal}", F.col("anchor")).withColumn(f"slope_{ANCHOR.ordinal}", F.lit(0.0))
    return rows.withColumn("season", season).drop("w", "wy", "jwy", "jw", "jy", "step_abs", "anchor")


def _predicted(c: Candidate, step: int, season: int) -> Column:
    if c.seasonal:
        return F.col("season")[(step - 1) % season]
    return F.col(f"level_{c.ordinal}") + F.col(f"slope_{c.ordinal}") * step


#: A fold: what a model said at an origin, and what came, step by step.
FOLD = "series_id string, model string, ordinal int, n_params int, origin int, scale double, y_hat array<double>, actual array<double>, valid array<int>"


def fold_rows(fit: DataFrame, cfg: EngineConfig = EngineConfig(), only: set[str] | None = None) -> DataFrame:
    """Folds (``FOLD``) of the models that are window frames, and of the anchor where ``fit`` has one: the last 8 origins that leave a whole horizon and enough history (BT2-BT5), of candidates that the series' reliable periods admit (PRJ8)."""
    h = cfg.cv.horizon
    rows = levels(fit, cfg, only)
    rows = rows.withColumn("actual", F.array(*[F.lead("y", s).over(BY()) for s in range(h)])).withColumn("hits", F.array(*[F.lead("valid", s).over(BY()) for s in range(h)]))
    rows = rows.where((F.col("idx") <= F.col("n") - h) & (F.col("idx") >= F.col("n") - h - cfg.cv.max_origins + 1))
    made = []
    for c in [*candidates(cfg), *([ANCHOR] if "anchor" in fit.columns else [])]:
        if only is not None and c.name not in only:
            continue
        open_ = admitted(c, F.col("n_rel")) & (F.col("idx") >= max(c.min_history, 2))
        if c.kind == "anchor":
            open_ = open_ & F.col(f"level_{c.ordinal}").isNotNull()
        made.append(F.when(open_, F.struct(F.lit(c.name).alias("model"), F.lit(c.ordinal).alias("ordinal"), F.lit(c.n_params).alias("n_params"), F.array(*[_predicted(c, s + 1, cfg.season) for s in range(h)]).alias("y_hat"))))
    one = rows.select("series_id", F.col("idx").cast("int").alias("origin"), "scale", "actual", F.col("hits").alias("valid"), F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("c"))
    return one.select("series_id", "c.model", "c.ordinal", "c.n_params", "origin", "scale", "c.y_hat", "actual", "valid")


def folds(fit: DataFrame, cfg: EngineConfig = EngineConfig(), only: set[str] | None = None) -> DataFrame:
    """``fold_rows``, a row a step."""
    return by_step(fold_rows(fit, cfg, only))


def by_step(rows: DataFrame) -> DataFrame:
    """``series_id, model, ordinal, n_params, origin, step, y_hat, actual, valid, scale`` of folds."""
    return rows.select("series_id", "model", "ordinal", "n_params", "origin", "scale", F.posexplode(F.arrays_zip("y_hat", "actual", "valid")).alias("at", "z")).select("series_id", "model", "ordinal", "n_params", "origin", (F.col("at") + 1).alias("step"), "z.y_hat", "z.actual", "z.valid", "scale")


def _mean(terms: list[Column]) -> Column:
    """The mean of those that are not null."""
    k = sum((t.isNotNull().cast("int") for t in terms), F.lit(0))
    return F.when(k > 0, sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0)) / F.when(k > 0, k))


def fold_scores(rows: DataFrame, h: int) -> DataFrame:
    """Folds with the errors over their reliable test periods (BT6, MET1-4), null where there are none; ``mase`` is infinite where nothing varied before but the forecast missed."""
    errors, parts, shares = [], [], []
    for s in range(h):
        hat, a = F.get("y_hat", F.lit(s)), F.get("actual", F.lit(s))
        e = F.when(F.get("valid", F.lit(s)) == 1, hat - a)
        size = F.abs(a) + F.abs(hat)
        errors.append(e)
        parts.append(F.abs(e) / F.abs(F.nullif(a, F.lit(0.0))))
        shares.append(2 * F.abs(e) / F.nullif(size, F.lit(0.0)))
    out = rows.withColumn("mae", _mean([F.abs(e) for e in errors])).withColumn("rmse", F.sqrt(_mean([e * e for e in errors]))).withColumn("bias", _mean(errors)).withColumn("mape", 100 * _mean(parts)).withColumn("smape", 100 * _mean(shares))
    return out.withColumn("mase", F.when(F.col("scale") > 0, F.col("mae") / F.when(F.col("scale") > 0, F.col("scale"))).when(F.col("mae") == 0, 0.0).when(F.col("mae").isNotNull(), F.lit(float("inf"))))


def results(rows: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """One row a series and model (AGG17): averages over folds; null ``mase`` and ``stability`` where any fold is infinite; ``skipped`` under 3 origins (BT3), ``failed`` where a fold has no prediction."""
    f = fold_scores(rows, cfg.cv.horizon)
    bad = F.coalesce(F.max(F.col("mase") == float("inf")), F.lit(False))
    failed = F.max(F.exists("y_hat", lambda v: v.isNull()))
    finite = F.when(F.col("mase") != float("inf"), F.col("mase"))
    out = f.groupBy("series_id", "model", "ordinal", "n_params").agg(
        F.when(~bad & ~failed, F.avg(finite)).alias("mase"), F.when(~bad & ~failed, F.stddev_pop(finite)).alias("stability"),
        *[F.avg(c).alias(c) for c in ("mae", "rmse", "mape", "smape", "bias")], F.count("mae").alias("n_origins"), F.count(F.lit(1)).alias("tried"), failed.alias("failed"),
    )
    status = F.when(F.col("failed"), "failed").when(F.col("tried") < cfg.gate.min_cv_origins, "skipped").otherwise("ok")
    return out.where("failed OR n_origins > 0").withColumn("status", status).drop("tried", "failed")


def with_ensemble(rows: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Folds and, where the best 2 or 3 models of a series are close, folds of their mean as a candidate of its own, from the origins that they share (SEL3, SET5)."""
    h = cfg.cv.horizon
    model = Window.partitionBy("series_id", "model")
    f = fold_scores(rows, h)
    failed = F.max(F.exists("y_hat", lambda v: v.isNull())).over(model)
    infinite = F.max(F.coalesce(F.col("mase") == float("inf"), F.lit(False))).over(model)
    ok = ~failed & ~infinite & (F.count(F.lit(1)).over(model) >= cfg.gate.min_cv_origins)
    f = f.withColumn("_m", F.when(ok, F.avg("mase").over(model))).withColumn("_last", F.row_number().over(model.orderBy(F.desc("origin"))) == 1)
    f = f.withColumn("_r", F.when(F.col("_m").isNotNull(), F.dense_rank().over(S().orderBy(F.col("_m").asc_nulls_last(), "ordinal"))))
    top = F.col("_r") <= 3
    f = f.withColumn("_k", F.max(F.when(top, F.col("_r"))).over(S())).withColumn("_best", F.min("_m").over(S())).withColumn("_worst", F.max(F.when(top, F.col("_m"))).over(S())).withColumn("_params", F.sum(F.when(top & F.col("_last"), F.col("n_params"))).over(S()))
    close = top & (F.col("_k") >= 2) & (F.col("_best") > 0) & ((F.col("_worst") - F.col("_best")) <= cfg.models.ensemble_mase_tolerance * F.col("_best"))
    own = F.struct("model", "ordinal", "n_params", F.lit(1).alias("members"))
    mixed = F.struct(F.lit("Ensemble").alias("model"), F.lit(99).alias("ordinal"), F.col("_params").cast("int").alias("n_params"), F.col("_k").alias("members"))
    both = f.select("series_id", "origin", "scale", "y_hat", "actual", "valid", F.explode(F.when(close, F.array(own, mixed)).otherwise(F.array(own))).alias("c"))
    mean = both.groupBy("series_id", "c.model", "c.ordinal", "c.n_params", "c.members", "origin").agg(F.min("scale").alias("scale"), F.array(*[F.avg(F.get("y_hat", F.lit(s))) for s in range(h)]).alias("y_hat"), F.first("actual").alias("actual"), F.first("valid").alias("valid"), F.count(F.lit(1)).alias("have"))
    return mean.where("have = members").select(rows.columns)


def competition(rows: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Results of folds and of ensembles of them; an ensemble without enough origins is no candidate."""
    return results(with_ensemble(rows, cfg), cfg).where("model <> 'Ensemble' OR status = 'ok'")


def members(scored: DataFrame) -> DataFrame:
    """``series_id, model``: whom a series' ensemble is made of, its three best models."""
    ok = scored.where("status = 'ok' AND mase IS NOT NULL AND model <> 'Ensemble'")
    return ok.withColumn("r", F.row_number().over(S().orderBy("mase", "ordinal"))).where("r <= 3").select("series_id", "model")


def winners(scored: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """SEL4: of the models within tolerance of the best, the most stable, least biased, smallest, first by name."""
    t = cfg.selection.simplicity_mase_tolerance
    pool = scored.where("status = 'ok' AND mase IS NOT NULL").withColumn("best", F.min("mase").over(S())).where(F.col("mase") <= F.when(F.col("best") > 0, F.col("best") * (1 + t)).otherwise(t))
    order = S().orderBy(F.round("stability", 6), F.round(F.abs("bias"), 9), "n_params", "model")
    return pool.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r", "best")


def croston(fit: DataFrame, alpha: float = 0.1) -> DataFrame:
    """MOD14, MOD15: sizes of demands and gaps between them, smoothed from their means in closed form; ``croston`` and ``sba``."""
    hit = fit.where("y > 0").withColumn("i", F.row_number().over(BY())).withColumn("k", F.count(F.lit(1)).over(S())).withColumn("gap", (F.col("idx") - F.coalesce(F.lag("idx").over(BY()), F.lit(-1))).cast("double"))
    late = alpha * F.pow(F.lit(1 - alpha), F.col("k") - F.col("i"))
    start = F.pow(F.lit(1 - alpha), F.max("k"))
    out = hit.groupBy("series_id").agg((start * F.avg("y") + F.sum(late * F.col("y"))).alias("size"), F.greatest(F.lit(1.0), start * F.avg("gap") + F.sum(late * F.col("gap"))).alias("interval"))
    rate = F.col("size") / F.col("interval")
    return out.select("series_id", "size", "interval", rate.alias("croston"), (rate * (1 - alpha / 2)).alias("sba"))


def tsb(fit: DataFrame, alpha: float = 0.15, beta: float = 0.1) -> DataFrame:
    """MOD16: the chance of a demand, updated each period, times its smoothed size."""
    rows = fit.withColumn("hit", (F.col("y") > 0).cast("int")).withColumn("n", F.count(F.lit(1)).over(S())).withColumn("k", F.sum("hit").over(S())).withColumn("i", F.sum("hit").over(BY()))
    p = F.pow(F.lit(1 - beta), F.max("n")) * F.avg("hit") + F.sum(beta * F.pow(F.lit(1 - beta), F.col("n") - 1 - F.col("idx")) * F.col("hit"))
    size = F.pow(F.lit(1 - alpha), F.max("k")) * F.avg(F.when(F.col("hit") == 1, F.col("y"))) + F.sum(F.when(F.col("hit") == 1, alpha * F.pow(F.lit(1 - alpha), F.col("k") - F.col("i")) * F.col("y")))
    return rows.groupBy("series_id").agg(p.alias("probability"), F.coalesce(size, F.lit(0.0)).alias("size")).withColumn("tsb", F.col("probability") * F.col("size"))


def intermittent_route(trailing: Column, interval: Column, any_demand: Column) -> Column:
    """SEL6."""
    return F.when(~any_demand, "ZeroForecast").when(trailing >= F.greatest(F.lit(4.0), 2 * F.coalesce(interval, F.lit(0.0))), "TSB").otherwise("SBA")


def cold_start(relative: Column, std_rate: Column, prior: Column, last: Column) -> Column:
    """SEL5: the first of engineered rate, category prior, last value and zero that there is: struct(model, level)."""

    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("model"), value.cast("double").alias("level"))

    return F.when(relative & std_rate.isNotNull(), pair("StandardRateAnchor", std_rate)).when(prior.isNotNull(), pair("CategoryPrior", prior)).when(last.isNotNull() & (last != 0), pair("Naive", last)).otherwise(pair("ZeroForecast", F.lit(0.0)))


def category_priors(series: DataFrame, obs: DataFrame, items: DataFrame, least: int = 6) -> DataFrame:
    """AGG6, JN5: the mean of the series' mean targets by mode, level and category."""
    means = obs.where("is_reliable = 1").groupBy("series_id").agg(F.avg("target").alias("m"))
    rows = series.where(F.col("n_reliable") >= least).join(means, "series_id").join(items.select("item_code", "cat_l1", "cat_l2", "cat_l3"), "item_code")
    levels_ = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(f"cat_l{n}").alias("category")) for n in (1, 2, 3)]))
    return rows.select("mode", "item_code", "m", levels_.alias("c")).where("c.category IS NOT NULL").groupBy("mode", "c.level", "c.category").agg(F.avg("m").alias("prior"), F.countDistinct("item_code").alias("n_items"))


def prior_ladder(series: DataFrame, items: DataFrame, priors: DataFrame) -> DataFrame:
    """JN6: for each series the prior of its narrowest category that has one."""
    out = series.join(items.select("item_code", "cat_l1", "cat_l2", "cat_l3"), "item_code", "left")
    for n in (3, 2, 1):
        p = priors.where(F.col("level") == n).select(F.col("mode").alias("_m"), F.col("category").alias("_c"), F.col("prior").alias(f"p{n}"))
        out = out.join(p, (out["mode"] == F.col("_m")) & (out[f"cat_l{n}"] == F.col("_c")), "left").drop("_m", "_c")
    return out.select("series_id", F.coalesce("p3", "p2", "p1").alias("prior"), F.when(F.col("p3").isNotNull(), 3).when(F.col("p2").isNotNull(), 2).when(F.col("p1").isNotNull(), 1).alias("level"))
