"""Whole runs: from tables to stored forecasts, and the import of what happened (entry points A and C of the build plan)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from threading import Event, Thread

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import backtest as T
from ..operators import context as C
from ..operators import contextual as X
from ..operators import explain as E
from ..operators import fitted as M
from ..operators import forecast as G
from ..operators import learn as L
from ..operators import prepare as P
from ..operators import profile as B
from ..operators import validate as V
from ..sources.mapping import RawTables
from ..sources.store import Repository
from ..staging import staged


class FatalData(ValueError):
    """A rule found what no run can go on with."""


class Cancelled(RuntimeError):
    """A run was asked to stop; its rows are gone."""


@dataclass(frozen=True)
class Callbacks:
    """What a caller may follow a run by: ``progress(stage, share done)``, and ``cancelled()``, which is asked between stages."""

    progress: Callable[[str, float], None] = lambda stage, share: None
    cancelled: Callable[[], bool] = lambda: False

    def at(self, stage: str, share: float) -> None:
        if self.cancelled():
            raise Cancelled(stage)
        self.progress(stage, share)


@dataclass
class Conditions:
    """What is known of operating conditions: ``contextual.extended_rows``, the factors' names, and the diagnosis of each series."""

    ext: DataFrame
    names: list[str]
    diagnosis: DataFrame


def scoped(series: DataFrame, raw: RawTables, cfg: EngineConfig) -> DataFrame:
    """PRJ3, PRJ4: the series to forecast; all are analysed."""
    if cfg.scope.item_codes:
        series = series.where(F.col("item_code").isin(*cfg.scope.item_codes))
    if cfg.scope.bom_items_only:
        series = series.join(raw.items.select("item_code").distinct(), "item_code", "left_semi")
        if series.isEmpty():
            raise ValueError("no series has a listed item")
    return series


def operating_conditions(fit: DataFrame, series: DataFrame, driver: DataFrame, calendar: DataFrame, cfg: EngineConfig) -> Conditions:
    """The conditions of each series over its history and horizon, and whether they matter (CTX1-CTX14)."""
    rows = C.conditions(driver, cfg)
    rows, names = C.with_calendar(rows, C.calendar_factors(calendar, cfg))
    rows = C.extended_labels(rows, names)
    some = not driver.isEmpty()
    ext = X.extended_rows(fit, series, rows, names, cfg)
    return Conditions(ext, names, X.diagnosis(ext, cfg, cfg.context.enabled, some, some and C.has_variance(rows, names)))


def with_rates(series: DataFrame, raw: RawTables) -> DataFrame:
    """JN7: the engineered rate of each series; of repeated ones the greatest."""
    std = P.first_rows(raw.standard_rates, P.KEYS, [F.desc("std_rate")]).select(*P.KEYS, "std_rate")
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in P.KEYS]
    return series.alias("s").join(std.alias("r"), same, "left").select("s.*", "r.std_rate")


def with_anchor(fit: DataFrame, rated: DataFrame) -> DataFrame:
    """SEL1: the engineered rate beside each row of a relative series."""
    return fit.join(rated.select("series_id", F.when(F.col("mode") == "relative", F.col("std_rate")).alias("anchor")), "series_id")


def single_levels(fit: DataFrame, rated: DataFrame, raw: RawTables, obs: DataFrame, cfg: EngineConfig) -> DataFrame:
    """A row a series with what flat models would forecast: ``anchor, prior, sba, croston, tsb, last``, and what the routes of intermittent series ask (``trailing, interval, some``)."""
    gaps = fit.withColumn("hit", F.when(F.col("y") > 0, F.col("idx")))
    gaps = gaps.withColumn("gap", F.col("hit") - F.last("hit", True).over(P.IN_ORDER().rowsBetween(-(1 << 31), -1))).groupBy("series_id").agg((F.count(F.lit(1)) - 1 - F.coalesce(F.max("hit"), F.lit(-1))).alias("trailing"), F.median("gap").alias("interval"), F.max(F.col("y") > 0).alias("some"), F.max_by("y", "idx").alias("last"), F.max(F.col("y") != 0).alias("moved"))
    events = T.croston(fit).select("series_id", "sba", "croston").join(T.tsb(fit).select("series_id", "tsb"), "series_id", "full")
    prior = T.prior_ladder(rated, raw.items, T.category_priors(rated, obs, raw.items, cfg.gate.min_history_competition)).select("series_id", "prior")
    out = rated.select("series_id", F.when(F.col("mode") == "relative", F.col("std_rate")).alias("anchor"))
    for part in (gaps, events, prior):
        out = out.join(part, "series_id", "left")
    return out


def scored_candidates(fit: DataFrame, rated: DataFrame, cfg: EngineConfig, known: Conditions | None = None) -> DataFrame:
    """Results of all candidates of the series that compete (CAN1-CAN3, CAN5, SEL1, SEL3); context models only where conditions matter."""
    compete = rated.where(T.gate(F.col("n_reliable"), F.col("pattern_class"), cfg) == "compete").select("series_id")
    own = fit.join(compete, "series_id", "left_semi")
    rows = T.fold_rows(with_anchor(own, rated), cfg).unionByName(M.fitted_folds(own, None, cfg))
    if known is not None:
        offered = known.diagnosis.where("material = 1").select("series_id").join(compete, "series_id", "left_semi")
        more = X.context_folds(known.ext.join(offered, "series_id", "left_semi"), known.names, cfg)
        rows = rows if more is None else rows.unionByName(more)
    return T.competition(rows, cfg)


def selections(rated: DataFrame, flat: DataFrame, scored: DataFrame, cfg: EngineConfig) -> DataFrame:
    """``series_id, route, model, mase, n_origins, reason_code`` of each series (BT1, SEL2, SEL4-SEL7)."""
    routed = rated.withColumn("route", T.gate(F.col("n_reliable"), F.col("pattern_class"), cfg))
    best = T.winners(scored, cfg).select("series_id", F.col("model").alias("won"), "mase", "n_origins")
    out = routed.select("series_id", "mode", "route").join(flat, "series_id", "left").join(best, "series_id", "left")
    event = T.intermittent_route(F.col("trailing"), F.col("interval"), F.coalesce("some", F.lit(False)))
    cold = F.when(F.col("anchor").isNotNull(), "StandardRateAnchor").when(F.col("prior").isNotNull(), "CategoryPrior").when(F.col("moved"), "Naive").otherwise("ZeroForecast")
    won = (F.col("route") == "compete") & F.col("won").isNotNull()
    routed_ = F.col("route") == "routed"
    model = F.when(routed_, event).when(won, F.col("won")).otherwise(cold)
    names = F.create_map(*[F.lit(x) for kv in {"StandardRateAnchor": "cold_start_standard_rate", "CategoryPrior": "cold_start_category_prior", "Naive": "cold_start_naive", "ZeroForecast": "cold_start_zero"}.items() for x in kv])
    events = F.create_map(*[F.lit(x) for kv in {"SBA": "routed_sba", "TSB": "routed_tsb_obsolescence", "ZeroForecast": "routed_zero"}.items() for x in kv])
    code = F.when(routed_, F.element_at(events, event)).when(won, "competition_winner").otherwise(F.element_at(names, cold))
    route = F.when((F.col("route") == "compete") & ~won, "compete_fallback").otherwise(F.col("route"))
    return out.select("series_id", route.alias("route"), model.alias("model"), "mase", "n_origins", code.alias("reason_code"))


#: Models whose forecast is one level, and the column of ``single_levels`` that has it.
LEVEL_OF = {"StandardRateAnchor": "anchor", "CategoryPrior": "prior", "SBA": "sba", "Croston": "croston", "TSB": "tsb", "ZeroForecast": None}


def model_points(fit: DataFrame, wanted: DataFrame, flat: DataFrame, cfg: EngineConfig, known: Conditions | None = None) -> DataFrame:
    """``series_id, model, step, point, sigma, grows`` of all ``wanted`` (``series_id, model``) over the whole history (SEL10), whatever kind the model is of; none where it cannot be fitted."""
    wanted = wanted.select("series_id", "model").where("model <> 'Ensemble'").distinct()
    native = G.points(G.final_fits(fit, wanted.where(F.col("model").isin(*[c.name for c in T.candidates(cfg)])), cfg), cfg).where("point IS NOT NULL")
    made = native.unionByName(M.fitted_forecasts(fit, wanted, cfg))
    one = F.array(*[F.struct(F.lit(m).alias("model"), (F.lit(0.0) if c is None else F.col(c).cast("double")).alias("point")) for m, c in LEVEL_OF.items()])
    levels = flat.select("series_id", F.explode(one).alias("x")).select("series_id", "x.*").where("point IS NOT NULL").join(wanted, ["series_id", "model"], "left_semi")
    spread = fit.select("series_id", "y").join(levels, "series_id").groupBy("series_id", "model", "point").agg(F.stddev_pop(F.col("y") - F.col("point")).alias("sigma"))
    made = made.unionByName(spread.select("series_id", "model", F.explode(F.sequence(F.lit(1), F.lit(cfg.forecast.horizon))).alias("step"), "point", "sigma", F.lit(False).alias("grows")))
    if known is not None:
        made = made.unionByName(X.context_forecasts(known.ext, wanted.where(F.col("model").isin(*T.CONTEXT)), known.names, cfg))
    return made


def with_members(chosen: DataFrame, scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen models and those that chosen ensembles are made of; and the latter."""
    inside = T.members(scored).join(chosen.where("model = 'Ensemble'").select("series_id"), "series_id", "left_semi")
    return chosen.select("series_id", "model").unionByName(inside), inside


def point_forecasts(fit: DataFrame, chosen: DataFrame, flat: DataFrame, scored: DataFrame, cfg: EngineConfig, known: Conditions | None = None) -> DataFrame:
    """Points of each series' chosen model, or of the mean of its ensemble's members."""
    wanted, inside = with_members(chosen, scored)
    made = model_points(fit, wanted, flat, cfg, known)
    return made.join(chosen.select("series_id", "model"), ["series_id", "model"], "left_semi").unionByName(G.averaged(made, inside))


class Watch:
    """Asks ``cancelled`` while Spark works, and stops the jobs of this thread when it says so; ``stopped`` tells that apart from a failure."""

    def __init__(self, spark: SparkSession, cancelled: Callable[[], bool], every: float = 0.5):
        self.context, self.cancelled, self.every = spark.sparkContext, cancelled, every
        self.tag, self.stopped, self._over = f"run-{uuid.uuid4().hex}", False, Event()

    def _ask(self) -> None:
        while not self._over.wait(self.every):
            if self.stopped or self.cancelled():
                self.stopped = True
                self.context.cancelJobsWithTag(self.tag)  # again, until no job is begun any more

    def __enter__(self) -> Watch:
        self.context.addJobTag(self.tag)
        self._thread = Thread(target=self._ask, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._over.set()
        self._thread.join()
        self.context.removeJobTag(self.tag)


def run_forecast(spark: SparkSession, raw: RawTables, store: Repository, cfg: EngineConfig = EngineConfig(), callbacks: Callbacks = Callbacks()) -> str:
    """Validate, prepare, analyse, select, forecast, explain and store; the run's id. A run that breaks is marked failed and leaves no rows; one that is cancelled, also within a stage, is as if it had not been."""
    run_id = store.create_run(asdict(cfg), raw.source_name)
    failure = None
    with Watch(spark, callbacks.cancelled) as watch:
        try:
            _stages(spark, raw, store, cfg, callbacks, run_id)
        except BaseException as e:
            failure = e
    # Here no job is cancelled any more.
    if failure is None:
        store.finish_run(run_id)
        return run_id
    if watch.stopped or isinstance(failure, Cancelled):
        store.delete_run(run_id)
        raise failure if isinstance(failure, Cancelled) else Cancelled("within a stage") from failure
    store.delete_run_rows(run_id)
    store.finish_run(run_id, "failed")
    raise failure


def _stages(spark: SparkSession, raw: RawTables, store: Repository, cfg: EngineConfig, callbacks: Callbacks, run_id: str) -> None:
    callbacks.at("validate", 0.0)
    found = store.append("validation_result", run_id, V.run_all(raw, cfg))
    if V.has_fatal(found):
        raise FatalData(", ".join(r["message"] for r in found.where("severity = 'fatal'").limit(8).collect()))
    callbacks.at("prepare", 0.1)
    p = P.build_series(raw, cfg, store.read("mode_override"))
    obs = store.replace("observation", p.observations)
    store.append("validation_result", run_id, V.preparation(obs))
    callbacks.at("analyse", 0.2)
    profile = B.profile(obs, cfg).join(B.decomposition(B.applicable_rows(obs), cfg.season), "series_id", "left")
    series = store.replace("series", scoped(P.series_of(obs, raw.consumption), raw, cfg).join(profile.select("series_id", "pattern_class", "forecastability", "data_quality", "break_period", "adi", "cv2", "cv", "autocorr_lag1", "outlier_pct", "missing_pct", "trend_strength", "seasonal_strength", "stationary"), "series_id", "left"))
    driver = store.replace("driver", p.driver)
    store.replace("item", raw.items)
    store.replace("standard_rate", raw.standard_rates)
    fit = staged(P.fit_targets(obs.join(series.select("series_id"), "series_id", "left_semi")), "fit")  # five steps read it
    callbacks.at("conditions", 0.3)
    known = None
    if cfg.context.enabled:
        known = operating_conditions(fit, series, driver, raw.calendar, cfg)
        known.ext = store.append("condition", run_id, known.ext).drop("run_id")
        known.diagnosis = store.replace("series_context", known.diagnosis)
    callbacks.at("select", 0.4)
    rated = staged(with_rates(series, raw), "rated")
    flat = store.append("flat", run_id, single_levels(fit, rated, raw, obs, cfg)).drop("run_id")
    scored = store.append("validation", run_id, scored_candidates(fit, rated, cfg, known)).drop("run_id")
    chosen = store.append("winner", run_id, selections(rated, flat, scored, cfg)).drop("run_id")  # forecasts and reasons read it again
    callbacks.at("forecast", 0.6)
    planned = store.read("model_override")
    wanted, inside = with_members(chosen, scored)
    if planned is not None:
        asked = planned.join(series.select("series_id"), "series_id", "left_semi").select("series_id", E.wanted_name(F.col("model"), cfg.models.lookback_windows[0]).alias("model"))
        wanted = wanted.unionByName(asked)
    made = store.append("point", run_id, model_points(fit, wanted, flat, cfg, known)).drop("run_id")
    made = made.unionByName(G.averaged(made, inside))
    if planned is not None:
        chosen = E.with_overrides(chosen, made, scored, planned, cfg.models.lookback_windows[0])
    else:
        chosen = chosen.withColumn("override_reason", F.lit(None).cast("string")).withColumn("is_override", F.lit(0))
    facts = series.select("series_id", "n_reliable", "forecastability", "data_quality", "trend_strength", "seasonal_strength")
    score = G.confidence_score(F.col("mase"), F.col("n_reliable"), F.col("forecastability"), F.col("data_quality"), F.col("mase").isNull(), cfg.gate.seasonal_min_history)
    why = E.selection_reason(F.col("reason_code"), F.col("model"), F.col("mase"), F.coalesce("n_origins", F.lit(0)), F.col("n_reliable"))
    told = chosen.join(facts, "series_id").withColumn("reason", why).withColumn("confidence", score).withColumn("confidence_label", G.confidence_label(F.col("confidence"))).withColumn("window", F.nullif(F.regexp_extract("model", r"\((\d+)\)", 1), F.lit("")).cast("int"))
    store.append("selection", run_id, told.drop("n_reliable", "forecastability", "data_quality", "trend_strength", "seasonal_strength").join(E.rejected_json(scored, chosen, facts), "series_id", "left"))
    chosen = store.read("selection", run_id).drop("run_id")
    own = made.join(chosen.select("series_id", "model"), ["series_id", "model"], "left_semi")
    rows = G.reconstruct(G.horizon(own, series, cfg), driver, cfg).join(chosen.select("series_id", "confidence"), "series_id", "left")
    store.append("forecast", run_id, rows)
    callbacks.at("explain", 0.9)
    low = obs.groupBy("series_id").agg(F.sum("is_low_driver").alias("n_low"))
    notes = E.caveats(series.join(chosen.select("series_id", "model", "reason_code"), "series_id").join(C.driver_variation(fit), "series_id", "left").join(low, "series_id", "left"))
    store.append("warning", run_id, notes.unionByName(E.failures(chosen, store.read("forecast", run_id))))
    callbacks.at("finish", 1.0)


def import_actuals(raw: RawTables, store: Repository, run_id: str | None = None) -> DataFrame:
    """Errors of a stored run against newer consumption, in that run's granularity; repeated imports change nothing. Gives the series that drift, which are warnings of that run too (VAL21)."""
    run = next(r for r in store.runs() if r["run_id"] == run_id) if run_id else store.latest_complete()
    if run is None:
        raise ValueError("there is no completed run")
    actual = L.actuals(raw.consumption, run["config"]["granularity"])
    rows = L.accuracy(store.read("forecast", run["run_id"]).drop("model"), actual, store.read("selection", run["run_id"]))
    store.upsert_accuracy(rows.select("series_id", "period", F.lit(run["run_id"]).alias("run_id"), "forecast_value", "actual_value", "error", "abs_pct_error", "model"))
    found = L.drift(store.read("accuracy_history"))
    store.put_notes("warning", run["run_id"], "ACCURACY_DRIFT", L.drift_warnings(found))
    return found.where("drifting = 1")
