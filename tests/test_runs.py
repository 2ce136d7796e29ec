"""Whole runs on a star schema: one in which series compete, one of routed series, and the learning loop after it."""

from __future__ import annotations

import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from rateline.config import EngineConfig, Forecast, Scope
from rateline.operators import backtest as T
from rateline.plans import run
from rateline.sources import star_schema
from rateline.sources.exports import build_frames, dictionary, export_run, formats, preview, tooltip
from rateline.sources.store import Repository
from rateline.streaming.actuals import windowed, write_to

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def few(horizon: int, *items: str) -> EngineConfig:
    return replace(EngineConfig(), forecast=Forecast(horizon=horizon), scope=Scope(item_codes=items))


def test_series_compete_and_all_have_forecasts(spark, tmp_path):
    cfg = few(7, "Brand#11", "Brand#2")
    store = Repository(spark, f"file://{tmp_path}/store")
    raw = star_schema.load(spark, LARGER)
    seen = []
    first = run.run_forecast(spark, raw, store, cfg, run.Callbacks(progress=lambda stage, share: seen.append((stage, share))))
    assert [s for s, _ in seen] == ["validate", "prepare", "analyse", "conditions", "select", "forecast", "explain", "finish"] and seen[-1][1] == 1.0
    chosen = {r["series_id"]: r for r in store.read("selection", first).collect()}
    made = store.read("forecast", first)
    assert len(chosen) == 30 == store.read("series").count()
    assert made.groupBy("series_id").count().where("count = 7").count() == 30 and made.where("target_value IS NULL OR lower_95 > upper_95").count() == 0
    assert store.read("warning", first).where("code = 'SERIES_FAILED'").count() == 0
    competing = [r for r in chosen.values() if r["route"] == "compete"]
    assert len(competing) > 20 and len({r["model"] for r in competing}) > 2
    fitted = [r for r in competing if r["model"] in (*T.FITTED, "HoltWinters")]
    assert fitted, "no series was won by a fitted model"
    scored = store.read("validation", first)
    tried = {r["model"] for r in scored.select("model").distinct().collect()}
    assert {"Naive", "SES", "DampedHolt", "Theta", "Holt", "HoltWinters", "ETS", "SeasonalNaive", "StandardRateAnchor", "Ensemble"} <= tried
    wanted = T.candidate_sets(run.with_rates(store.read("series"), raw), cfg).where("route = 'compete'").select("series_id", "model")
    others = scored.where("model <> 'Ensemble'").join(wanted, ["series_id", "model"], "left_anti")
    material = store.read("series_context").where("material = 1").select("series_id")
    assert others.join(material, "series_id", "left_anti").count() == 0 and {r["model"] for r in others.collect()} <= set(T.CONTEXT)
    # a planner's choices: a fitted model, one by its family name, one that cannot be had
    ids = sorted(r["series_id"] for r in competing)[:4]
    for sid, model in zip(ids, ("Holt", "MovingAverage", "NoSuchModel", "CategoryPrior")):
        store.set_override("model_override", sid, model)
    second = run.run_forecast(spark, raw, store, replace(cfg, scope=Scope(item_codes=("Brand#11", "Brand#2"))))
    again = {r["series_id"]: r for r in store.read("selection", second).collect()}
    assert [again[i]["model"] for i in (ids[0], ids[1], ids[3])] == ["Holt", "MovingAverage(3)", "CategoryPrior"] and again[ids[2]]["model"] == chosen[ids[2]]["model"]
    assert [again[i]["is_override"] for i in ids] == [1, 1, 0, 1] and "NoSuchModel" in again[ids[2]]["override_reason"]
    assert store.read("forecast", second).where(F.col("series_id") == ids[0]).first()["model"] == "Holt"
    # what is handed on
    frames = build_frames(store, second)
    assert set(frames) == {"forecasts", "selections", "series", "context", "warnings"}
    for name, df in frames.items():
        assert df.columns[:4] == ["item_code", "description", "line", "output_type"] and (name == "warnings" or "series_id" not in df.columns)
    assert frames["forecasts"].count() == 210 and build_frames(store, second, [ids[0]])["selections"].count() == 1
    words = dictionary(frames, spark)
    assert words.where("formula = ''").count() == 0 and words.count() == sum(len(df.columns) for df in frames.values())
    assert tooltip("forecasts", "step") and not tooltip("forecasts", "nothing")
    shared = {r["format"] for r in formats(frames["forecasts"]).where("column_name IN ('target_value', 'lower_80', 'upper_95')").collect()}
    assert len(shared) == 1 and preview(frames["forecasts"]).count() == 10 and preview(frames["forecasts"], long=True).count() == 200
    export_run(store, f"file://{tmp_path}/out", second, kind="csv")
    assert spark.read.csv(f"file://{tmp_path}/out/data_dictionary", header=True).count() == words.count()
    ordered = [tuple(r) for r in store.read("forecast", second, ordered=True).select("series_id", "period_start").collect()]
    assert ordered == sorted(ordered)


def test_run_and_import(spark, tmp_path):
    cfg = few(6, "Brand#1", "Brand#2")
    store = Repository(spark, f"file://{tmp_path}/store")
    with pytest.raises(ValueError):
        export_run(store, f"file://{tmp_path}/out")
    rid = run.run_forecast(spark, star_schema.load(spark, SF), store, replace(cfg, context=replace(cfg.context, enabled=False)))
    assert store.latest_complete()["run_id"] == rid and store.read("series_context") is None
    f, n = store.read("forecast", rid), store.read("series").count()
    assert n == 30 and f.count() == 6 * n
    later = star_schema.load(spark, SF, "2002-01-01")
    run.import_actuals(later, store)
    once = store.read("accuracy_history").count()
    run.import_actuals(later, store)
    assert store.read("accuracy_history").count() == once > 0
    drifts = store.read("warning", rid).where("code = 'ACCURACY_DRIFT'")
    assert drifts.count() == drifts.select("series_id").distinct().count()
    with pytest.raises(run.FatalData):
        raw = star_schema.load(spark, SF)
        raw.failures = spark.createDataFrame([("consumption.date", 3)], "column_name string, n long")
        run.run_forecast(spark, raw, store, cfg)
    assert [r["status"] for r in store.runs()] == ["failed", "complete"]
    with pytest.raises(run.Cancelled):
        run.run_forecast(spark, star_schema.load(spark, SF), store, cfg, run.Callbacks(cancelled=lambda: True))
    assert len(store.runs()) == 2


def test_run_cancelled_within_a_stage(spark, tmp_path):
    """A job that would take minutes ends within seconds of the word, and the run leaves nothing."""
    store, began = Repository(spark, f"file://{tmp_path}/store"), []

    def slow(stage, share):
        if stage == "prepare":
            began.append(time.time())
            spark.range(0, 10**12, 1, 4).agg(F.sum(F.sqrt("id"))).collect()

    with pytest.raises(run.Cancelled):
        run.run_forecast(spark, star_schema.load(spark, SF), store, few(3, "Brand#1"), run.Callbacks(progress=slow, cancelled=lambda: bool(began) and time.time() > began[0] + 2))
    assert time.time() - began[0] < 30 and store.runs() == [] and store.read("validation_result").count() == 0
    assert spark.range(5).count() == 5  # other jobs of the session are not touched


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(f"{tmp_path}/in")
    q = write_to(windowed(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").agg(F.sum("n")).first()[0]
    newest = events.agg(F.max("ts")).first()[0]
    want = events.where(F.date_trunc("day", "ts") + F.expr("interval 3 days") <= F.lit(newest)).count()
    assert got == want


def test_entry_without_the_training_data_part(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
