"""Reasons, caveats, badges and labels as expressions (EXP1-EXP6, PRJ10, JN17, JN18, SEL8, SEL9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOT_LISTED, NOT_ITEM = "(not in bom)", "(not item-specific)"


def described(rows: DataFrame, items: DataFrame) -> DataFrame:
    """JN17: identity columns first."""
    names = items.where("item_code IS NOT NULL").groupBy("item_code").agg(F.min("description").alias("_d"))
    text = F.when(F.col("item_code").isNull(), NOT_ITEM).otherwise(F.coalesce("_d", F.lit(NOT_LISTED)))
    first = ["item_code", "description", "line", "output_type"]
    return rows.join(names, "item_code", "left").withColumn("description", text).select(*first, *[c for c in rows.columns if c not in first])


def expanded(df: DataFrame) -> DataFrame:
    """EXP5: the parts of a series' id, empty ones null."""
    part = lambda i: F.nullif(F.get(F.split("series_id", r"\|"), F.lit(i)), F.lit(""))
    return df.withColumn("item_code", part(0)).withColumn("line", part(1)).withColumn("output_type", part(2))


def selection_reason(code: Column, model: Column, mase: Column, n_origins: Column, n_reliable: Column | None = None) -> Column:
    """EXP1: why a series has its model."""
    windows = F.concat(n_origins.cast("string"), F.when(n_origins == 1, " back-test window").otherwise(" back-test windows"))
    few = F.lit("there is too little usable history to compare models") if n_reliable is None else F.format_string("%d usable periods are too few to compare models", n_reliable)
    texts = {
        "competition_winner": F.concat(model, F.lit(" was the most dependable of the models within reach of the least error over "), windows, F.coalesce(F.format_string(" (scaled error %.3f)", mase), F.lit(""))),
        "cold_start_standard_rate": F.concat(few, F.lit("; the engineered rate is the best starting point")),
        "cold_start_category_prior": F.concat(few, F.lit("; items of the same category show what is usual")),
        "cold_start_naive": F.concat(few, F.lit("; with no engineered rate and no category to lean on, the last value is carried on")),
        "cold_start_zero": F.lit("nothing was consumed so far, so nothing is forecast"),
        "routed_sba": F.lit("demand comes in single events, whose size and spacing are smoothed"),
        "routed_tsb_obsolescence": F.lit("demand came in single events and has stopped for long, so its chance is let fade"),
        "routed_zero": F.lit("there was never any demand"),
        "planner_override": F.concat(model, F.lit(" was set by a planner")),
    }
    out = F.lit(None).cast("string")
    for k, v in texts.items():
        out = F.when(code == k, v).otherwise(out)
    return F.coalesce(out, F.concat(model, F.lit(" was chosen")))


# Which models assume a trend, a season, or neither, and which smooth.
TRENDING, SEASONAL, FLAT = ("Drift", "Holt", "DampedHolt"), ("SeasonalNaive", "HoltWinters"), ("Mean", "MovingAverage", "WeightedMovingAverage", "SES")
SMOOTHING = ("SES", "Holt", "DampedHolt", "HoltWinters", "ETS", "Theta")
CONTEXTUAL = ("FixedPlusVariable", "RegimeConditional", "ContextRegression")


def rejection_reason(status: Column, mase: Column, best: Column, model: Column | None = None, trend: Column | None = None, season: Column | None = None) -> Column:
    """EXP2: why a candidate was not chosen; with the model's name and the series' strengths of trend and season, also what may be behind it."""
    worse = F.round(100 * (mase / F.nullif(best, F.lit(0.0)) - 1), 1)
    said = F.when(status == "failed", "it could not be fitted").when(status == "skipped", "too few back-test windows").when(mase.isNull(), "its error is not finite").when(mase <= best, "as good, but less dependable")
    more = F.concat(F.coalesce(worse.cast("string"), F.lit("many")), F.lit(" % more error"))
    if model is None:
        return said.otherwise(more)
    family = F.substring_index(model, "(", 1)
    none = F.lit(None).cast("double")
    t, s = F.coalesce(none if trend is None else trend, F.lit(0.0)), F.coalesce(none if season is None else season, F.lit(0.0))
    hint = F.when(family.isin(*TRENDING) & (t < 0.3), ": the trend it assumes does not hold").when(family.isin(*SEASONAL) & (s < 0.3), ": there is no season to use").when(family.isin(*FLAT) & (t > 0.6), ": it cannot follow the trend")
    hint = hint.when(family == "Naive", ": the last value alone says less").when(family.isin(*CONTEXTUAL), ": what ran explains less than the history itself").otherwise("")
    return said.otherwise(F.concat(more, hint))


def rejected_json(scored: DataFrame, winners: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """SEL9: a row a series with its other candidates, the least error first, as JSON. ``facts`` (``trend_strength, seasonal_strength``) makes reasons say more."""
    won = winners.select("series_id", F.col("model").alias("_won"), F.col("mase").alias("_best"))
    rows = scored.join(won, "series_id").where("model <> _won")
    said = rejection_reason(F.col("status"), F.col("mase"), F.col("_best"))
    if facts is not None:
        rows = rows.join(facts.select("series_id", "trend_strength", "seasonal_strength"), "series_id", "left")
        said = rejection_reason(F.col("status"), F.col("mase"), F.col("_best"), F.col("model"), F.col("trend_strength"), F.col("seasonal_strength"))
    one = F.struct(F.coalesce(F.round("mase", 9), F.lit(float("1e300"))).alias("order"), F.col("model").alias("model"), F.round("mase", 4).alias("mase"), said.alias("reason"))
    listed = F.transform(F.sort_array(F.collect_list(one)), lambda x: F.struct(x["model"].alias("model"), x["mase"].alias("mase"), x["reason"].alias("reason")))
    return rows.groupBy("series_id").agg(F.to_json(listed).alias("rejected"))


def with_overrides(chosen: DataFrame, made: DataFrame, scored: DataFrame, overrides: DataFrame, first_window: int = 3) -> DataFrame:
    """SEL8, CAN6: a planner's model (``series_id, model``) takes the place of the winner where it has a forecast (``series_id, model`` of ``made``); where not, the winner stays and ``override_reason`` says so. A moving average without a window has the first one."""
    want = overrides.select("series_id", wanted_name(F.col("model"), first_window).alias("_want"))
    have = made.select("series_id", F.col("model").alias("_want"), F.lit(True).alias("_ok")).distinct()
    error = scored.where("status = 'ok'").select("series_id", F.col("model").alias("_want"), F.col("mase").alias("_mase"), F.col("n_origins").alias("_n"))
    rows = chosen.join(want, "series_id", "left").join(have, ["series_id", "_want"], "left").join(error, ["series_id", "_want"], "left")
    asked = F.col("_want").isNotNull() & (F.col("_want") != F.col("model"))
    done = asked & F.coalesce("_ok", F.lit(False))
    rows = rows.withColumn("override_reason", F.when(asked & ~done, F.concat(F.lit("the planner's "), "_want", F.lit(" could not be used for this series; the winner was kept"))))
    for to, source in (("reason_code", F.lit("planner_override")), ("mase", F.col("_mase")), ("n_origins", F.col("_n")), ("model", F.col("_want"))):
        rows = rows.withColumn(to, F.when(done, source).otherwise(F.col(to)))
    return rows.withColumn("is_override", (F.col("reason_code") == "planner_override").cast("int")).drop("_want", "_ok", "_mase", "_n")


def wanted_name(model: Column, first_window: int) -> Column:
    return F.when(model.isin("MovingAverage", "WeightedMovingAverage"), F.concat(model, F.lit(f"({first_window})"))).otherwise(model)


def badge(quality: Column, orphan: Column, broken: Column, drifting: Column, confidence: Column) -> Column:
    """PRJ10: the first of what a planner should look at."""
    return F.when((quality < 0.6) | (orphan == 1), "quality").when(broken.isNotNull(), "structural").when(drifting == 1, "declining").when(confidence < 0.40, "review").otherwise("ok")


def portfolio(series: DataFrame, profile: DataFrame, chosen: DataFrame, drift: DataFrame | None = None) -> DataFrame:
    """JN18: a row a series with its badge and confidence label."""
    rows = series.join(profile, "series_id", "left").join(chosen, "series_id", "left")
    rows = rows.join(drift.select("series_id", "drifting"), "series_id", "left") if drift is not None else rows.withColumn("drifting", F.lit(0))
    sure = F.coalesce("confidence", F.lit(0.0))
    return rows.withColumn("badge", badge(F.coalesce("data_quality", F.lit(0.0)), F.col("is_orphan"), F.col("break_period"), F.coalesce("drifting", F.lit(0)), sure)).withColumn("confidence_label", F.when(sure < 0.40, "low").when(sure < 0.70, "medium").otherwise("high"))


#: By what a portfolio is sorted.
SORTS = ("confidence", "mase", "data_quality", "n_reliable", "description", "item_code")


def portfolio_view(rows: DataFrame, badges: tuple = (), modes: tuple = (), classes: tuple = (), confidences: tuple = (), sort: str = "confidence", descending: bool = False) -> DataFrame:
    """PRJ6, ORD4: a portfolio filtered (nothing given: not filtered) and sorted, nulls last and ties by series."""
    if sort not in SORTS:
        raise ValueError(f"sort by one of {SORTS}")
    for column, values in (("badge", badges), ("mode", modes), ("pattern_class", classes), ("confidence_label", confidences)):
        if values:
            rows = rows.where(F.col(column).isin(*values))
    by = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return rows.orderBy(by, "series_id")


def picker_labels(items: DataFrame, used: DataFrame) -> DataFrame:
    """EXP4: ``item_code, label`` of the items in use, described ones first."""
    names = items.groupBy("item_code").agg(F.min("description").alias("_d"))
    named = used.select("item_code").where("item_code IS NOT NULL").distinct().join(names, "item_code", "left").withColumn("description", F.coalesce("_d", F.lit(NOT_LISTED)))
    known = F.col("description") != NOT_LISTED
    label = F.when(known, F.concat("item_code", F.lit(": "), "description")).otherwise(F.concat("item_code", F.lit(" "), "description"))
    return named.select("item_code", label.alias("label"), known.alias("listed")).orderBy(F.desc("listed"), "item_code").select("item_code", "label")


# Names of conditions and badges in words (EXP6).
WORDS = {"n_active": "how many lines ran", "is_solo": "whether it ran alone", "own_share": "its share of output", "system_driver": "output of all lines", "utilization": "how hard it ran", "mix_entropy": "how mixed output was", "ok": "forecast can stand", "review": "look at it", "structural": "its behaviour changed", "quality": "its data are poor", "declining": "errors are growing"}


def in_words(name: Column) -> Column:
    """EXP6: a feature or badge as a planner says it; a calendar's factor without its prefix."""
    table = F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv])
    return F.coalesce(F.element_at(table, name), F.replace(F.regexp_replace(name, "^ctx_", ""), F.lit("_"), F.lit(" ")))


def caveats(rows: DataFrame) -> DataFrame:
    """EXP3, VAL20: notes of a run about single series (``is_orphan, mode_source, driver_cv, model, reason_code, n_low``)."""
    smooth = F.substring_index("model", "(", 1).isin(*SMOOTHING)
    note = lambda code, severity, text: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), text.alias("message"))
    low = F.coalesce("n_low", F.lit(0)) if "n_low" in rows.columns else F.lit(0)
    notes = F.array(
        F.when(F.col("is_orphan") == 1, note("ORPHAN_RECONSTRUCTION", "warning", F.lit("rates without a driver: quantities were forecast"))),
        F.when(F.col("mode_source").startswith("declared"), note("DECLARED_MODE", "info", F.concat(F.lit("handled as declared: "), "mode"))),
        F.when((F.col("driver_cv") > 0.5) & smooth, note("SMOOTHING_BIAS_RISK", "warning", F.format_string("the driver varies too much (%.2f) for a smoothed rate", "driver_cv"))),
        F.when(F.col("reason_code") == "routed_tsb_obsolescence", note("OBSOLESCENCE_SIGNAL", "warning", F.lit("no demand for long: it may have ended"))),
        F.when(low > 0, note("LOW_DRIVER_EXCLUDED", "info", F.format_string("%d periods in which the line hardly ran were left out", low.cast("int")))),
    )
    return rows.select("series_id", F.explode(F.filter(notes, lambda x: x.isNotNull())).alias("x")).select("series_id", "x.*")


def failures(chosen: DataFrame, made: DataFrame) -> DataFrame:
    """VAL20: series whose model gave no forecast."""
    none = chosen.join(made.select("series_id").distinct(), "series_id", "left_anti")
    return none.select("series_id", F.lit("SERIES_FAILED").alias("code"), F.lit("warning").alias("severity"), F.concat("model", F.lit(" could not be fitted to the whole history: no forecast")).alias("message"))


def number_format(df: DataFrame, columns: list[str], groups: tuple[tuple[str, ...], ...] = ()) -> DataFrame:
    """SNK13: a format for each numeric column: whole numbers have no decimals; others as many as show about four digits of the median, 2 to 6, and more where the least value would show as zero. Columns of one of ``groups`` that are there together share theirs."""
    of = {c: "\x01".join(g) for g in groups for c in g if sum(x in columns for x in g) > 1}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(of.get(c, c)).alias("g"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*").where("v IS NOT NULL")
    size = F.when(F.col("v") != 0, F.abs("v"))
    stats = long.groupBy("g").agg(F.median(size).alias("mid"), F.min(size).alias("least"), F.max(F.col("v") != F.floor("v")).alias("parts"))
    digits = lambda v, n: (n - 1 - F.floor(F.log10(v))).cast("int")
    d = F.when(~F.col("parts"), 0).otherwise(F.least(F.lit(6), F.greatest(F.lit(2), digits(F.col("mid"), 4), digits(F.col("least"), 1))))
    each = long.select("column_name", "g").distinct().join(stats, "g")
    return each.select("column_name", d.alias("decimals"), F.when(d == 0, "#,##0").otherwise(F.concat(F.lit("#,##0."), F.repeat(F.lit("0"), d))).alias("format"))


def extended(stored: DataFrame, new: DataFrame, replace: bool = False) -> DataFrame:
    """SET2: rows appended under the stored columns, unknown ones dropped, missing ones null; or put in their place."""
    own = new.select(*[c for c in stored.columns if c in new.columns])
    return stored.limit(0).unionByName(own, allowMissingColumns=True) if replace else stored.unionByName(own, allowMissingColumns=True)


def unknown_columns(stored: DataFrame, new: DataFrame) -> list[str]:
    """SET3."""
    return [c for c in new.columns if c not in stored.columns]


def candidate_table(scored: DataFrame) -> DataFrame:
    """SEL2, ORD2, ORD5: candidates of each series in their order, unscored ones last."""
    w = Window.partitionBy("series_id").orderBy(F.col("mase").asc_nulls_last(), "ordinal")
    return scored.withColumn("rank", F.row_number().over(w))
