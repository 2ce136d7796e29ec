"""Data-quality rules, each a query that gives warning rows (VAL1-VAL19, JN19-JN22, ORD1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..sources.mapping import RawTables
from ..staging import staged
from .prepare import KEYS

FATAL, WARNING, INFO = "fatal", "warning", "info"
SCHEMA = ("code", "severity", "message", "item_code", "line", "output_type", "count")


def warning(df: DataFrame, code: str, severity: Column | str, message: Column | str, count: Column, keys: tuple[str, ...] = KEYS) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(lit(code).alias("code"), lit(severity).alias("severity"), lit(message).alias("message"), *[(F.col(k) if k in keys else F.lit(None).cast("string")).alias(k) for k in KEYS], count.cast("long").alias("count"))


def coercion(raw: RawTables) -> DataFrame:
    bad = raw.failures.where("n > 0")
    dates = F.substring_index("column_name", ".", -1) == "date"
    return warning(bad, "COERCION_FAILURE", F.when(dates, FATAL).otherwise(WARNING), F.concat(F.col("column_name"), F.lit(": values that cannot be read")), F.col("n"), ())


MEASURES = ("qty_base", "qty_ton", "cost", "rate")


def series_facts(raw: RawTables) -> DataFrame:
    """All that rules ask of a series, from one scan of consumption: rows by date are counted before they are shuffled, and each date looks up its driver rows once.

    ``KEYS``, counts of rows (``n``, ``rated``, ``no_qty`` and ``neg_*``) and of
    dates (``dates``, ``repeated``, ``without`` a driver row of that date though
    rated, ``any_without``), and ``combo``, whether the driver table has the
    line and output at all.
    """
    below = [F.count_if(F.col(m) < 0).alias(f"neg_{m}") for m in MEASURES]
    day = raw.consumption.groupBy(*KEYS, "date").agg(F.count(F.lit(1)).alias("n"), F.count("rate").alias("rated"), F.count_if(F.col("qty_base").isNull()).alias("no_qty"), *below)
    combo = raw.driver.select("line", "output_type").distinct().withColumn("combo", F.lit(True))
    driven = raw.driver.where("driver_type = 'actual'").select("date", "line", "output_type").distinct().withColumn("driven", F.lit(True))
    rows = day.join(combo, ["line", "output_type"], "left").join(driven, ["date", "line", "output_type"], "left")
    bare = (F.col("rated") > 0) & F.col("combo").isNotNull() & F.col("driven").isNull()
    return rows.groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in ("n", "rated", "no_qty", *(f"neg_{m}" for m in MEASURES))], F.count("date").alias("dates"), F.count_if(F.col("n") > 1).alias("repeated"),
        F.count_if(bare & F.col("date").isNotNull()).alias("without"), F.max(bare).alias("any_without"), F.max(F.coalesce("combo", F.lit(False))).alias("combo"),
    )


#: Rules of one series: code, severity, message, condition, count; conditions may ask ``derive`` (are rates derived anyway), ``least`` (dates that a competition needs) and ``any_driver``.
SERIES_RULES: tuple[tuple[str, str, str, str, str], ...] = (
    ("DUPLICATE_PERIOD_ROWS", INFO, "dates with several rows, which are summed", "repeated > 0", "repeated"),
    *(("NEGATIVE_VALUE", WARNING, f"negative values of {m}", f"neg_{m} > 0", f"neg_{m}") for m in MEASURES),
    ("MISSING_QUANTITY", WARNING, "rows without a quantity", "no_qty > 0", "no_qty"),
    ("ORPHAN_SERIES", WARNING, "rates without any driver", "rated > 0 AND NOT combo AND any_driver", "rated"),
    ("RATE_DERIVABLE", INFO, "a rate could be derived from the driver", "rated = 0 AND combo AND NOT derive", "n"),
    ("MISSING_DRIVER_PERIODS", WARNING, "dates without a driver record", "any_without", "without"),
    ("MIXED_MODE_SERIES", WARNING, "rows with and without a rate", "rated > 0 AND rated < n", "n - rated"),
    ("INSUFFICIENT_HISTORY", INFO, "too few dates to compare models", "dates < least", "dates"),
)


def series_warnings(facts: DataFrame, driver: DataFrame, codes: tuple[str, ...] | None = None, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Warnings of ``SERIES_RULES`` (of ``codes`` only), all from one pass over the facts."""
    some = driver.agg((F.count(F.lit(1)) > 0).alias("any_driver"))
    rows = facts.crossJoin(F.broadcast(some)).withColumns({"derive": F.lit(cfg.rate.derive_missing), "least": F.lit(cfg.gate.min_history_competition)})  # one row is added to each
    found = [F.when(F.expr(where), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.expr(count).cast("long").alias("count"))) for code, severity, message, where, count in SERIES_RULES if codes is None or code in codes]
    one = rows.select(*KEYS, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("w")).select(*KEYS, "w.*")
    return warning(one, F.col("code"), F.col("severity"), F.col("message"), F.col("count"))


def _series_rule(*codes: str):
    def rule(raw: RawTables, cfg: EngineConfig = EngineConfig()) -> DataFrame:
        return series_warnings(series_facts(raw), raw.driver, codes, cfg)

    rule.__doc__ = f"{', '.join(codes)} alone."
    return rule


duplicates, negatives, missing_quantity = _series_rule("DUPLICATE_PERIOD_ROWS"), _series_rule("NEGATIVE_VALUE"), _series_rule("MISSING_QUANTITY")
orphans, derivable, missing_driver = _series_rule("ORPHAN_SERIES"), _series_rule("RATE_DERIVABLE"), _series_rule("MISSING_DRIVER_PERIODS")
mixed_mode, short_history = _series_rule("MIXED_MODE_SERIES"), _series_rule("INSUFFICIENT_HISTORY")


def rates_without_driver(raw: RawTables, facts: DataFrame | None = None) -> DataFrame:
    rated = (raw.consumption.agg(F.count("rate").alias("n")) if facts is None else facts.agg(F.coalesce(F.sum("rated"), F.lit(0)).alias("n")))
    n = raw.driver.agg(F.count(F.lit(1)).alias("d")).crossJoin(F.broadcast(rated))  # one row each
    return warning(n.where("d = 0 AND n > 0"), "RATES_WITHOUT_DRIVER_TABLE", WARNING, "rates but no driver table; quantities are forecast", F.col("n"), ())


def not_in_bom(raw: RawTables, facts: DataFrame | None = None) -> DataFrame:
    used = (raw.consumption if facts is None else facts).select("item_code").where("item_code IS NOT NULL").distinct()
    known = raw.items.select("item_code").distinct().withColumn("known", F.lit(True))
    odd = F.col("known").isNull()
    both = used.join(known, "item_code", "left").agg(F.count(F.lit(1)).alias("all"), F.count_if(odd).alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set(F.when(odd, F.col("item_code")))), 1, 8), ", ").alias("some"))
    text = F.format_string("%d of %d items are not listed: %s", "n", "all", "some")
    return warning(both.where("n > 0"), "ITEM_NOT_IN_BOM", WARNING, text, F.col("n"), ())


def weighted_median(counted: DataFrame, keys: tuple[str, ...], value: str, count: str = "n") -> DataFrame:
    """``keys, median, total`` of values that stand ``count`` times each: the two middle ones by running counts, their mean where they differ.

    Exact, and mergeable: equal values are one row, counted in each task before
    anything is shuffled. What is left of a group is sorted and run through once,
    spilled to disk where it is large.
    """
    by = Window.partitionBy(*keys)
    run = counted.withColumns({"_run": F.sum(count).over(by.orderBy(value)), "_total": F.sum(count).over(by)})
    at = lambda place: F.min(F.when(F.col("_run") >= place, F.col(value)))
    lower, upper = at(F.floor((F.col("_total") + 1) / 2)), at(F.floor(F.col("_total") / 2) + 1)
    return run.groupBy(*keys).agg((lower * 0.5 + upper * 0.5).alias("median"), F.max("_total").alias("total"))


def extreme_outliers(raw: RawTables) -> DataFrame:
    """Quantities far from their series' median, in terms of the median deviation; both from counted values (VAL13)."""
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in KEYS]
    counted = raw.consumption.where("qty_base > 0").groupBy(*KEYS, "qty_base").agg(F.count(F.lit(1)).alias("n"))
    middle = weighted_median(counted, KEYS, "qty_base").where("total >= 8")
    away = counted.alias("c").join(middle.alias("m"), same("c", "m")).select("c.*", F.abs(F.col("qty_base") - F.col("median")).alias("dev")).groupBy(*KEYS, "dev").agg(F.sum("n").alias("n"))
    spread = weighted_median(away, KEYS, "dev").where("median > 0")
    far = away.alias("c").join(spread.alias("m"), same("c", "m")).where("0.6745 * dev > 5 * median").groupBy(*[F.col(f"c.{k}").alias(k) for k in KEYS]).agg(F.sum("n").alias("count"))
    return warning(far, "EXTREME_OUTLIER", INFO, "quantities far from the usual", F.col("count"))


def driver_rules(raw: RawTables, codes: tuple[str, ...] = ("NONPOSITIVE_DRIVER", "INVALID_DRIVER_TYPE")) -> DataFrame:
    """Warnings of a line and output, from one pass over the driver table."""
    per = raw.driver.groupBy("line", "output_type").agg(F.count_if(F.col("driver_qty").isNull() | (F.col("driver_qty") <= 0)).alias("low"), F.count_if(~F.coalesce(F.col("driver_type").isin("actual", "plan"), F.lit(False))).alias("odd"))
    rules = (("NONPOSITIVE_DRIVER", "driver values that are not above zero", "low"), ("INVALID_DRIVER_TYPE", "driver rows that are neither actual nor plan", "odd"))
    return _counted(per, ("line", "output_type"), rules, codes)


def item_rules(raw: RawTables, codes: tuple[str, ...] = ("INVALID_DECLARED_MODE", "DUPLICATE_BOM_ITEM")) -> DataFrame:
    """Warnings of an item, from one pass over the list of items."""
    odd = F.col("declared_mode").isNotNull() & ~F.lower("declared_mode").isin("relative", "absolute")
    per = raw.items.groupBy("item_code").agg(F.count_if(odd).alias("odd"), F.when(F.count(F.lit(1)) > 1, F.count(F.lit(1))).otherwise(0).alias("times"))
    return _counted(per, ("item_code",), (("INVALID_DECLARED_MODE", "a declared mode that is not known", "odd"), ("DUPLICATE_BOM_ITEM", "items listed more than once", "times")), codes)


def _counted(per: DataFrame, keys: tuple[str, ...], rules: tuple[tuple[str, str, str], ...], codes: tuple[str, ...]) -> DataFrame:
    found = [F.when(F.col(count) > 0, F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"), F.col(count).alias("count"))) for code, message, count in rules if code in codes]
    one = per.select(*keys, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("w")).select(*keys, "w.*")
    return warning(one, F.col("code"), WARNING, F.col("message"), F.col("count"), keys)


def nonpositive_driver(raw: RawTables) -> DataFrame:
    return driver_rules(raw, ("NONPOSITIVE_DRIVER",))


def driver_type(raw: RawTables) -> DataFrame:
    return driver_rules(raw, ("INVALID_DRIVER_TYPE",))


def declared_mode(raw: RawTables) -> DataFrame:
    return item_rules(raw, ("INVALID_DECLARED_MODE",))


def duplicate_items(raw: RawTables) -> DataFrame:
    return item_rules(raw, ("DUPLICATE_BOM_ITEM",))


def preparation(obs: DataFrame) -> DataFrame:
    """What building the series found (VAL17-VAL19)."""
    n = obs.groupBy(*KEYS).agg(F.sum("is_derived").alias("d"), F.sum(1 - F.col("is_applicable")).alias("a"), F.sum("is_low_driver").alias("l"))
    rows = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), F.lit(m).alias("message"), F.col(k).alias("n")) for c, s, m, k in (
        ("RATE_DERIVED", INFO, "periods with a derived rate", "d"), ("NO_OUTPUT_PERIOD", INFO, "periods in which the line did not run", "a"), ("LOW_DRIVER_PERIODS", WARNING, "periods with too little driver", "l"))])
    one = n.select(*KEYS, F.explode(rows).alias("x")).where("x.n > 0").select(*KEYS, "x.*")
    return warning(one, F.col("code"), F.col("severity"), F.col("message"), F.col("n"))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == FATAL, 0).when(severity == WARNING, 1).otherwise(2)


def run_all(raw: RawTables, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """All rules, the gravest first (VAL22, ORD1): consumption is scanned twice, once for the facts of series, which are written, and once for counted quantities; driver and items once each for their own rules."""
    facts = staged(series_facts(raw), "series-facts")
    parts = (coercion(raw), series_warnings(facts, raw.driver, None, cfg), rates_without_driver(raw, facts), not_in_bom(raw, facts), extreme_outliers(raw), driver_rules(raw), item_rules(raw))
    return reduce(DataFrame.unionByName, parts).orderBy(severity_rank(F.col("severity")), "code", F.col("item_code").asc_nulls_first())


def has_fatal(warnings: DataFrame) -> bool:
    return not warnings.where(F.col("severity") == FATAL).isEmpty()
