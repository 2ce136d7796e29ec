"""Queries of the data-quality rules."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig, Rate
from ..operators import prepare as P
from ..operators import validate as V
from ..sources import star_schema
from ..sources.mapping import coercion_failures
from .oracle_base import with_steps
from .prepared import prepared, r6


def _spoilt(spark: SparkSession, sf_dir: str):
    """The tables with faults planted by rule, so that every check has something to find: short histories (all but five days of one brand), outliers, and all else."""
    raw = star_schema.load(spark, sf_dir)
    c, d = raw.consumption, raw.driver
    qty = F.when(F.col("cost") % 97 < 1, F.lit(None)).when(F.col("cost") % 89 < 1, -F.col("qty_base")).when(F.col("cost") % 79 < 1, 100 * F.col("qty_base")).otherwise(F.col("qty_base"))
    short = (F.col("item_code") == "Brand#9") & ~F.date_format("date", "yyyy-MM-dd").between("1997-03-01", "1997-03-05")
    raw.consumption = c.where(~short).select(
        "date", F.when((F.col("item_code") == "Brand#7") & (F.col("line") == "2"), F.lit("Ghost#7")).otherwise(F.col("item_code")).alias("item_code"),
        qty.alias("qty_base"), "qty_ton", "cost", "output_type",
        F.when((F.col("item_code") == "Brand#11") & (F.col("output_type") == "P"), F.lit("9")).otherwise(F.col("line")).alias("line"), F.when(F.col("cost") % 83 >= 1, F.col("rate")).alias("rate"), "rate_uom",
    )
    raw.driver = d.select("date", F.when(F.col("driver_qty") % 71 < 1, F.lit(0.0)).otherwise(F.col("driver_qty")).alias("driver_qty"), "driver_uom", "output_type", "line", F.when(F.col("driver_qty") % 61 < 1, "budget").otherwise(F.col("driver_type")).alias("driver_type"))
    raw.items = raw.items.unionByName(raw.items.where("item_code = 'Brand#3'")).withColumn("declared_mode", F.when(F.col("item_code") == "Brand#4", "sometimes"))
    return raw


def _rule(rule, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule(_spoilt(spark, sf_dir)).drop("message")


def val_rates_without_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL7: where there is no driver table; and that it is silent where there is one."""
    raw = _spoilt(spark, sf_dir)
    with_driver = V.rates_without_driver(raw).withColumn("driver", F.lit("there"))
    raw.driver = raw.driver.limit(0)
    return with_driver.unionByName(V.rates_without_driver(raw).withColumn("driver", F.lit("none"))).drop("message")


def val_not_in_bom_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL10 with its text: how many of how many, and the first eight."""
    raw = _spoilt(spark, sf_dir)
    raw.items = raw.items.where("item_code NOT LIKE 'Brand#2%'")
    return V.not_in_bom(raw).select("code", "message", "count")


def val_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL1, SRC5: raw columns with values that cannot be read."""
    raw = star_schema.load(spark, sf_dir).consumption
    day = F.date_format("date", "yyyy-MM-dd")
    text = lambda c, bad: F.when(F.col("cost") % bad < 1, F.concat(F.lit("n/a "), F.col(c).cast("string"))).otherwise(F.col(c).cast("string"))
    sheet = raw.select(F.when(F.col("cost") % 53 < 1, F.concat(F.lit("on "), day)).otherwise(day).alias("date"), "item_code", text("qty_base", 43).alias("cons_qty_base_uom"), F.col("qty_ton").cast("string").alias("cons_qty_ton"), text("cost", 47).alias("cons_$"), "output_type", F.col("line").alias("production_line"), F.lit(" ").alias("cons_rate"), F.lit(None).cast("string").alias("cons_rate_uom"))
    tables = star_schema.load(spark, sf_dir)
    tables.failures = coercion_failures(sheet, "consumption")
    return V.coercion(tables).drop("message").withColumn("column_name", F.lit("")).drop("column_name")


def val_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL17-VAL19, TS5, PRJ2: with rates derived where they are missing."""
    cfg = EngineConfig(rate=Rate(derive_missing=True))
    return V.preparation(P.build_series(star_schema.load(spark, sf_dir), cfg).observations).drop("message")


def derived_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TS5, TS6: the derived rates themselves."""
    cfg = EngineConfig(rate=Rate(derive_missing=True))
    o = P.build_series(star_schema.load(spark, sf_dir), cfg).observations
    return o.where("is_derived = 1 OR mode_source = 'derived'").select("series_id", "period", "mode_source", *r6("rate", "target"), "is_derived", "is_reliable", "is_applicable")


def val_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.preparation(prepared(spark, sf_dir).observations).drop("message")


def warning_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG18, PRJ11: warnings by severity and code."""
    return V.run_all(_spoilt(spark, sf_dir)).groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("rows"))


RULES = {"val_duplicates": V.duplicates, "val_negative": V.negatives, "val_missing_quantity": V.missing_quantity, "val_orphan_anti": V.orphans, "val_derivable_semi": V.derivable, "val_missing_driver_anti": V.missing_driver, "val_nonpositive_driver": V.nonpositive_driver, "val_not_in_bom_anti": V.not_in_bom, "val_mixed_mode": V.mixed_mode, "val_short_history": V.short_history, "val_outlier_mad": V.extreme_outliers, "val_driver_type": V.driver_type, "val_declared_mode": V.declared_mode, "val_duplicate_item": V.duplicate_items}
QUERIES = {**{k: partial(_rule, v) for k, v in RULES.items()}, **{f.__name__: f for f in (val_preparation, val_rates_without_driver, val_not_in_bom_text, val_coercion, val_derived, derived_rates, warning_counts)}}

STEPS = {
    "c": "SELECT date, CASE WHEN item_code = 'Brand#7' AND line = '2' THEN 'Ghost#7' ELSE item_code END AS item_code, CASE WHEN cost % 97 < 1 THEN NULL WHEN cost % 89 < 1 THEN -qty_base WHEN cost % 79 < 1 THEN 100 * qty_base ELSE qty_base END AS qty_base, qty_ton, cost, output_type, CASE WHEN item_code = 'Brand#11' AND output_type = 'P' THEN '9' ELSE line END AS line, CASE WHEN cost % 83 >= 1 THEN rate END AS rate FROM consumption WHERE NOT (item_code = 'Brand#9' AND NOT (date >= TIMESTAMP '1997-03-01' AND date < TIMESTAMP '1997-03-06'))",
    "d": "SELECT date, CASE WHEN driver_qty % 71 < 1 THEN 0.0 ELSE driver_qty END AS driver_qty, output_type, line, CASE WHEN driver_qty % 61 < 1 THEN 'budget' ELSE driver_type END AS driver_type FROM driver_raw",
    "it": "SELECT item_code, CASE WHEN item_code = 'Brand#4' THEN 'sometimes' END AS declared_mode FROM (SELECT * FROM items UNION ALL SELECT * FROM items WHERE item_code = 'Brand#3')",
    "combo": "SELECT DISTINCT line, output_type FROM d",
    "om": "SELECT *, count(*) OVER p AS k, median(qty_base) OVER p AS med FROM c WHERE qty_base > 0 WINDOW p AS (PARTITION BY item_code, line, output_type)",
    "od": "SELECT *, abs(qty_base - med) AS dev, median(abs(qty_base - med)) OVER (PARTITION BY item_code, line, output_type) AS mad FROM om",
}
K = "item_code, line, output_type"
NO = "CAST(NULL AS VARCHAR)"
_SQL = {
    "val_duplicates": ("DUPLICATE_PERIOD_ROWS", "info", K, f"(SELECT {K}, count(*) AS n FROM (SELECT {K}, date FROM c GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL)"),
    "val_negative": ("NEGATIVE_VALUE", "warning", K, f"(SELECT {K}, count(*) AS n FROM (SELECT {K}, unnest([1, 2, 3, 4]) AS m, unnest([qty_base, qty_ton, cost, rate]) AS v FROM c) WHERE v < 0 GROUP BY {K}, m)"),
    "val_missing_quantity": ("MISSING_QUANTITY", "warning", K, f"(SELECT {K}, count(*) AS n FROM c WHERE qty_base IS NULL GROUP BY ALL)"),
    "val_orphan_anti": ("ORPHAN_SERIES", "warning", K, f"(SELECT {K}, count(*) AS n FROM c WHERE rate IS NOT NULL AND NOT EXISTS (SELECT 1 FROM combo x WHERE x.line = c.line AND x.output_type = c.output_type) GROUP BY ALL)"),
    "val_derivable_semi": ("RATE_DERIVABLE", "info", K, f"(SELECT {K}, count(*) AS n FROM c WHERE EXISTS (SELECT 1 FROM combo x WHERE x.line = c.line AND x.output_type = c.output_type) GROUP BY ALL HAVING count(rate) = 0)"),
    "val_missing_driver_anti": ("MISSING_DRIVER_PERIODS", "warning", K, f"(SELECT {K}, count(DISTINCT date) AS n FROM c WHERE rate IS NOT NULL AND EXISTS (SELECT 1 FROM combo x WHERE x.line = c.line AND x.output_type = c.output_type) AND NOT EXISTS (SELECT 1 FROM d WHERE d.driver_type = 'actual' AND d.date = c.date AND d.line = c.line AND d.output_type = c.output_type) GROUP BY ALL)"),
    "val_nonpositive_driver": ("NONPOSITIVE_DRIVER", "warning", f"{NO} AS item_code, line, output_type", "(SELECT line, output_type, count(*) AS n FROM d WHERE driver_qty IS NULL OR driver_qty <= 0 GROUP BY ALL)"),
    "val_not_in_bom_anti": ("ITEM_NOT_IN_BOM", "warning", f"{NO} AS item_code, {NO} AS line, {NO} AS output_type", "(SELECT count(DISTINCT item_code) AS n FROM c WHERE item_code NOT IN (SELECT item_code FROM it) HAVING count(*) > 0)"),
    "val_mixed_mode": ("MIXED_MODE_SERIES", "warning", K, f"(SELECT {K}, count(*) - count(rate) AS n FROM c GROUP BY ALL HAVING count(rate) > 0 AND count(rate) < count(*))"),
    "val_short_history": ("INSUFFICIENT_HISTORY", "info", K, f"(SELECT {K}, count(DISTINCT date) AS n FROM c GROUP BY ALL HAVING count(DISTINCT date) < 6)"),
    "val_outlier_mad": ("EXTREME_OUTLIER", "info", K, f"(SELECT {K}, count(*) AS n FROM od WHERE k >= 8 AND mad > 0 AND 0.6745 * dev > 5 * mad GROUP BY ALL)"),
    "val_driver_type": ("INVALID_DRIVER_TYPE", "warning", f"{NO} AS item_code, line, output_type", "(SELECT line, output_type, count(*) AS n FROM d WHERE driver_type NOT IN ('actual', 'plan') GROUP BY ALL)"),
    "val_declared_mode": ("INVALID_DECLARED_MODE", "warning", f"item_code, {NO} AS line, {NO} AS output_type", "(SELECT item_code, count(*) AS n FROM it WHERE declared_mode IS NOT NULL AND lower(declared_mode) NOT IN ('relative', 'absolute') GROUP BY ALL)"),
    "val_duplicate_item": ("DUPLICATE_BOM_ITEM", "warning", f"item_code, {NO} AS line, {NO} AS output_type", "(SELECT item_code, count(*) AS n FROM it GROUP BY ALL HAVING count(*) > 1)"),
    "rates_without_driver": ("RATES_WITHOUT_DRIVER_TABLE", "warning", f"{NO} AS item_code, {NO} AS line, {NO} AS output_type", "(SELECT count(rate) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM d) HAVING count(rate) > 0)"),
}
_ONE = {k: f"SELECT '{code}' AS code, '{sev}' AS severity, {cols}, CAST(n AS BIGINT) AS count FROM {src}" for k, (code, sev, cols, src) in _SQL.items()}
_ITEMS = {"items": "SELECT p_brand AS item_code FROM part GROUP BY p_brand"}
_DERIVED = {
    "seen": "SELECT DISTINCT line, output_type FROM driver",
    "dj": """SELECT g.*, CASE WHEN c.line IS NULL THEN 'absolute' ELSE 'relative' END AS mode, CASE WHEN g.has_rate AND c.line IS NULL THEN 'no_driver' WHEN g.has_rate THEN 'inferred' WHEN c.line IS NOT NULL THEN 'derived' ELSE 'inferred' END AS mode_source, CASE WHEN c.line IS NOT NULL THEN a.driver_qty END AS driver_qty
  FROM gaps g LEFT JOIN seen c ON g.line = c.line AND g.output_type = c.output_type LEFT JOIN driver a ON a.driver_type = 'actual' AND a.period_start = g.period_start AND a.line = g.line AND a.output_type = g.output_type""",
    "dr": "SELECT *, CASE WHEN mode = 'relative' AND NOT has_rate THEN CASE WHEN driver_qty > 0 THEN qty_base / driver_qty END WHEN mode = 'relative' THEN coalesce(rate, 0.0) ELSE rate END AS made, median(driver_qty) OVER (PARTITION BY item_code, line, output_type) AS med FROM dj",
    "dq": """SELECT item_code, line, output_type, item_code || '|' || line || '|' || output_type AS series_id, strftime(period_start, '%Y-%m') AS period, mode_source, made AS rate, CASE WHEN mode = 'relative' THEN made ELSE qty_base / day(last_day(period_start)) END AS target, CAST(mode = 'relative' AND NOT has_rate AND made IS NOT NULL AS INT) AS is_derived,
  CASE WHEN mode <> 'relative' THEN 1 ELSE CAST(driver_qty IS NOT NULL AND driver_qty > 0 AND driver_qty >= 0.2 * med AS INT) END AS is_reliable, CASE WHEN mode = 'relative' AND (driver_qty IS NULL OR driver_qty <= 0) AND coalesce(made, 0.0) = 0 THEN 0 ELSE 1 END AS is_applicable,
  CASE WHEN mode = 'relative' AND driver_qty IS NOT NULL AND NOT (driver_qty > 0 AND driver_qty >= 0.2 * med) THEN 1 ELSE 0 END AS is_low FROM dr""",
}
ORACLE = {
    **{k: with_steps("driver_raw", v, {**_ITEMS, **STEPS}) for k, v in _ONE.items() if k in RULES},
    "val_preparation": with_steps("obs", """SELECT 'NO_OUTPUT_PERIOD' AS code, 'info' AS severity, item_code, line, output_type, CAST(sum(1 - is_applicable) AS BIGINT) AS count FROM obs GROUP BY item_code, line, output_type HAVING sum(1 - is_applicable) > 0
UNION ALL SELECT 'LOW_DRIVER_PERIODS', 'warning', item_code, line, output_type, CAST(sum(is_low_driver) AS BIGINT) FROM obs GROUP BY item_code, line, output_type HAVING sum(is_low_driver) > 0"""),
    "val_rates_without_driver": with_steps("driver_raw", f"SELECT 'RATES_WITHOUT_DRIVER_TABLE' AS code, 'warning' AS severity, {NO} AS item_code, {NO} AS line, {NO} AS output_type, count(rate) AS count, 'none' AS driver FROM c", {**_ITEMS, **STEPS}),
    "val_not_in_bom_text": with_steps("driver_raw", """SELECT 'ITEM_NOT_IN_BOM' AS code, (SELECT count(*) FROM odd) || ' of ' || (SELECT count(DISTINCT item_code) FROM c) || ' items are not listed: ' || (SELECT string_agg(item_code, ', ' ORDER BY item_code) FROM (SELECT item_code FROM odd ORDER BY item_code LIMIT 8)) AS message, (SELECT count(*) FROM odd) AS count""", {**_ITEMS, **STEPS, "odd": "SELECT DISTINCT item_code FROM c WHERE item_code NOT IN (SELECT item_code FROM it WHERE item_code NOT LIKE 'Brand#2%')"}),
    "val_coercion": with_steps("consumption", f"SELECT * FROM (SELECT 'COERCION_FAILURE' AS code, unnest(['fatal', 'warning', 'warning']) AS severity, {NO} AS item_code, {NO} AS line, {NO} AS output_type, unnest([count(CASE WHEN cost % 53 < 1 THEN 1 END), count(CASE WHEN cost % 43 < 1 THEN 1 END), count(CASE WHEN cost % 47 < 1 THEN 1 END)]) AS count FROM consumption) WHERE count > 0"),
    "val_derived": with_steps("gaps", """SELECT code, severity, item_code, line, output_type, CAST(sum(n) AS BIGINT) AS count FROM (SELECT unnest(['RATE_DERIVED', 'NO_OUTPUT_PERIOD', 'LOW_DRIVER_PERIODS']) AS code, unnest(['info', 'info', 'warning']) AS severity, item_code, line, output_type, unnest([is_derived, 1 - is_applicable, is_low]) AS n FROM dq) GROUP BY ALL HAVING sum(n) > 0""", _DERIVED),
    "derived_rates": with_steps("gaps", """SELECT series_id, period, mode_source, round(rate, 6) AS rate, round(target, 6) AS target, is_derived, is_reliable, is_applicable FROM dq WHERE is_derived = 1 OR mode_source = 'derived'""", _DERIVED),
    "warning_counts": with_steps("driver_raw", "SELECT severity, code, count(*) AS n, CAST(sum(count) AS BIGINT) AS rows FROM (" + " UNION ALL ".join(_ONE.values()) + ") GROUP BY ALL", {**_ITEMS, **STEPS}),
}
