"""Rules from one pass, and exact medians of counted values, against plain loops."""

from __future__ import annotations

import random
import statistics
from collections import Counter

from pyspark.sql import functions as F

from rateline.operators import validate as V
from rateline.sources import star_schema

SF = "/root/testdata/sf0.001"


def test_weighted_median_is_the_median(spark):
    rng = random.Random(2)
    rows = [(k, float(rng.choice([1, 2, 2, 3, 5, 8, 13, -4])), rng.randint(1, 5)) for k in ("a", "b", "c", None) for _ in range(rng.randint(1, 9))]
    rows += [("one", 7.0, 1), ("two", 1.0, 1), ("two", 4.0, 1), ("heavy", 3.0, 50_000_000), ("heavy", 9.0, 49_999_999), ("even", 3.0, 10**12), ("even", 9.0, 10**12)]
    counted = spark.createDataFrame(rows, "k string, v double, n long").groupBy("k", "v").agg(F.sum("n").alias("n"))
    got = {r["k"]: (r["median"], r["total"]) for r in V.weighted_median(counted, ("k",), "v").collect()}
    values: dict = {}
    for k, v, n in rows:
        if n < 1000:
            values.setdefault(k, []).extend([v] * n)
    assert got == {k: (statistics.median(v), len(v)) for k, v in values.items()} | {"heavy": (3.0, 99_999_999), "even": (6.0, 2 * 10**12)}


def test_outliers_equal_a_loop(spark):
    """A series of many rows of few quantities, one whose deviations are all nothing, and one with too few rows."""
    rng = random.Random(4)
    many = [("m", "1", "x", float(rng.choice([10, 11, 12, 13] * 50 + [500, 900]))) for _ in range(20_000)]
    rows = many + [("flat", "1", "x", 5.0)] * 30 + [("flat", "1", "x", 900.0)] + [("few", "1", "x", float(v)) for v in (1, 2, 3, 4, 5, 6, 900)] + [(None, None, "x", float(v)) for v in (1, 2, 3, 4, 5, 6, 7, 8, 900, -3)]
    raw = star_schema.load(spark, SF)
    raw.consumption = spark.createDataFrame(rows, "item_code string, line string, output_type string, qty_base double")
    got = {r["item_code"]: r["count"] for r in V.extreme_outliers(raw).collect()}
    want = {}
    for key in {r[:3] for r in rows}:
        v = [r[3] for r in rows if r[:3] == key and r[3] > 0]
        med = statistics.median(v)
        mad = statistics.median(abs(x - med) for x in v)
        n = sum(0.6745 * abs(x - med) > 5 * mad for x in v)
        if len(v) >= 8 and mad > 0 and n:
            want[key[0]] = n
    assert got == want and "m" in got and None in got and "flat" not in got
    plan = V.extreme_outliers(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in plan.replace("AS median", "") and plan.count("Aggregate") >= 4


def test_all_rules_scan_consumption_twice(spark, tmp_path):
    """Read by read: the facts of series, and counted quantities; single rules and the whole give the same."""
    raw = star_schema.load(spark, SF)
    raw.consumption.write.parquet(f"{tmp_path}/consumption")
    raw.consumption = spark.read.parquet(f"{tmp_path}/consumption")
    found = V.run_all(raw)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("qty_base#") > 0
    reads = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if f"{tmp_path}/consumption" in line and "Scan" in line]
    assert len(reads) <= 3  # counted quantities, of which one branch may be planned anew; the facts are a table by then
    whole = Counter(tuple(r) for r in found.collect())
    single = Counter()
    for rule in (V.coercion, V.duplicates, V.negatives, V.missing_quantity, V.orphans, V.derivable, V.rates_without_driver, V.missing_driver, V.nonpositive_driver, V.not_in_bom, V.mixed_mode, V.short_history, V.extreme_outliers, V.driver_type, V.declared_mode, V.duplicate_items):
        single += Counter(tuple(r) for r in rule(raw).collect())
    assert whole == single and sum(whole.values()) > 50


def test_rules_of_empty_tables(spark):
    raw = star_schema.load(spark, SF)
    raw.driver = raw.driver.limit(0)
    codes = {r["code"] for r in V.run_all(raw).select("code").distinct().collect()}
    assert "RATES_WITHOUT_DRIVER_TABLE" in codes and not codes & {"ORPHAN_SERIES", "MISSING_DRIVER_PERIODS", "RATE_DERIVABLE"}
    raw.consumption = raw.consumption.limit(0)
    assert V.run_all(raw).where("code NOT IN ('DUPLICATE_BOM_ITEM', 'INVALID_DECLARED_MODE')").count() == 0
