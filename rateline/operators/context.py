"""Operating conditions: which lines ran together, and whether that moves a series (CTX1-CTX9, CTX12, CTX13, CTX15, AGG12-15, AGG20, JN12-14, MOD21, MOD22, WIN8, WIN9)."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.calendar import parsed_period, period_label
from ..functions.tails import chi2_tail

IDLE, OTHER = "idle", "other"
KEY = ("unit", "stream")


def conditions(driver: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """One row a period, unit and stream (CTX1-CTX4): activity, what else ran, shares, utilisation and the period's regime. Actual rows win over planned ones."""
    rows = driver.where(F.col("driver_type").isin("actual", "plan")).select("period_start", F.col("line").alias("unit"), F.col("output_type").alias("stream"), "driver_type", "driver_qty")
    one = Window.partitionBy("period_start", *KEY).orderBy("driver_type")
    rows = rows.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    combo, period = Window.partitionBy(*KEY), Window.partitionBy("period_start")
    q = F.col("driver_qty")
    rows = rows.withColumn("median", F.median(q).over(combo)).withColumn("p95", F.percentile(F.when(F.col("driver_type") == "actual", q), F.lit(0.95)).over(combo))
    active = q.isNotNull() & (q > 0) & (q >= cfg.driver.floor_fraction * F.col("median"))
    rows = rows.withColumn("is_active", F.coalesce(active, F.lit(False)))
    own = F.struct(F.coalesce("unit", F.lit("")).alias("unit"), F.coalesce("stream", F.lit("")).alias("stream"))
    rows = rows.withColumn("active_set", F.sort_array(F.collect_set(F.when(F.col("is_active"), own)).over(period))).withColumn("system_driver", F.coalesce(F.sum(F.when(F.col("is_active"), q)).over(period), F.lit(0.0)))
    rows = rows.withColumn("n_active", F.size("active_set")).withColumn("co_active_with", F.array_except("active_set", F.array(own))).withColumn("is_solo", ((F.col("n_active") == 1) & F.col("is_active")).cast("int"))
    total = F.col("system_driver")
    share = F.when(total > 0, q / F.when(total > 0, total))
    rows = rows.withColumn("own_share", share).withColumn("utilization", F.when(F.col("p95") > 0, q / F.when(F.col("p95") > 0, F.col("p95"))))
    part = F.when(F.col("is_active") & (share > 0), -share * F.ln(share))
    rows = rows.withColumn("mix_entropy", F.when(F.col("n_active") > 1, F.sum(part).over(period)).otherwise(0.0))
    label = F.array_join(F.transform("active_set", lambda x: F.concat(x["unit"], F.lit(":"), x["stream"])), "+")
    return rows.withColumn("regime_label", F.when(F.col("n_active") == 0, IDLE).otherwise(label)).withColumn("period", period_label(F.col("period_start"), cfg.granularity))


def calendar_factors(calendar: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """``period_start, unit, stream, name, value``: numbers as they are, texts as flags ``name_value`` = 1 (CTX5, CTX6); of repeated rows the largest value holds."""
    number = F.expr("try_cast(factor_value AS double)")
    text = number.isNull()
    name = F.concat(F.lit("ctx_"), F.lower("factor_name"), F.when(text, F.concat(F.lit("_"), F.lower("factor_value"))).otherwise(""))
    rows = calendar.where("factor_value IS NOT NULL").select(parsed_period(F.col("period"), cfg.granularity).alias("period_start"), "unit", "stream", F.regexp_replace(name, "[^a-z0-9_]", "_").alias("name"), F.when(text, 1.0).otherwise(number).alias("value"))
    return rows.where("period_start IS NOT NULL").groupBy("period_start", "unit", "stream", "name").agg(F.max("value").alias("value"))


def with_calendar(rows: DataFrame, factors: DataFrame) -> tuple[DataFrame, list[str]]:
    """Conditions with a column for each factor, 0 where it has no row (JN13, CTX6).

    A factor's row holds for all units or streams where it names none. Where
    several rows of one factor fit, the one that names the unit holds before
    one that names the stream, and that before one that names neither. The
    factors are pivoted once, by how much their rows name, so there are four
    joins however many factors there are.
    """
    names = sorted(r[0] for r in factors.select("name").distinct().collect())  # a factor a column
    if not names:
        return rows, names
    own = [c for c in rows.columns if c not in names]
    kinds = (("period_start", "unit", "stream"), ("period_start", "unit"), ("period_start", "stream"), ("period_start",))
    for i, on in enumerate(kinds):
        fits = factors.where(F.col("unit").isNotNull() == F.lit("unit" in on)).where(F.col("stream").isNotNull() == F.lit("stream" in on))
        wide = fits.groupBy(*on).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(f"_{i}_{j}") for j, n in enumerate(names)])
        rows = rows.join(wide, list(on), "left")
    found = [F.coalesce(*[F.col(f"_{i}_{j}") for i in range(len(kinds))], F.lit(0.0)).alias(n) for j, n in enumerate(names)]
    return rows.select(*own, *found), names


def extended_labels(rows: DataFrame, names: list[str]) -> DataFrame:
    """CTX7: factors of 2 to 4 values become part of the regime; all are counted at once."""
    if not names:
        return rows
    k = rows.agg(*[F.countDistinct(n).alias(n) for n in names]).first()
    used = [n for n in names if 2 <= k[n] <= 4]
    whole = lambda n: F.when(F.col(n) == F.floor(n), F.col(n).cast("long").cast("string")).otherwise(F.col(n).cast("string"))
    return rows.withColumn("regime_label", F.concat("regime_label", *[x for n in used for x in (F.lit(f" | {n.removeprefix('ctx_')}="), whole(n))])) if used else rows


def has_variance(rows: DataFrame, names: list[str]) -> bool:
    """CTX8: whether any condition ever changed in what happened, from one aggregate."""
    got = rows.where("driver_type = 'actual'").agg(F.countDistinct("regime_label").alias("k"), *[F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(f"s_{c}") for c in ("own_share", "utilization", "mix_entropy", *names)]).first()
    return got["k"] > 1 or any(v > 1e-9 for k, v in got.asDict().items() if k.startswith("s_"))


def series_conditions(fit: DataFrame, rows: DataFrame) -> DataFrame:
    """Each period of a series with its own combination's conditions, or the period's where that has no row (JN14, CTX10)."""
    own = rows.select("period_start", F.col("unit").alias("line"), F.col("stream").alias("output_type"), F.col("regime_label").alias("_own"), "own_share", "utilization")
    first = rows.groupBy("period_start").agg(F.min_by(F.struct("regime_label", "system_driver", "mix_entropy"), F.struct("unit", "stream")).alias("_p"))
    out = fit.join(own, ["period_start", "line", "output_type"], "left").join(first, "period_start", "left")
    return out.withColumn("regime_label", F.coalesce("_own", "_p.regime_label")).withColumn("system_driver", F.col("_p.system_driver")).withColumn("mix_entropy", F.col("_p.mix_entropy")).withColumn("own_share", F.coalesce("own_share", F.lit(0.0))).withColumn("utilization", F.coalesce("utilization", F.lit(0.0))).drop("_own", "_p")


def pooled(rows: DataFrame, least: int = 4) -> DataFrame:
    """CTX9: regimes of fewer than ``least`` usable periods of a series are one, ``other``."""
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id", "regime_label"))
    return rows.withColumn("regime", F.when(n < least, OTHER).otherwise(F.col("regime_label")))


def significance(rows: DataFrame, cfg: EngineConfig = EngineConfig(), least: int = 2) -> DataFrame:
    """CTX12: ``series_id, n, k, statistic, spread_pct, effect_size`` of the Kruskal-Wallis test over regimes; ties share their mean rank."""
    s = Window.partitionBy("series_id")
    use = rows.where("valid = 1 AND y IS NOT NULL AND regime_label IS NOT NULL")
    use = pooled(use, cfg.context.min_regime_obs).withColumn("g", F.count(F.lit(1)).over(Window.partitionBy("series_id", "regime"))).where(F.col("g") >= least)
    use = use.withColumn("_y", F.round("y", 9))  # sums in another order must not break ties
    same = Window.partitionBy("series_id", "_y")
    ranked = use.withColumn("r", F.rank().over(s.orderBy("_y")) + (F.count(F.lit(1)).over(same) - 1) / 2).withColumn("t", F.count(F.lit(1)).over(same))
    by = ranked.groupBy("series_id", "regime").agg(F.count(F.lit(1)).alias("m"), F.sum("r").alias("rs"), F.sum("y").alias("sy"), F.sum(F.col("t") * F.col("t") - 1).alias("ties"))
    n = F.sum("m").cast("double")
    h = 12 / (n * (n + 1)) * F.sum(F.col("rs") * F.col("rs") / F.col("m")) - 3 * (n + 1)
    fix = 1 - F.sum("ties") / (n * n * n - n)
    mean = F.sum("sy") / n
    each = F.col("sy") / F.col("m")
    out = by.groupBy("series_id").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"), F.when((n > 1) & (fix > 1e-12), h / F.when((n > 1) & (fix > 1e-12), fix)).alias("statistic"), F.when(mean != 0, (F.max(each) - F.min(each)) / F.abs(F.when(mean != 0, mean))).alias("spread_pct"), F.max_by("regime", each).alias("high_label"), F.min_by("regime", each).alias("low_label"))
    eta = (F.col("statistic") - F.col("k") + 1) / F.nullif(F.col("n") - F.col("k"), F.lit(0))
    return out.where("k >= 2 AND n >= 4").withColumn("effect_size", F.least(F.lit(1.0), F.greatest(F.lit(0.0), eta)))


def diagnosed(tested: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """CTX13: ``p_value`` of the statistic, and whether the effect is both significant and large."""
    c = cfg.context
    return tested.withColumn("p_value", chi2_tail(F.col("statistic"), F.col("k") - 1)).withColumn("material", F.coalesce((F.col("p_value") < c.alpha) & (F.col("spread_pct") >= c.materiality), F.lit(False)).cast("int"))


def non_negative(aa: Column, ab: Column, bb: Column, ay: Column, by: Column) -> Column:
    """struct(x, y) that minimises |a x + b y - t|² over x, y >= 0, from the five sums: the free solution if it is not negative, else the better of the two single ones."""
    det = aa * bb - ab * ab
    ok = F.abs(det) > 1e-12 * aa * bb
    d = F.when(ok, det)
    x, y = (bb * ay - ab * by) / d, (aa * by - ab * ay) / d
    only_x, only_y = F.greatest(F.lit(0.0), F.try_divide(ay, aa)), F.greatest(F.lit(0.0), F.try_divide(by, bb))
    gain_x, gain_y = only_x * ay, only_y * by

    def pair(p: Column, q: Column) -> Column:
        return F.struct(p.alias("x"), q.alias("y"))

    return F.when((x >= 0) & (y >= 0), pair(x, y)).when(gain_x >= gain_y, pair(only_x, F.lit(0.0))).otherwise(pair(F.lit(0.0), only_y))


def driver_variation(fit: DataFrame) -> DataFrame:
    """AGG20: how much the driver varies over usable periods, of 4 or more."""
    d = F.when(F.col("valid") == 1, F.col("driver_qty"))
    mean = F.avg(d)
    return fit.groupBy("series_id").agg(F.when((F.count(d) >= 4) & (mean > 0), F.stddev_pop(d) / F.when(mean > 0, mean)).alias("driver_cv"))


def humanised(label: Column) -> Column:
    """CTX15: a regime in words."""
    ran = F.array_join(F.transform(F.split(F.substring_index(label, " | ", 1), r"\+"), lambda p: F.concat(F.substring_index(p, ":", 1), F.lit(" making "), F.substring_index(p, ":", -1))), " and ")
    said = F.when(F.substring_index(label, " | ", 1) == IDLE, "nothing running").otherwise(ran)
    factors = F.slice(F.split(label, r" \| "), 2, 100)
    also = F.array_join(F.transform(factors, lambda f: F.concat(F.replace(F.substring_index(f, "=", 1), F.lit("_"), F.lit(" ")), F.when(F.substring_index(f, "=", -1) == "1", " on").when(F.substring_index(f, "=", -1) == "0", " off").otherwise(F.concat(F.lit(" "), F.substring_index(f, "=", -1))))), ", ")
    return F.when(label == OTHER, "other conditions").when(F.size(factors) > 0, F.concat(said, F.lit(" with "), also)).otherwise(said)


def verdict(skip: Column, p: Column, spread: Column, high: Column, low: Column, material: Column, cfg: EngineConfig = EngineConfig()) -> Column:
    """CTX15: what was found about a series, in a sentence."""
    by = F.concat(F.format_string("%.0f %%", 100 * spread), F.lit(" between "), humanised(low), F.lit(" and "), humanised(high))
    found = F.when(material == 1, F.concat(F.lit("Consumption depends on what runs: it differs by "), by, F.lit(".")))
    found = found.when((p < cfg.context.alpha) & (spread >= cfg.context.materiality), F.concat(F.lit("Consumption depends on what runs, by "), by, F.lit(", but no plan covers the horizon.")))
    found = found.when(p < cfg.context.alpha, F.concat(F.lit("Conditions matter, but little: "), by, F.lit("."))).when(p.isNotNull(), "Conditions make no difference that could not be chance.")
    return F.when(skip.isNotNull(), F.concat(F.lit("Not tested: "), skip, F.lit("."))).otherwise(found)
