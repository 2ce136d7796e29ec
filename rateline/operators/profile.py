"""Behaviour of each series (AGG7-9, PAT1-PAT9, WIN5): native but for STL and the unit-root test.

Statistics are over applicable rows, or all rows of a series that has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..shipping import ship
from ..staging import dealt
from . import regression as R

ADI_CUT, CV2_CUT = 1.32, 0.49
#: How well each demand class can be forecast at best.
BASE = {"smooth": 0.9, "erratic": 0.55, "intermittent": 0.5, "lumpy": 0.3, "too_short": 0.2}
ROBUST = 0.6745


def S():
    return Window.partitionBy("series_id")


def BY():
    return S().orderBy("idx")


def applicable_rows(obs: DataFrame) -> DataFrame:
    none = F.max("is_applicable").over(S()) == 0
    rows = obs.withColumn("_none", none).where((F.col("is_applicable") == 1) | F.col("_none")).drop("_none")
    return rows.withColumn("n", F.row_number().over(BY()))


def demand_class(n: Column, adi: Column, cv2: Column, min_len: int = 6) -> Column:
    """PAT1: the quadrants of the interval between demands and their spread."""
    few = (n < min_len) | adi.isNull()
    rare, wild = adi >= ADI_CUT, cv2 >= CV2_CUT
    return F.when(few, "too_short").when(rare & wild, "lumpy").when(rare, "intermittent").when(wild, "erratic").otherwise("smooth")


def clipped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def descriptive(rows: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """One row a series: AGG7-9, PAT1, PAT8 without its inputs from elsewhere."""
    y, seen = F.col("target"), (F.col("is_gap_filled") == 0) & F.col("target").isNotNull()
    yo, pos = F.when(seen, y), F.when(y > 0, y)
    agg = rows.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(y).alias("n_y"), F.count(pos).alias("n_pos"),
        *[F.coalesce(f(yo), F.lit(0.0)).alias(n) for f, n in ((F.avg, "mean"), (F.median, "median"), (F.min, "min"), (F.max, "max"), (F.stddev_pop, "std"))],
        F.avg(pos).alias("pos_mean"), F.stddev_pop(pos).alias("pos_std"),
        F.avg("is_gap_filled").alias("missing_pct"), F.avg(1 - F.col("is_reliable")).alias("unreliable_pct"),
        F.count_if(seen & (F.col("is_reliable") == 1)).alias("n_rel"),
    )
    adi = F.col("n_y") / F.nullif(F.col("n_pos"), F.lit(0))
    cv2 = F.pow(F.col("pos_std") / F.col("pos_mean"), 2)
    out = agg.withColumn("adi", adi).withColumn("cv2", F.when(F.col("n_pos") > 0, cv2)).withColumn("cv", F.when(F.col("mean") > 0, F.col("std") / F.when(F.col("mean") > 0, F.col("mean"))))
    return out.withColumn("pattern_class", demand_class(F.col("n_y"), F.col("adi"), F.col("cv2"), cfg.gate.min_history_competition))


def correlation(x: Column, y: Column) -> Column:
    """Correlation of the pairs in a group, null where either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    varies = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    num = F.count(x) * F.sum(x * y) - F.sum(x) * F.sum(y)
    den = F.sqrt(F.greatest(F.lit(0.0), F.count(x) * F.sum(x * x) - F.sum(x) * F.sum(x))) * F.sqrt(F.greatest(F.lit(0.0), F.count(x) * F.sum(y * y) - F.sum(y) * F.sum(y)))
    return F.when(varies & (den > 0), num / F.when(den > 0, den))


def autocorrelation(rows: DataFrame) -> DataFrame:
    """PAT5: of each observed value and the one before."""
    seen = rows.where("is_gap_filled = 0 AND target IS NOT NULL").withColumn("before", F.lag("target").over(BY()))
    return seen.groupBy("series_id").agg(F.when(F.count(F.lit(1)) >= 3, correlation(F.col("before"), F.col("target"))).alias("autocorr_lag1"))


def trend(rows: DataFrame, season: int = 12) -> DataFrame:
    """PAT2: squared correlation of the values with their place, of 4 values up to two seasons; null beyond, where STL is used."""
    y = rows.where("target IS NOT NULL")
    n = F.count(F.lit(1))
    r = correlation(F.col("n").cast("double"), F.col("target"))
    return y.groupBy("series_id").agg(F.when((n >= 4) & (n < 2 * season + 1), F.coalesce(r * r, F.lit(0.0))).alias("trend_r2"))


def outlier_share(rows: DataFrame) -> DataFrame:
    """PAT6: share of positive values far from the median in terms of the median deviation."""
    pos = rows.where("target > 0").withColumn("med", F.median("target").over(S()))
    pos = pos.withColumn("dev", F.abs(F.col("target") - F.col("med"))).withColumn("mad", F.median("dev").over(S()))
    far = (F.col("mad") > 0) & (ROBUST * F.col("dev") > 3.5 * F.col("mad"))
    return pos.groupBy("series_id").agg(F.when(F.count(F.lit(1)) >= 4, F.avg(far.cast("double"))).otherwise(0.0).alias("outlier_pct"))


def structural_break(rows: DataFrame, segment: int = 4, threshold: float = 2.0) -> DataFrame:
    """PAT7: the split with the largest difference of means in terms of the pooled deviation, if it is over ``threshold``; prefix and suffix sums, no loop."""
    y = rows.where("target IS NOT NULL").withColumn("k", F.row_number().over(BY())).withColumn("m", F.count(F.lit(1)).over(S())).withColumn("dy", F.col("target") - F.avg("target").over(S()))
    left, right = BY().rowsBetween(Window.unboundedPreceding, -1), BY().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s1, s2 = F.sum("dy").over(left), F.sum(F.col("dy") * F.col("dy")).over(left)
    t1, t2 = F.sum("dy").over(right), F.sum(F.col("dy") * F.col("dy")).over(right)
    y = y.withColumn("n1", F.col("k") - 1).withColumn("n2", F.col("m") - F.col("k") + 1).withColumn("s1", s1).withColumn("s2", s2).withColumn("t1", t1).withColumn("t2", t2).where((F.col("n1") >= segment) & (F.col("n2") >= segment))
    u1, u2 = F.col("t1") - F.col("s1"), F.col("t2") - F.col("s2")
    m1, m2 = F.col("s1") / F.col("n1"), u1 / F.col("n2")
    v1, v2 = F.greatest(F.lit(0.0), F.col("s2") / F.col("n1") - m1 * m1), F.greatest(F.lit(0.0), u2 / F.col("n2") - m2 * m2)
    pooled = F.sqrt((F.col("n1") * v1 + F.col("n2") * v2) / F.col("m"))
    y = y.withColumn("stat", F.when(pooled > 1e-9, F.abs(m1 - m2) / F.when(pooled > 1e-9, pooled))).where("stat IS NOT NULL")
    best = y.groupBy("series_id").agg(F.max_by(F.struct("stat", "period"), F.struct(F.round("stat", 9), -F.col("k"))).alias("b"))
    return best.select("series_id", F.col("b.stat").alias("break_stat"), F.when(F.col("b.stat") > threshold, F.col("b.period")).alias("break_period"))


def forecastability(cls: Column, cv: Column, n_rel: Column, enough: int = 24) -> Column:
    """PAT8."""
    base = F.element_at(F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv]), cls)
    return clipped(base * (0.5 + 0.5 * F.least(F.lit(1.0), n_rel / enough)) - F.least(F.lit(0.3), 0.15 * F.greatest(F.lit(0.0), F.coalesce(cv, F.lit(0.0)) - 0.5)))


def data_quality(missing: Column, unreliable: Column, outlier: Column) -> Column:
    """PAT9."""
    return clipped(1 - 0.4 * missing - 0.4 * unreliable - 0.2 * outlier)


def profile(obs: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """All native behaviour statistics, one row a series (JN4)."""
    rows = applicable_rows(obs)
    out = descriptive(rows, cfg)
    for part in (autocorrelation(rows), trend(rows, cfg.season), outlier_share(rows), structural_break(rows)):
        out = out.join(part, "series_id", "left")
    out = out.withColumn("outlier_pct", F.coalesce("outlier_pct", F.lit(0.0)))
    out = out.withColumn("forecastability", forecastability(F.col("pattern_class"), F.col("cv"), F.col("n_rel"), cfg.gate.seasonal_min_history))
    return out.withColumn("data_quality", data_quality(F.col("missing_pct"), F.col("unreliable_pct"), F.col("outlier_pct")))


def stationarity(rows: DataFrame, lag: int | None = None) -> DataFrame:
    """PAT4 of each series with 8 values or more: ``lag, tau, p_value, stationary`` (1, 0 or null)."""
    y = rows.where("target IS NOT NULL").groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("idx", F.col("target").cast("double").alias("y")))).alias("r"))
    return R.unit_root(y.where(F.size("r") >= 8).select("series_id", F.col("r.y").alias("y")), lag).withColumn("stationary", R.stationary(F.col("p_value")))


def decomposition(rows: DataFrame, season: int = 12) -> DataFrame:
    """PAT3 for each series, by one function over whole series: ``trend_strength, seasonal_strength`` of a robust STL where there are two seasons and one more; and ``stationary`` (PAT4)."""
    from ..functions.stats import stl

    ship(rows.sparkSession)

    def strengths(y: np.ndarray) -> tuple[float | None, float | None]:
        t = s = None
        if len(y) >= 2 * season + 1:
            trend_, seasonal, rest = stl(y, season)
            strength = lambda part: max(0.0, 1 - np.var(rest) / v) if (v := np.var(part + rest)) > 0 else 0.0
            t, s = float(strength(trend_)), float(strength(seasonal))
        return t, s

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(key, *strengths(y[~np.isnan(y)])) for key, y in zip(pdf["series_id"], (np.asarray(v, float) for v in pdf["y"]))]
            yield pd.DataFrame(got, columns=["series_id", "trend_strength", "seasonal_strength"])

    whole = rows.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("idx", F.col("target").cast("double").alias("y")))).alias("r")).select("series_id", F.col("r.y").alias("y"))
    parts = dealt(whole).mapInPandas(run, "series_id string, trend_strength double, seasonal_strength double")
    return parts.join(stationarity(rows).select("series_id", "stationary"), "series_id", "left")
