"""The frames that a run is handed on as, with a dictionary of their columns (SNK10, SNK11, SNK13, SNK14, SNK17, ORD8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.explain import described, expanded, number_format
from .store import Repository

#: Names of the frames, and columns that show one quantity and share a number format.
SHEETS = ("forecasts", "selections", "series", "context", "warnings")
GROUPS = (("target_value", "lower_80", "upper_80", "lower_95", "upper_95"), ("reconstructed_demand", "demand_lower_80", "demand_upper_80", "demand_lower_95", "demand_upper_95"))
IDENTITY = ("item_code", "description", "line", "output_type")
#: Rows of a preview on screen, of imports and of results.
PREVIEW, LONG_PREVIEW = 10, 200

PURPOSE = {
    "forecasts": "Point, bands and demand: series x step.",
    "selections": "The chosen model and its back-test: one row a series.",
    "series": "Statistics of the target over the whole history: one row a series.",
    "context": "Kruskal-Wallis test of the target by regime: one row a series.",
    "warnings": "Notes of the run: one row a note.",
}
_RATE, _SHARE = "kg per t of output, or quantity per day", "0 to 1"
# Columns by frame, "" for all of them: how the value is made, and its unit or range.
TEXTS: dict[str, dict[str, tuple[str, str]]] = {
    "": {
        "item_code": ("First part of series_id.", "text"),
        "description": ("items.description, joined by item_code.", "text; a placeholder where items lacks the code"),
        "line": ("Second part of series_id.", "text"),
        "output_type": ("Third part of series_id.", "text"),
        "run_id": ("Random identifier, drawn by create_run.", "text"),
        "mode": ("relative where rates and a driver exist or the item declares it; absolute otherwise.", "relative, absolute"),
        "model": ("Name of the candidate whose points are used.", "text"),
        "confidence": ("0.35 / (1 + mase) + 0.30 min(1, n_reliable / 24) + 0.20 forecastability + 0.15 data_quality; 0.14 stands for the first term without a mase, and without a competition the sum is cut at 0.35.", _SHARE),
    },
    "forecasts": {
        "period": ("Label of period_start in the run's granularity.", "yyyy-MM, yyyy-'W'ww or yyyy-MM-dd"),
        "period_start": ("last_start plus step periods.", "date"),
        "step": ("1 for the period after last_period, and on.", "periods"),
        "target_value": ("max(0, point), where the model gives the point.", _RATE),
        "lower_80": ("max(0, point - z sigma g), z the 0.90 quantile of the normal distribution; g is the root of step for models that grow, else 1.", _RATE),
        "upper_80": ("point + z sigma g with that z and g; target_value at least.", _RATE),
        "lower_95": ("As lower_80 with the 0.975 quantile; lower_80 at most.", _RATE),
        "upper_95": ("As upper_80 with the 0.975 quantile; upper_80 at least.", _RATE),
        "driver_plan": ("Sum of driver_qty of type plan by period, line and output_type; null in absolute mode.", "t"),
        "reconstructed_demand": ("target_value x driver_plan (relative), target_value x days of the period (absolute); null without a plan.", "base unit of the item"),
        "demand_lower_80": ("lower_80 by the same factor as reconstructed_demand.", "base unit of the item"),
        "demand_upper_80": ("upper_80 by that factor.", "base unit of the item"),
        "demand_lower_95": ("lower_95 by that factor.", "base unit of the item"),
        "demand_upper_95": ("upper_95 by that factor.", "base unit of the item"),
    },
    "selections": {
        "route": ("routed for intermittent and lumpy classes, cold_start under 6 reliable periods, compete otherwise; compete_fallback where no candidate was scored.", "four codes"),
        "mase": ("Mean over origins of mean |y_hat - y| / mean |y(t) - y(t - 1)| before the origin.", "0 and more; null without a competition"),
        "window": ("w of MovingAverage(w) and WeightedMovingAverage(w).", "periods; null for other models"),
        "n_origins": ("Origins with a reliable test period.", "0 to 8"),
        "reason_code": ("competition_winner, routed_* or cold_start_*, by route and model.", "code"),
        "reason": ("reason_code as a sentence, with mase and n_origins put in.", "text"),
        "confidence_label": ("low below 0.40, medium below 0.70, high from there.", "three codes"),
        "is_override": ("1 where model_override names a model that has points.", "0, 1"),
        "override_reason": ("Set where model_override names a model that has none.", "text or null"),
    },
    "series": {
        "mode_source": ("Which rule set mode: a planner (declared_ui), the item (declared_bom), the data (inferred), or rates without a driver (no_driver).", "four codes"),
        "first_period": ("min(period) of rows.", "period label"),
        "last_period": ("max(period) of rows.", "period label"),
        "last_start": ("max(period_start) of rows.", "date"),
        "n_periods": ("Calendar periods between first_period and last_period, both included.", "periods"),
        "n_observed": ("n_periods less gap-filled ones.", "periods"),
        "n_reliable": ("Count of driver_qty >= 0.2 x its median, or of all periods in absolute mode.", "periods"),
        "n_applicable": ("n_periods less those without driver and rate.", "periods"),
        "is_orphan": ("1 if rates exist and driver has no row of line and output_type.", "0, 1"),
        "target_uom": ("rate_uom of most rows, or base unit a day.", "text"),
        "pattern_class": ("By adi (1.32) and cv2 (0.49), from 6 values on.", "five codes"),
        "forecastability": ("Base of pattern_class x (0.5 + 0.5 min(1, n / 24)) - min(0.3, 0.15 max(0, cv - 0.5)).", _SHARE),
        "data_quality": ("1 - 0.4 missing_pct - 0.4 unreliable_pct - 0.2 outlier_pct.", _SHARE),
        "break_period": ("argmax over splits of |mean1 - mean2| / pooled deviation, where that exceeds 2.", "period label or null"),
        "adi": ("n values / n values above 0.", "1 and more"),
        "cv2": ("(deviation / mean) squared of values above 0.", "0 and more"),
        "cv": ("deviation / mean of observed values.", "0 and more"),
        "autocorr_lag1": ("corr(y(t), y(t - 1)) of observed values.", "-1 to 1"),
        "outlier_pct": ("Share of values above 0 with 0.6745 |y - median| > 3.5 MAD.", _SHARE),
        "missing_pct": ("Share of gap-filled periods.", _SHARE),
        "trend_strength": ("1 - var(rest) / var(trend + rest) of a loess decomposition, or the r2 of a line for short series.", _SHARE),
        "seasonal_strength": ("1 - var(rest) / var(season + rest) of that decomposition.", _SHARE),
        "stationary": ("1 if the augmented Dickey-Fuller test has p < 0.05.", "0, 1, null under 8 values"),
    },
    "context": {
        "n": ("Periods with a target and a regime.", "periods"),
        "k": ("Regimes after pooling of rare ones.", "regimes"),
        "statistic": ("Kruskal-Wallis H, corrected for ties.", "0 and more"),
        "p_value": ("Chi-squared tail of statistic at k - 1 degrees.", _SHARE),
        "spread_pct": ("(max - min of regime means) / overall mean.", "share of the mean"),
        "effect_size": ("(statistic - k + 1) / (n - k), cut to 0 and 1.", _SHARE),
        "high_label": ("argmax of regime means.", "regime"),
        "low_label": ("argmin of regime means.", "regime"),
        "material": ("p_value < 0.05 and spread_pct >= 0.10 and known_future.", "0, 1"),
        "known_future": ("1 if every future period has conditions.", "0, 1"),
        "skip_reason": ("First rung of the ladder that stopped the test.", "code or null"),
        "verdict": ("material and both labels as a sentence.", "text"),
    },
    "warnings": {
        "series_id": ("item_code|line|output_type.", "text"),
        "code": ("Name of the rule.", "code"),
        "severity": ("Level of the rule.", "warning, info"),
        "message": ("The rule's sentence with its counts.", "text"),
    },
}


def build_frames(store: Repository, run_id: str | None = None, series: list[str] | None = None, sheets: tuple[str, ...] = SHEETS) -> dict[str, DataFrame]:
    """SNK10, JN23: a run's results, the latest complete one's by default, identity columns first and without internal keys; only of the run's series, or of ``series``. Empty if there is no complete run."""
    if run_id is None and (latest := store.latest_complete()) is None:
        return {}
    run_id = run_id or latest["run_id"]
    items = store.read("item")
    own = store.read("series", series=series)
    mine = store.read("selection", run_id).select("series_id")
    own = own.join(mine, "series_id", "left_semi")
    keys = own.select("series_id", "item_code", "line", "output_type")

    def named(table: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
        rows = table.drop(*drop, "item_code", "line", "output_type").join(keys, "series_id")
        return described(rows, items).drop("series_id")

    made = {
        "forecasts": lambda: named(store.read("forecast", run_id)),
        "selections": lambda: named(store.read("selection", run_id), ("rejected",)),
        "series": lambda: described(own, items).drop("series_id"),
        "context": lambda: named(store.read("series_context"), ("regime_counts_json",)) if store.read("series_context") is not None else None,
        "warnings": lambda: described(expanded(store.read("warning", run_id)), items),
    }
    out = {s: made[s]() for s in SHEETS if s in sheets}
    return {s: df for s, df in out.items() if df is not None}


def tooltip(sheet: str, column: str) -> str:
    """EXP6: how a column is made and its unit, or nothing."""
    return " ".join(TEXTS.get(sheet, {}).get(column) or TEXTS[""].get(column, ()))


def dictionary(frames: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """SNK11: a row for each column of the frames, in their order."""
    rows = []
    for s, df in frames.items():
        for i, (c, kind) in enumerate(df.dtypes):
            how, unit = TEXTS.get(s, {}).get(c) or TEXTS[""].get(c, ("", ""))
            rows.append((s, PURPOSE.get(s, ""), i, c, kind, how, unit))
    return spark.createDataFrame(rows, "sheet string, purpose string, place int, column_name string, type string, formula string, unit string")


def formats(df: DataFrame) -> DataFrame:
    """SNK13: number formats of a frame's numeric columns."""
    return number_format(df, [c for c, k in df.dtypes if k in ("double", "float", "int", "bigint")], GROUPS)


def export(frames: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """SNK14: a folder a frame, in Parquet or as CSV with a header."""
    for name, df in frames.items():
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv if kind == "csv" else writer.parquet)(f"{path.rstrip('/')}/{name}")


def export_run(store: Repository, path: str, run_id: str | None = None, series: list[str] | None = None, kind: str = "parquet") -> None:
    """SNK17: a run's frames with their dictionary before them; an error if there is no complete run."""
    frames = build_frames(store, run_id, series)
    if not frames:
        raise ValueError("nothing to export: there is no completed run")
    export({"data_dictionary": dictionary(frames, store.spark), **frames}, path, kind)


def preview(df: DataFrame, long: bool = False) -> DataFrame:
    """ORD8: the first rows, for a screen."""
    return df.limit(LONG_PREVIEW if long else PREVIEW)
