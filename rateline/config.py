"""Settings of a run. All have defaults; ``EngineConfig.from_json`` reads any part of them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass, replace

#: Periods in a season, by granularity.
SEASON = {"monthly": 12, "weekly": 52, "daily": 7}
SWEEP_MOST = 6


def window_sweep(shortest: int, longest: int, limit: int = SWEEP_MOST) -> list[int]:
    """Evenly spaced window lengths of 2 or more, ``limit`` at most."""
    lo, hi = max(2, min(shortest, longest)), max(2, shortest, longest)
    n = min(limit, hi - lo + 1)
    return [lo] if n <= 1 else sorted({round(lo + (hi - lo) * i / (n - 1)) for i in range(n)})


# The names and defaults of all settings below.


@dataclass(frozen=True)
class Gate:
    min_history_competition: int = 6
    seasonal_min_history: int = 24
    min_cv_origins: int = 3


@dataclass(frozen=True)
class Rate:
    derive_missing: bool = False


@dataclass(frozen=True)
class Driver:
    floor_fraction: float = 0.20


@dataclass(frozen=True)
class Context:
    enabled: bool = True
    min_regime_obs: int = 4
    materiality: float = 0.10
    alpha: float = 0.05
    observations_per_regressor: int = 8
    max_vif: float = 5.0
    min_driver_cv: float = 0.10


@dataclass(frozen=True)
class Models:
    enable_arima: bool = False
    disabled_models: tuple[str, ...] = ()
    lookback_windows: tuple[int, ...] = (3, 6, 12)
    ensemble_mase_tolerance: float = 0.10


@dataclass(frozen=True)
class CrossValidation:
    horizon: int = 3
    max_origins: int = 8


@dataclass(frozen=True)
class Selection:
    simplicity_mase_tolerance: float = 0.05


@dataclass(frozen=True)
class Forecast:
    horizon: int = 12
    interval_levels: tuple[float, float] = (0.80, 0.95)

    def __post_init__(self):
        lo, hi = self.interval_levels
        if not 0 < lo < hi < 1:
            raise ValueError("interval levels must rise between 0 and 1")


@dataclass(frozen=True)
class Scope:
    item_codes: tuple[str, ...] = ()
    bom_items_only: bool = False

    def note(self) -> str:
        n = len(self.item_codes)
        text = "all items" if not n else f"1 item ({self.item_codes[0]})" if n == 1 else f"{n} items"
        return text + (", bom-listed only" if self.bom_items_only else "")


@dataclass(frozen=True)
class EngineConfig:
    granularity: str = "monthly"
    gate: Gate = field(default_factory=Gate)
    rate: Rate = field(default_factory=Rate)
    driver: Driver = field(default_factory=Driver)
    context: Context = field(default_factory=Context)
    models: Models = field(default_factory=Models)
    cv: CrossValidation = field(default_factory=CrossValidation)
    selection: Selection = field(default_factory=Selection)
    forecast: Forecast = field(default_factory=Forecast)
    scope: Scope = field(default_factory=Scope)
    fast_mode: bool = False
    random_seed: int = 42

    @property
    def season(self) -> int:
        return SEASON[self.granularity]

    @classmethod
    def from_dict(cls, values: dict) -> "EngineConfig":
        def filled(base, given: dict):
            known = {f.name for f in fields(base)}
            if odd := set(given) - known:
                raise ValueError(f"unknown settings: {sorted(odd)}")
            return replace(base, **{k: filled(getattr(base, k), v) if is_dataclass(getattr(base, k)) else tuple(v) if isinstance(v, list) else v for k, v in given.items()})

        out = filled(cls(), values)
        if out.granularity not in SEASON:
            raise ValueError(f"granularity must be one of {sorted(SEASON)}")
        return out

    @classmethod
    def from_json(cls, path: str) -> "EngineConfig":
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))
