"""All registered queries, and DuckDB's SQL for those that it can express."""

from __future__ import annotations

from . import conditions, forecasting, learning, prepared, profiled, smoothed, validated

MODULES = (prepared, validated, profiled, conditions, forecasting, smoothed, learning)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
FLAGSHIP = forecasting.entry_query
