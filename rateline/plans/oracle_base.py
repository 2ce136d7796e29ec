"""Common table expressions, in DuckDB's SQL, of the tables that most checks start from."""

from __future__ import annotations

# Each entry needs those before it only.
STEPS: dict[str, str] = {
    "place": "SELECT c_custkey, CAST(n_regionkey AS VARCHAR) AS line FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "consumption": """SELECT l_shipdate AS date, p_brand AS item_code, o_orderstatus AS output_type, line, l_quantity AS qty_base, l_quantity / 1000 AS qty_ton, l_extendedprice AS cost,
  CASE WHEN right(p_brand, 1) IN ('1', '3', '5') THEN l_tax END AS rate, CASE WHEN right(p_brand, 1) IN ('1', '3', '5') THEN 'kg/t' END AS rate_uom, o_orderkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN place ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey WHERE l_shipdate < TIMESTAMP '2001-01-01'""",
    "driver_raw": "SELECT o_orderdate AS date, o_totalprice / 1000 AS driver_qty, 't' AS driver_uom, o_orderstatus AS output_type, line, CASE WHEN o_orderdate < TIMESTAMP '2001-01-01' THEN 'actual' ELSE 'plan' END AS driver_type FROM orders JOIN place ON o_custkey = c_custkey",
    "items": "SELECT p_brand AS item_code, 'item ' || p_brand AS description, 'kg' AS uom, min(p_type) AS cat_l1, max(p_type) AS cat_l2, left(p_brand, 7) AS cat_l3 FROM part GROUP BY p_brand",
    "std": "SELECT item_code, line, output_type, sum(rate) / count(DISTINCT date_trunc('month', date)) AS std_rate FROM consumption WHERE rate IS NOT NULL GROUP BY ALL",
    "driver": """SELECT CAST(date_trunc('month', date) AS DATE) AS period_start, line, output_type, driver_type, sum(driver_qty) AS driver_qty, min(driver_uom) AS driver_uom, count(DISTINCT CAST(date AS DATE)) AS n_days_observed,
  CAST(count(DISTINCT CAST(date AS DATE)) > 1 AND count(DISTINCT CAST(date AS DATE)) < day(last_day(CAST(date_trunc('month', min(date)) AS DATE))) AS INT) AS is_partial
  FROM driver_raw GROUP BY CAST(date_trunc('month', date) AS DATE), line, output_type, driver_type""",
    "dup": "SELECT item_code, line, output_type, CAST(date_trunc('month', date) AS DATE) AS period_start, sum(qty_base) AS qty_base, sum(qty_ton) AS qty_ton, sum(cost) AS cost, sum(rate) AS rate FROM consumption GROUP BY ALL",
    "bounds": "SELECT item_code, line, output_type, min(period_start) AS lo, max(period_start) AS hi, bool_or(rate IS NOT NULL) AS has_rate FROM dup GROUP BY ALL",
    "spine": "SELECT item_code, line, output_type, has_rate, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS period_start FROM bounds",
    "gaps": """SELECT s.item_code, s.line, s.output_type, s.has_rate, s.period_start, coalesce(d.qty_base, 0.0) AS qty_base, coalesce(d.qty_ton, 0.0) AS qty_ton, coalesce(d.cost, 0.0) AS cost, d.rate,
  CAST(d.item_code IS NULL AS INT) AS is_gap_filled FROM spine s LEFT JOIN dup d ON s.item_code = d.item_code AND s.line = d.line AND s.output_type = d.output_type AND s.period_start = d.period_start""",
    "joined": """SELECT g.*, CASE WHEN g.has_rate AND c.line IS NOT NULL THEN 'relative' ELSE 'absolute' END AS mode, CASE WHEN g.has_rate AND c.line IS NULL THEN 'no_driver' ELSE 'inferred' END AS mode_source,
  CASE WHEN g.has_rate AND c.line IS NOT NULL THEN a.driver_qty END AS driver_qty, CAST(g.has_rate AND c.line IS NULL AS INT) AS is_orphan
  FROM gaps g LEFT JOIN (SELECT DISTINCT line, output_type FROM driver) c ON g.line = c.line AND g.output_type = c.output_type
  LEFT JOIN driver a ON a.driver_type = 'actual' AND a.period_start = g.period_start AND a.line = g.line AND a.output_type = g.output_type""",
    "med": "SELECT item_code, line, output_type, median(driver_qty) AS med FROM joined GROUP BY ALL",
    "obs": """SELECT j.item_code || '|' || j.line || '|' || j.output_type AS series_id, j.item_code, j.line, j.output_type, j.period_start, strftime(j.period_start, '%Y-%m') AS period,
  row_number() OVER (PARTITION BY j.item_code, j.line, j.output_type ORDER BY j.period_start) - 1 AS idx, qty_base, qty_ton, cost, CASE WHEN mode = 'relative' THEN coalesce(rate, 0.0) ELSE rate END AS rate, driver_qty,
  CASE WHEN mode = 'relative' THEN coalesce(rate, 0.0) ELSE qty_base / day(last_day(j.period_start)) END AS target, is_gap_filled,
  CASE WHEN mode = 'relative' THEN CAST(driver_qty IS NOT NULL AND driver_qty > 0 AND driver_qty >= 0.2 * med AS INT) ELSE 1 END AS is_reliable,
  CASE WHEN mode = 'relative' AND (driver_qty IS NULL OR driver_qty <= 0) AND coalesce(rate, 0.0) = 0 THEN 0 ELSE 1 END AS is_applicable,
  CASE WHEN mode = 'relative' AND driver_qty IS NOT NULL AND NOT (driver_qty > 0 AND driver_qty >= 0.2 * med) THEN 1 ELSE 0 END AS is_low_driver, is_orphan, mode, mode_source
  FROM joined j JOIN med m ON j.item_code = m.item_code AND j.line = m.line AND j.output_type = m.output_type""",
    "series": """SELECT series_id, item_code, line, output_type, mode, mode_source, min(period) AS first_period, max(period) AS last_period, max(period_start) AS last_start, count(*) AS n_periods, sum(1 - is_gap_filled) AS n_observed,
  sum(is_reliable) AS n_reliable, sum(is_applicable) AS n_applicable, max(is_orphan) AS is_orphan FROM obs GROUP BY ALL""",
    "near": """SELECT *, CAST(is_reliable = 1 AND target IS NOT NULL AS INT) AS valid,
  max(CASE WHEN is_reliable = 1 THEN idx END) OVER (PARTITION BY series_id ORDER BY idx) AS i0, min(CASE WHEN is_reliable = 1 THEN idx END) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1 FROM obs""",
    "fit": """SELECT n.*, CASE WHEN n.valid = 1 THEN n.target WHEN n.i0 IS NULL AND n.i1 IS NULL THEN 0.0 WHEN n.i0 IS NULL THEN b.target WHEN n.i1 IS NULL THEN a.target
  ELSE a.target + (b.target - a.target) * (n.idx - n.i0) / (n.i1 - n.i0) END AS y, CASE WHEN n.valid = 1 THEN n.driver_qty END AS weight
  FROM near n LEFT JOIN obs a ON a.series_id = n.series_id AND a.idx = n.i0 LEFT JOIN obs b ON b.series_id = n.series_id AND b.idx = n.i1""",
}


def with_steps(last: str, select: str, more: dict[str, str] | None = None) -> str:
    """``select`` after all steps up to ``last`` and ``more``."""
    names = list(STEPS)
    used = {n: STEPS[n] for n in names[: names.index(last) + 1]} | (more or {})
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in used.items()) + "\n" + select
