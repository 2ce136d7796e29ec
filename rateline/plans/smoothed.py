"""Queries of smoothed models. Their SQL smooths level and slope themselves, where the operators run through differences."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest as T
from ..operators import prepare as P
from ..operators import smoothing as S
from .forecasting import CFG
from .oracle_base import with_steps
from .prepared import prepared

NAMES = {"bt_ses": "SES", "bt_holt": "Holt", "bt_damped": "DampedHolt", "bt_theta": "Theta"}


def _candidate(name: str) -> T.Candidate:
    return next(c for c in T.all_candidates(CFG) if c.name == name)


def _folds(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold predictions of one smoothed model."""
    rows = T.by_step(S.smoothed_folds(P.fit_targets(prepared(spark, sf_dir).observations), [_candidate(name)], CFG))
    return rows.select("series_id", "origin", "step", *[(F.round(c, 5) + 0.0).alias(c) for c in ("y_hat", "actual")])


def smoothed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEL10 of SES and Theta: forecasts from the whole history, and the deviation of one-step errors."""
    p = prepared(spark, sf_dir)
    wanted = p.series.select("series_id", F.explode(F.array(F.lit("SES"), F.lit("Theta"))).alias("model"))
    made = S.smoothed_forecasts(P.fit_targets(p.observations), wanted, CFG)
    return made.select("series_id", "model", "step", *[(F.round(c, 5) + 0.0).alias(c) for c in ("point", "sigma")], "grows")


QUERIES = {**{k: partial(_folds, v) for k, v in NAMES.items()}, "smoothed_points": smoothed_points}


def _values(form: S.Form) -> str:
    return ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {p}::DOUBLE)" for p in form.phi for a in form.a for b in form.b)


#: Level and slope from a start at zero (l, s), from a first level of one (m, n) and from a first slope of one (p, q), and sums of products of what each says of the next value.
_STATE = "lambda x, v: {'l': x.l + g_phi * x.s + g_a * (v - x.l - g_phi * x.s), 's': g_phi * x.s + g_a * g_b * (v - x.l - g_phi * x.s), 'm': (1 - g_a) * (x.m + g_phi * x.n), 'n': g_phi * x.n - g_a * g_b * (x.m + g_phi * x.n), 'p': (1 - g_a) * (x.p + g_phi * x.q), 'q': g_phi * x.q - g_a * g_b * (x.p + g_phi * x.q), 'ee': x.ee + pow(v - x.l - g_phi * x.s, 2), 'em': x.em + (v - x.l - g_phi * x.s) * (x.m + g_phi * x.n), 'ep': x.ep + (v - x.l - g_phi * x.s) * (x.p + g_phi * x.q), 'mm': x.mm + pow(x.m + g_phi * x.n, 2), 'mp': x.mp + (x.m + g_phi * x.n) * (x.p + g_phi * x.q), 'pp': x.pp + pow(x.p + g_phi * x.q, 2)}"
_ZERO = "{" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in dict(l=0, s=0, m=1, n=0, p=0, q=1, ee=0, em=0, ep=0, mm=0, mp=0, pp=0).items()) + "}"


def _smoothed(name: str, last_only: bool = False) -> dict[str, str]:
    """Steps up to ``{name}_out``: the best weights and the state of each series and origin."""
    form, c, n = S.FORMS[name], _candidate(name), name.lower()
    least = max(c.min_history, 2)
    first = "n" if last_only else f"greatest({least}, n - 3 - 7)"
    last, rel = ("n", 0) if last_only else ("n - 3", max(c.min_history, c.reliable))
    state = _STATE if form.trend else _STATE.replace("g_phi * x.s", "0").replace("g_phi * x.n", "0").replace("g_phi * x.q", "0").replace("'q': 0", "'q': 0.0").replace("'s': 0", "'s': 0.0").replace("'n': 0", "'n': 0.0")
    run = f"list_reduce(z, {state}, {_ZERO})".replace("g_a", "a").replace("g_b", "b").replace("g_phi", "phi")
    if form.trend:
        sse = "r.ee - (r.pp * r.em * r.em - 2 * r.mp * r.em * r.ep + r.mm * r.ep * r.ep) / (r.mm * r.pp - r.mp * r.mp)"
    else:
        sse = "r.ee - r.em * r.em / r.mm"
    best = "QUALIFY row_number() OVER (PARTITION BY series_id, o ORDER BY sse, a, b, phi) = 1"
    tried = lambda rows: f"SELECT series_id, o, z, a, b, phi, r, greatest({sse}, 0.0) AS sse FROM (SELECT *, {run} AS r FROM ({rows})) {best}"
    z = "list_transform(y[1:o], lambda v: v - y[1])"
    if form.line:
        z = "list_transform(y[1:o], lambda v, i: 2 * v - (line_at + line_slope * (i - 1)))"
        orig = f"SELECT series_id, o, y, regr_slope(v, t) AS line_slope, regr_intercept(v, t) AS line_at FROM (SELECT series_id, o, y, unnest(y[1:o]) AS v, unnest(range(0, o))::DOUBLE AS t FROM (SELECT *, unnest(range({first}, {last} + 1)) AS o FROM ys WHERE n_rel >= {rel} AND {last} >= {least})) GROUP BY ALL"
    else:
        orig = f"SELECT series_id, unnest(range({first}, {last} + 1)) AS o, y, 0.0 AS line_slope, 0.0 AS line_at FROM ys WHERE n_rel >= {rel} AND {last} >= {least}"
    moves = [(0, 0, 0)] + [(i, 0, 0) for i in (-1, 1)] + [(0, j, 0) for j in (-1, 1) if form.trend] + [(0, 0, k) for k in (-1, 1) if form.phi_gap]
    out = {"ys": "SELECT series_id, list(y ORDER BY idx) AS y, list(valid ORDER BY idx) AS valid, count(*) AS n, sum(valid) AS n_rel FROM fit GROUP BY series_id", f"{n}_o": orig}
    out[f"{n}_0"] = tried(f"SELECT series_id, o, {z} AS z, a, b, phi FROM {n}_o CROSS JOIN (VALUES {_values(form)}) g(a, b, phi)")
    clip = lambda x, lo, hi: f"greatest({lo}, least({hi}, {x}))"
    for k in range(1, form.rounds + 1):
        far = 0.5**k
        a = clip(f"w.a + m.i * {form.gap * far!r}", S.LEAST, S.MOST)
        b = clip(f"w.b + m.j * {form.gap * far!r}", S.LEAST, S.MOST) if form.trend else "w.b"
        phi = clip(f"w.phi + m.k * {form.phi_gap * far!r}", S.LEAST_PHI, S.MOST_PHI) if form.phi_gap else "w.phi"
        out[f"{n}_{k}"] = tried(f"SELECT w.series_id, w.o, w.z, {a} AS a, {b} AS b, {phi} AS phi FROM {n}_{k - 1} w CROSS JOIN (VALUES {', '.join(map(str, moves))}) m(i, j, k)")
    if form.trend:
        slope = "(r.mm * r.ep - r.mp * r.em) / (r.mm * r.pp - r.mp * r.mp)"
        states = f"SELECT *, l0 AS first_level, r.l + l0 * r.m + s0 * r.p AS level, r.s + l0 * r.n + s0 * r.q AS slope FROM (SELECT *, (r.em - s0 * r.mp) / r.mm AS l0 FROM (SELECT *, {slope} AS s0 FROM {n}_{form.rounds}))"
    else:
        states = f"SELECT *, r.em / r.mm AS first_level, r.l + r.em / r.mm * r.m AS level, 0.0 AS slope FROM {n}_{form.rounds}"
    out[f"{n}_out"] = states
    return out


def _said(name: str, step: str) -> str:
    """What is said of a step, from state ``s`` and line ``k``."""
    form = S.FORMS[name]
    if form.line:
        return f"0.5 * s.level + 0.5 * (k.line_at + k.line_slope * (s.o - 1 + {step}))"
    return f"k.y[1] + s.level" + (f" + s.slope * list_sum(list_transform(range(1, {step} + 1), lambda j: pow(s.phi, j)))" if form.trend else "")


def _bt(name: str) -> str:
    n = name.lower()
    return with_steps("fit", f"SELECT series_id, CAST(o AS INT) AS origin, CAST(step AS INT) AS step, round({_said(name, 'step')}, 5) + 0.0 AS y_hat, round(k.y[1 + s.o + step - 1], 5) + 0.0 AS actual FROM {n}_out s JOIN (SELECT o.series_id, o.o, ys.y, line_slope, line_at FROM {n}_o o JOIN ys USING (series_id)) k USING (series_id, o) CROSS JOIN (VALUES (1), (2), (3)) h(step)", _smoothed(name))


def _points(name: str) -> tuple[str, dict[str, str]]:
    n, half = name.lower(), 0.5 if S.FORMS[name].line else 1.0
    missed = "list_reduce(s.z, lambda x, v: {'l': x.l + s.a * (v - x.l), 'e1': x.e1 + (v - x.l), 'e2': x.e2 + pow(v - x.l, 2)}, {'l': s.first_level, 'e1': 0.0::DOUBLE, 'e2': 0.0::DOUBLE})"
    q = f"SELECT series_id, '{name}' AS model, CAST(step AS INT) AS step, round({_said(name, 'step')}, 5) + 0.0 AS point, round({half} * sqrt(greatest(e.e2 / s.o - pow(e.e1 / s.o, 2), 0.0)), 5) + 0.0 AS sigma, {str(T.FITTED[name][2]).lower()} AS grows FROM (SELECT *, {missed} AS e FROM {n}_out s) s JOIN {n}_o k USING (series_id, o) CROSS JOIN (SELECT unnest(range(1, {CFG.forecast.horizon + 1})) AS step) h"
    return q, _smoothed(name, True)


_SES, _THETA = _points("SES"), _points("Theta")

ORACLE = {**{k: _bt(v) for k, v in NAMES.items()}, "smoothed_points": with_steps("fit", f"{_SES[0]} UNION ALL {_THETA[0]}", {**_SES[1], **_THETA[1]})}
