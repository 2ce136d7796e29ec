"""Exponential smoothing and the two-line method as array recurrences (MOD7-MOD9, MOD12), with no Python in the plan.

A series is one row with its values in order. In differences of the values,
what smoothing misses one step ahead is a short recurrence: with weight a, trend
weight b and damping phi, and w the values' differences less phi times the
differences before,

    e(t) = w(t) + (1 - a + phi - phi a b) e(t - 1) - phi (1 - a) e(t - 2),

and without a trend e(t) = y(t) - y(t - 1) + (1 - a) e(t - 1). The first errors
are free, since the first level and slope are. Errors are linear in them, so one
pass carries the errors of a start at zero and the answer to a first error of
one, and sums of their products give the best start and the squared error that
it leaves, by normal equations of one or two unknowns.

The weights are those of least squared error: of a coarse grid, for all origins
from one pass a grid point, since what is smoothed so far does not depend on
what comes; and then, for each origin, of the neighbours of the best so far, at
a distance that is halved in each round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..staging import dealt
from . import backtest as T


@dataclass(frozen=True)
class Form:
    """Weights on a coarse grid, and how far apart they lie; ``line``: the method of two lines, of which one is smoothed."""

    a: tuple[float, ...]
    b: tuple[float, ...] = (0.0,)
    phi: tuple[float, ...] = (0.0,)
    gap: float = 0.1
    phi_gap: float = 0.0
    rounds: int = 5
    line: bool = False

    @property
    def trend(self) -> bool:
        return self.phi != (0.0,)


_TENTHS = tuple(round(0.05 + i / 10, 2) for i in range(10))
FORMS = {
    "SES": Form(tuple(round(i / 20, 2) for i in range(1, 20)), gap=0.05, rounds=7),
    "Holt": Form(_TENTHS, _TENTHS, (1.0,)),
    "DampedHolt": Form(_TENTHS, _TENTHS[::2], (0.8, 0.9, 0.98), phi_gap=0.04),
    "Theta": Form(tuple(round(i / 20, 2) for i in range(1, 20)), gap=0.05, rounds=7, line=True),
}
#: Bounds of the weights, and of the damping.
LEAST, MOST, LEAST_PHI, MOST_PHI = 0.001, 0.999, 0.7, 0.995


def _start(trend: bool) -> str:
    """State at the last free error. ``d``: the last errors from a start at zero; ``q``: the last answers to a first error of one; sums of products up to the value before."""
    if not trend:
        return "named_struct('d', 0D, 'q', 1D, 'dd', 0D, 'dq', 0D, 'qq', 0D)"
    return "named_struct('d', 0D, 'd2', 0D, 'q', 1D, 'q2', 0D, 'dd', 0D, 'dq', 0D, 'dl', 0D, 'qq', 0D, 'ql', 0D)"


def _step(trend: bool, s: str, v: str, g: str) -> str:
    """State after one more difference."""
    if not trend:
        return f"named_struct('d', {v} + {g}.t * {s}.d, 'q', {g}.t * {s}.q, 'dd', {s}.dd + {s}.d * {s}.d, 'dq', {s}.dq + {s}.d * {s}.q, 'qq', {s}.qq + {s}.q * {s}.q)"
    return f"""named_struct('d', {v}.d - {g}.phi * {v}.b + {g}.t * {s}.d + {g}.u * {s}.d2, 'd2', {s}.d, 'q', {g}.t * {s}.q + {g}.u * {s}.q2, 'q2', {s}.q,
 'dd', {s}.dd + {s}.d * {s}.d, 'dq', {s}.dq + {s}.d * {s}.q, 'dl', {s}.dl + {s}.d * {s}.q2, 'qq', {s}.qq + {s}.q * {s}.q, 'ql', {s}.ql + {s}.q * {s}.q2)"""


def _run(trend: bool, w: str, g: str, finish: str | None = None) -> str:
    """State after all differences ``w``, or what ``finish`` makes of it, as ``s``."""
    return f"aggregate({w}, {_start(trend)}, (s, v) -> {_step(trend, 's', 'v', g)}" + (f", s -> {finish})" if finish else ")")


def _sums(trend: bool, s: str, g: str) -> dict[str, str]:
    """Sums of products over all values: of errors from zero, and of the answers to the first error (p) and the second (q)."""
    dd, dq, qq = f"({s}.dd + {s}.d * {s}.d)", f"({s}.dq + {s}.d * {s}.q)", f"({s}.qq + {s}.q * {s}.q)"
    if not trend:
        return {"dd": dd, "dq": dq, "qq": qq}
    # The answer to the first error is that to the second one a step before, times u.
    return {"dd": dd, "dq": dq, "qq": qq, "dp": f"({g}.u * ({s}.dl + {s}.d * {s}.q2))", "pq": f"({g}.u * ({s}.ql + {s}.q * {s}.q2))", "pp": f"(1D + {g}.u * {g}.u * {s}.qq)"}


def _left(trend: bool, s: str, g: str) -> str:
    """The squared error with the best first errors."""
    x = _sums(trend, s, g)
    if not trend:
        return f"greatest({x['dd']} - {x['dq']} * {x['dq']} / {x['qq']}, 0D)"
    named = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in x.items()) + ")"
    return f"transform(array({named}), x -> greatest(x.dd - (x.qq * x.dp * x.dp - 2D * x.pq * x.dp * x.dq + x.pp * x.dq * x.dq) / (x.pp * x.qq - x.pq * x.pq), 0D))[0]"


def _weights(a: str, b: str, phi: str) -> str:
    """Weights with the factors ``t`` and ``u`` of the last two errors."""
    return f"named_struct('a', {a}, 'b', {b}, 'phi', {phi}, 't', 1D - {a} + {phi} - {phi} * {a} * {b}, 'u', -{phi} * (1D - {a}))"


def _judged(trend: bool, s: str, g: str) -> str:
    return f"named_struct('sse', {_left(trend, s, g)}, 'a', {g}.a, 'b', {g}.b, 'phi', {g}.phi)"


def _grid(form: Form) -> str:
    return "array(" + ", ".join(_weights(f"{a!r}D", f"{b!r}D", f"{p!r}D") for p in form.phi for a in form.a for b in form.b) + ")"


def _coarse(form: Form) -> str:
    """The best of the grid for each number of values from ``first`` to ``last``: one pass a point of the grid, whose state is kept at each of them."""
    t = form.trend
    skip = 2 if t else 1  # values that have no difference
    more = f"transform(array(element_at(kept, -1)), s -> {_step(t, 's', 'v', 'g')})"
    kept = f"aggregate(slice(w, first + 1 - {skip}, last - first), array({_run(t, f'slice(w, 1, first - {skip})', 'g')}), (kept, v) -> concat(kept, {more}))"
    none = "transform(sequence(first, last), o -> named_struct('sse', double('infinity'), 'a', 0D, 'b', 0D, 'phi', 0D))"
    return f"aggregate({_grid(form)}, {none}, (best, g) -> zip_with(best, {kept}, (x, s) -> least(x, {_judged(t, 's', 'g')})))"


def _refined(form: Form, w: str, best: str) -> str:
    """The best around ``best`` (squared error and weights) for the differences ``w``: one weight is moved at a time."""
    t = form.trend
    moves = [(i, 0, 0) for i in (-1, 1)] + [(0, j, 0) for j in (-1, 1) if t] + [(0, 0, k) for k in (-1, 1) if form.phi_gap]
    listed = "array(" + ", ".join(f"named_struct('i', {i}D, 'j', {j}D, 'k', {k}D)" for i, j, k in moves) + ")"
    clip = lambda x, lo, hi: f"least(greatest({x}, {lo!r}D), {hi!r}D)"
    b = clip(f"was.b + d.j * {form.gap!r}D * r", LEAST, MOST) if t else "was.b"
    phi = clip(f"was.phi + d.k * {form.phi_gap!r}D * r", LEAST_PHI, MOST_PHI) if form.phi_gap else "was.phi"
    near = f"transform(transform({listed}, d -> named_struct('a', {clip(f'was.a + d.i * {form.gap!r}D * r', LEAST, MOST)}, 'b', {b}, 'phi', {phi})), x -> {_weights('x.a', 'x.b', 'x.phi')})"
    halves = "array(" + ", ".join(f"{0.5 ** (k + 1)!r}D" for k in range(form.rounds)) + ")"
    return f"aggregate({halves}, {best}, (was, r) -> array_min(concat(array(was), transform({near}, g -> {_run(t, w, 'g', _judged(t, 's', 'g'))}))))"


def _first_errors(trend: bool, w: str, g: str) -> str:
    """The best first errors: ``e1``, and with a trend ``e2``."""
    x = _sums(trend, "s", g)
    if not trend:
        return _run(False, w, g, f"named_struct('e1', -{x['dq']} / {x['qq']}, 'e2', 0D)")
    named = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in x.items()) + ")"
    solved = "named_struct('e1', (x.pq * x.dq - x.qq * x.dp) / (x.pp * x.qq - x.pq * x.pq), 'e2', (x.pq * x.dp - x.pp * x.dq) / (x.pp * x.qq - x.pq * x.pq))"
    return _run(True, w, g, f"transform(array({named}), x -> {solved})[0]")


def _errors(trend: bool, w: str, g: str, start: str) -> str:
    """The last two errors from those first ones (``e``, ``e2``), and the population deviation of all."""
    if trend:
        own, new = f"named_struct('e', {start}.e2, 'e2', {start}.e1, 's1', {start}.e1 + {start}.e2, 's2', {start}.e1 * {start}.e1 + {start}.e2 * {start}.e2, 'n', 2D)", f"v.d - {g}.phi * v.b + {g}.t * m.e + {g}.u * m.e2"
    else:
        own, new = f"named_struct('e', {start}.e1, 'e2', 0D, 's1', {start}.e1, 's2', {start}.e1 * {start}.e1, 'n', 1D)", f"v + {g}.t * m.e"
    end = "named_struct('e', m.e, 'e2', m.e2, 'sigma', sqrt(greatest(m.s2 / m.n - (m.s1 / m.n) * (m.s1 / m.n), 0D)))"
    return f"aggregate({w}, {own}, (m, v) -> transform(array({new}), e -> named_struct('e', e, 'e2', m.e, 's1', m.s1 + e, 's2', m.s2 + e * e, 'n', m.n + 1D))[0], m -> {end})"


def whole_series(fit: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """``series_id, y, valid, n, n_rel``: a row a series, its values in order; with ``own`` its columns too, and only its series.

    The rows are dealt to as many tasks as the session has for a shuffle: they
    are small, but the work on each is not, and by their size alone they would
    be merged into a few tasks.
    """
    rows = fit.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("idx", F.col("y").cast("double").alias("y"), F.col("valid").cast("int").alias("valid")))).alias("r"))
    more = [] if own is None else [c for c in own.columns if c != "series_id"]
    rows = dealt(rows if own is None else rows.join(own, "series_id"))
    return rows.select("series_id", *more, F.col("r.y").alias("y"), F.col("r.valid").alias("valid"), F.size("r").alias("n"), F.aggregate("r.valid", F.lit(0), lambda s, v: s + v).alias("n_rel"))


#: A straight line through the first ``o`` values by least squares: ``at`` the value at place 0, and ``slope``.
_LINE = """transform(array(aggregate(transform(slice(y, 1, o), (v, i) -> named_struct('v', v, 'i', cast(i AS DOUBLE))), named_struct('v', 0D, 'iv', 0D), (s, x) -> named_struct('v', s.v + x.v, 'iv', s.iv + x.i * x.v))),
 s -> named_struct('slope', (s.iv - (o - 1) / 2D * s.v) / (cast(o AS DOUBLE) * (o * o - 1) / 12D), 'mean', s.v / o))[0]"""
_DIFFS = "slice(transform({y}, (v, i) -> v - get({y}, i - 1)), 2, size({y}))"
_PAIRS = "slice(transform(y, (v, i) -> named_struct('d', v - get(y, i - 1), 'b', get(y, i - 1) - get(y, i - 2))), 3, size(y))"


def fits(rows: DataFrame, name: str, h: int) -> DataFrame:
    """``rows`` (``y, first, last``) with ``fits``: for each number of values from ``first`` (3 at least) to ``last`` its ``origin``, weights ``a, b, phi``, squared error ``sse``, ``y_hat`` of ``h`` steps and ``sigma``, the deviation of one-step errors."""
    form = FORMS[name]
    t = form.trend
    skip = 2 if t else 1
    if form.line:
        # Each origin has a line of its own, and so values of its own to smooth.
        rows = rows.withColumn("lines", F.expr(f"transform(sequence(first, last), o -> named_struct('o', o, 'line', {_LINE}))"))
        rest = "transform(slice(y, 1, x.o), (v, i) -> 2D * v - (x.line.mean + x.line.slope * (i - (x.o - 1) / 2D)))"
        rows = rows.withColumn("own", F.expr(f"transform(lines, x -> named_struct('o', x.o, 'line', x.line, 'z', {rest}))"))
        rows = rows.withColumn("own", F.expr(f"transform(own, x -> named_struct('o', x.o, 'line', x.line, 'y_last', element_at(x.z, -1), 'w', {_DIFFS.format(y='x.z')}))"))
        rows = rows.withColumn("own", F.expr(f"transform(own, x -> named_struct('o', x.o, 'line', x.line, 'y_last', x.y_last, 'w', x.w, 'best', array_min(transform({_grid(form)}, g -> {_run(t, 'x.w', 'g', _judged(t, 's', 'g'))}))))"))
    else:
        rows = rows.withColumn("w", F.expr(_PAIRS if t else _DIFFS.format(y="y"))).withColumn("best", F.expr(_coarse(form)))
        rows = rows.withColumn("own", F.expr(f"transform(best, (b, i) -> named_struct('o', first + i, 'line', named_struct('slope', 0D, 'mean', 0D), 'y_last', y[first + i - 1], 'w', slice(w, 1, first + i - {skip}), 'best', b))"))
    rows = rows.withColumn("own", F.expr(f"transform(own, x -> named_struct('o', x.o, 'line', x.line, 'y_last', x.y_last, 'w', x.w, 'best', {_refined(form, 'x.w', 'x.best')}))"))
    rows = rows.withColumn("own", F.expr(f"transform(own, x -> named_struct('o', x.o, 'line', x.line, 'y_last', x.y_last, 'w', x.w, 'sse', x.best.sse, 'g', {_weights('x.best.a', 'x.best.b', 'x.best.phi')}))"))
    rows = rows.withColumn("own", F.expr(f"transform(own, x -> named_struct('o', x.o, 'line', x.line, 'y_last', x.y_last, 'w', x.w, 'sse', x.sse, 'g', x.g, 'start', {_first_errors(t, 'x.w', 'x.g')}))"))
    rows = rows.withColumn("own", F.expr(f"transform(own, x -> named_struct('o', x.o, 'line', x.line, 'y_last', x.y_last, 'd_last', {'element_at(x.w, -1).d' if t else '0D'}, 'sse', x.sse, 'g', x.g, 'm', {_errors(t, 'x.w', 'x.g', 'x.start')}))"))
    level = "(x.y_last - (1D - x.g.a) * x.m.e)"
    if t:
        slope = "(x.d_last - x.m.e + (1D - x.g.a) * x.m.e2 + x.g.a * x.g.b * x.m.e)"
        hat = f"transform(sequence(1, {h}), k -> {level} + aggregate(sequence(1, k), 0D, (s, j) -> s + pow(x.g.phi, j)) * {slope})"
    elif form.line:
        hat = f"transform(sequence(1, {h}), k -> 0.5D * {level} + 0.5D * (x.line.mean + x.line.slope * (x.o - 1 + k - (x.o - 1) / 2D)))"
    else:
        hat = f"transform(sequence(1, {h}), k -> {level})"
    sigma = "0.5D * x.m.sigma" if form.line else "x.m.sigma"
    made = f"transform(own, x -> named_struct('origin', x.o, 'a', x.g.a, 'b', x.g.b, 'phi', x.g.phi, 'sse', x.sse, 'y_hat', {hat}, 'sigma', {sigma}))"
    return rows.withColumn("fits", F.expr(made)).drop("w", "best", "lines", "own")


def _several(lists: list[Column]) -> Column:
    """One array of those that are not null."""
    return F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull()))


def smoothed_folds(fit: DataFrame, which: list[T.Candidate], cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Folds (``backtest.FOLD``) of smoothed models where the series' reliable periods admit them (BT2-BT5, PRJ8): one exchange, by series."""
    h = cfg.cv.horizon
    rows, made = whole_series(fit), []
    for c in which:
        least = max(c.min_history, 2)
        open_ = T.admitted(c, F.col("n_rel")) & (F.col("n") - h >= least)
        rows = rows.withColumns({"first": F.when(open_, F.greatest(F.lit(least), F.col("n") - h - cfg.cv.max_origins + 1)), "last": F.when(open_, F.col("n") - h)})
        rows = fits(rows, c.name, h).withColumnRenamed("fits", f"fits_{c.ordinal}")
        made.append(F.expr(f"transform(fits_{c.ordinal}, f -> named_struct('model', '{c.name}', 'ordinal', {c.ordinal}, 'n_params', {c.n_params}, 'origin', f.origin, 'y_hat', f.y_hat))"))
    steps = rows.withColumn("moves", F.expr("slice(transform(y, (v, i) -> abs(v - get(y, i - 1))), 2, n)"))
    one = steps.select("series_id", "y", "valid", "moves", F.explode_outer(_several(made)).alias("f")).where("f IS NOT NULL")  # an inner explode is inferred to have a filter, for which all is computed twice
    scale = F.aggregate(F.slice("moves", 1, F.col("f.origin") - 1), F.lit(0.0), lambda s, v: s + v) / (F.col("f.origin") - 1)
    return one.select("series_id", "f.model", "f.ordinal", "f.n_params", "f.origin", scale.alias("scale"), "f.y_hat", F.slice("y", F.col("f.origin") + 1, h).alias("actual"), F.slice("valid", F.col("f.origin") + 1, h).alias("valid"))


def smoothed_forecasts(fit: DataFrame, chosen: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """``series_id, model, step, point, sigma, grows`` of the chosen smoothed models over the whole history (SEL10); none for a series too short for its model."""
    own = chosen.where(F.col("model").isin(*FORMS)).groupBy("series_id").agg(F.collect_set("model").alias("models"))
    rows, made = whole_series(fit, own), []
    for name in FORMS:
        least, _, grows = T.FITTED[name]
        last = F.when(F.array_contains("models", name) & (F.col("n") >= max(least, 3)), F.col("n"))
        rows = fits(rows.withColumns({"first": last, "last": last}), name, cfg.forecast.horizon).withColumnRenamed("fits", f"fits_{name}")
        made.append(F.expr(f"transform(fits_{name}, f -> named_struct('model', '{name}', 'y_hat', f.y_hat, 'sigma', f.sigma, 'grows', {grows}))"))
    one = rows.select("series_id", F.explode_outer(_several(made)).alias("f")).where("f IS NOT NULL")
    return one.select("series_id", "f.model", "f.sigma", "f.grows", F.posexplode("f.y_hat").alias("at", "point")).select("series_id", "model", (F.col("at") + 1).alias("step"), "point", "sigma", "grows")
