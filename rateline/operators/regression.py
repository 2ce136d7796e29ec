"""Least squares inside expressions: matrices of cross products, and regressors swept in one after the other (PAT4, MOD23, CTX11), with no Python in the plan.

A matrix of cross products holds all that least squares needs. Sweeping a
column in turns it into the matrix of what is left once that column explains
what it can: below the last column then stand the coefficients, in its corner
the squared error, and on the diagonal, with a minus, the inverse. So the best
of many regressors is found by looking at one matrix, and taking it in costs
one pass over it.

Expressions are SQL texts; ``let`` names a value, so that it is made once even
where it is read in an inner function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import normal_cdf
from ..staging import dealt

#: Share of a column's own products under which what is left of it counts as explained by others.
EXPLAINED = 1e-11
#: Share of the variance below which a fit is exact.
EXACT = 1e-12
#: MacKinnon's (1994) response surface for the p-value of the unit-root statistic with a constant and one variable.
TAU_STAR, TAU_MIN, TAU_MAX = -1.61, -18.83, 2.74
TAU_SMALL, TAU_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def products(vectors: str, size: str) -> str:
    """Sums of the products of all pairs of entries, over vectors of ``size`` entries."""
    zero = f"array_repeat(array_repeat(0D, {size}), {size})"
    return f"aggregate({vectors}, {zero}, (gm, gv) -> zip_with(gm, gv, (gr, ga) -> zip_with(gr, gv, (gx, gb) -> gx + ga * gb)))"


def swept(matrix: str, k: str, least: str = "0D") -> str:
    """``matrix`` with column ``k`` swept in; as it is, if no more than ``least`` is left of that column."""
    cell = "CASE WHEN si = sw.k AND sj = sw.k THEN -1D / sx WHEN sj = sw.k OR si = sw.k THEN sx / sw.m[sw.k][sw.k] ELSE sx - sr[sw.k] * sw.m[sw.k][sj] / sw.m[sw.k][sw.k] END"
    return let("sw", f"named_struct('m', {matrix}, 'k', {k}, 'least', {least})", f"if(abs(sw.m[sw.k][sw.k]) <= sw.least, sw.m, transform(sw.m, (sr, si) -> transform(sr, (sx, sj) -> {cell})))")


def _lagged(lag: str, r: str) -> str:
    """One row of the unit-root regression: constant, the value before, ``lag`` differences before, and the difference."""
    return f"concat(array(1D, z[{r}]), reverse(slice(dz, {r} - {lag} + 1, {lag})), array(dz[{r}]))"


def unit_root(values: DataFrame, lag: int | None = None) -> DataFrame:
    """``series_id, lag, tau, p_value`` of the augmented Dickey-Fuller test with a constant (PAT4).

    ``values`` has ``series_id, y``, an array in order without nulls. Without
    ``lag``, that of the least AIC over a common sample, of at most
    ``12 (n / 100)^0.25``. Null where too few values are left, or nothing varies.
    """
    most = "least(cast(ceil(12 * pow(n / 100D, 0.25D)) AS INT), n div 2 - 2)" if lag is None else f"if(n >= {2 * lag + 4}, {lag}, -1)"
    rows = dealt(values.select("series_id", F.col("y"), F.size("y").alias("n"), F.expr("transform(y, v -> v - aggregate(y, 0D, (s, x) -> s + x) / size(y))").alias("z")))
    rows = rows.withColumn("most", F.expr(f"cast({most} AS INT)")).where("most >= 0 AND array_max(y) > array_min(y)").withColumn("dz", F.expr("slice(transform(z, (v, i) -> v - get(z, i - 1)), 2, size(z))"))
    if lag is None:
        # The corner after each lag is swept in gives its AIC; the first least one is taken.
        n_rows = "(n - 1 - most)"
        all_rows = f"transform(sequence(most, n - 2), r -> {_lagged('most', 'r')})"
        both = swept(swept("g", "0"), "1", f"{EXPLAINED!r}D * g[1][1]")
        aic = f"({n_rows} * ln(greatest(u.m[most + 2][most + 2] / {n_rows}, 1e-300D)) + 2D * (l + 2))"
        pick = f"named_struct('m', if(l < most, {swept('u.m', 'least(l + 2, most + 1)', f'{EXPLAINED!r}D * g[least(l + 2, most + 1)][least(l + 2, most + 1)]')}, u.m), 'best', if(a < u.aic, l, u.best), 'aic', least(a, u.aic))"
        chosen = f"aggregate(sequence(0, most), named_struct('m', {both}, 'best', 0, 'aic', double('infinity')), (u, l) -> {let('a', aic, pick)}, u -> u.best)"
        rows = rows.withColumn("lag", F.expr(let("g", products(all_rows, "most + 3"), chosen)))
    else:
        rows = rows.withColumn("lag", F.col("most"))
    rows = rows.withColumn("lag", F.col("lag").cast("int"))
    every = f"transform(sequence(lag, n - 2), r -> {_lagged('lag', 'r')})"
    fit = f"aggregate(sequence(0, lag + 1), g, (m, k) -> {swept('m', 'k', f'{EXPLAINED!r}D * g[k][k]')})"
    free = "(n - 1 - lag - (lag + 2))"
    tau = f"if({free} > 0 AND m[1][1] < 0 AND m[lag + 2][lag + 2] > 0, m[1][lag + 2] / sqrt(-m[1][1] * m[lag + 2][lag + 2] / {free}), NULL)"
    rows = rows.withColumn("tau", F.expr(let("g", products(every, "lag + 3"), let("m", fit, tau))))
    tau_ = F.col("tau")
    power = lambda coef: sum((F.lit(c) * F.pow(tau_, F.lit(float(i))) for i, c in enumerate(coef)), F.lit(0.0))
    p = F.when(tau_ > TAU_MAX, 1.0).when(tau_ < TAU_MIN, 0.0).otherwise(normal_cdf(F.when(tau_ <= TAU_STAR, power(TAU_SMALL)).otherwise(power(TAU_LARGE))))
    return rows.select("series_id", "lag", "tau", F.when(tau_.isNotNull(), p).alias("p_value"))


def _forward(n: str, budget: str, max_vif: float) -> str:
    """Forward selection on ``g``, the cross products of constant, regressors and target with the constant swept in: struct(m, chosen).

    Each step takes in the regressor of the least AIC, if that improves by more
    than rounding. One that hardly varies, or of which the chosen ones explain
    all but ``1 / max_vif``, is passed over. What is left of an exact fit counts
    as a share of ``EXACT`` of the variance, and takes no more regressors.
    """
    p = "(size(g) - 2)"
    end = "size(g) - 1"
    floor = f"greatest({EXACT!r}D * g[{end}][{end}] / {n}, 1e-300D)"
    left = f"greatest((f.m[{end}][{end}] - f.m[c][{end}] * f.m[c][{end}] / f.m[c][c]) / {n}, {floor})"
    ok = f"NOT array_contains(f.chosen, c) AND g[c][c] > 1e-24D * {n} AND f.m[c][c] > 0 AND (size(f.chosen) = 0 OR g[c][c] <= {max_vif!r}D * f.m[c][c])"
    tried = f"filter(transform(sequence(1, {p}), c -> if({ok}, named_struct('aic', {n} * ln({left}) + 2D * (size(f.chosen) + 2), 'c', c), NULL)), x -> x IS NOT NULL)"
    more = f"size(f.chosen) < {budget} AND greatest(f.m[{end}][{end}] / {n}, {floor}) > {floor}"
    take = f"if(b IS NULL OR b.aic >= f.now - 1e-9D, f, named_struct('m', {swept('f.m', 'b.c')}, 'chosen', concat(f.chosen, array(b.c)), 'now', b.aic))"
    first = f"named_struct('m', g, 'chosen', cast(array() AS ARRAY<INT>), 'now', {n} * ln(greatest(g[{end}][{end}] / {n}, {floor})) + 2D)"
    return f"aggregate(sequence(1, {p}), {first}, (f, step) -> if({more}, {let('b', f'array_min({tried})', take)}, f))"


def condition_arrays(ext: DataFrame, names: list[str]) -> DataFrame:
    """``series_id, past, future, use``: rows in order (``idx, y, valid, x``), and the places in ``x`` of the conditions that are complete over history and horizon and vary (CTX11); no series without any."""
    x = F.array(*[F.col(c).cast("double") for c in names])
    rows = ext.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("idx", "ahead", F.col("y").cast("double").alias("y"), F.col("valid").cast("int").alias("valid"), x.alias("x")))).alias("r"))
    rows = dealt(rows).select("series_id", F.expr("filter(r, e -> e.ahead = 0)").alias("past"), F.expr("filter(r, e -> e.ahead > 0)").alias("future"), "r")
    whole = "forall(r, e -> e.x[j] IS NOT NULL AND NOT isnan(e.x[j]) AND abs(e.x[j]) < double('infinity'))"
    moved = "aggregate(transform(past, e -> e.x[j]), named_struct('s', 0D, 'ss', 0D), (a, v) -> named_struct('s', a.s + (v - past[0].x[j]), 'ss', a.ss + (v - past[0].x[j]) * (v - past[0].x[j])), a -> a.ss / size(past) - (a.s / size(past)) * (a.s / size(past)))"
    use = f"filter(sequence(0, {len(names) - 1}), j -> size(past) > 0 AND {whole} AND {moved} > 1e-24D)"
    return rows.withColumn("use", F.expr(use)).where(F.size("use") > 0).select("series_id", "past", "future", "use")


def _row(e: str) -> str:
    """Constant and usable conditions, in terms of the first row's."""
    return f"concat(array(1D), transform(use, j -> {e}.x[j] - past[0].x[j]))"


def regressed(rows: DataFrame, tell: str, per: int, max_vif: float) -> DataFrame:
    """``rows`` (``past, use, origin``) with ``told``: ``y_hat`` of each row of the array ``tell``, ``sigma`` (population deviation over the rows it was fitted on) and ``chosen`` (places among ``use``, from 1), from the first ``origin`` rows of ``past``; null where no regressor improves the fit."""
    vectors = f"transform(slice(past, 1, origin), e -> concat({_row('e')}, array(e.y - past[0].y)))"
    fitted = let("g0", products(vectors, "size(use) + 2"), let("g", swept("g0", "0"), _forward("cast(origin AS DOUBLE)", f"greatest(1, origin div {per})", max_vif)))
    value = lambda e: f"past[0].y + aggregate(transform(concat(array(0), f.chosen), c -> f.m[c][size(f.m) - 1] * {_row(e)}[c]), 0D, (s, v) -> s + v)"
    missed = f"transform(slice(past, 1, origin), e -> e.y - ({value('e')}))"
    sigma = let("u", missed, "sqrt(greatest(aggregate(u, 0D, (s, v) -> s + v * v) / size(u) - pow(aggregate(u, 0D, (s, v) -> s + v) / size(u), 2), 0D))")
    told = f"if(size(f.chosen) = 0, NULL, named_struct('y_hat', transform({tell}, t -> {value('t')}), 'sigma', {sigma}, 'chosen', f.chosen))"
    return rows.withColumn("told", F.expr(let("f", fitted, told)))


def stationary(p_value: Column) -> Column:
    return (p_value < 0.05).cast("int")
