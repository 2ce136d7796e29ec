"""Plain versions of what the library does in expressions, to hold it against."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

EXACT = 1e-12


def chi2_tail(x: float, k: float) -> float:
    """P(chi-squared with k degrees of freedom > x): the regularised upper incomplete gamma function, by its series or continued fraction."""
    if x <= 0:
        return 1.0
    a, z = k / 2, x / 2
    scale = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c, d = z + 1 - a, 1e300, 1 / (z + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def context_regression(y: np.ndarray, x: np.ndarray, future: np.ndarray, budget: int, max_vif: float = 5.0) -> dict:
    """Forward selection of regressors by AIC, ``budget`` at most, none that the chosen ones explain; at least one must improve. What is left of an exact fit is rounding, so it counts as a share of ``EXACT`` of the variance, and a fit that good takes no more regressors."""
    n, chosen = len(y), []
    floor = max(EXACT * float(y.var()), 1e-300)

    def solved(cols: list[int]) -> tuple[np.ndarray, float]:
        a = np.column_stack([np.ones(n), *[x[:, c] for c in cols]])
        coef = np.linalg.lstsq(a, y, rcond=None)[0]
        e = y - a @ coef
        return coef, max(float(e @ e) / n, floor)

    rest = solved([])[1]
    now = n * math.log(rest) + 2
    while len(chosen) < budget and rest > floor:
        tried = []
        for c in range(x.shape[1]):
            if c in chosen or x[:, c].std() < 1e-12:
                continue
            if chosen:
                a = np.column_stack([np.ones(n), x[:, chosen]])
                e = x[:, c] - a @ np.linalg.lstsq(a, x[:, c], rcond=None)[0]
                if x[:, c].var() > max_vif * e.var():
                    continue
            left = solved([*chosen, c])[1]
            tried.append((n * math.log(left) + 2 * (len(chosen) + 2), c, left))
        if not tried or min(tried)[0] >= now - 1e-9:
            break
        now, c, rest = min(tried)
        chosen.append(c)
    if not chosen:
        raise ValueError("no condition improves the fit")
    coef = solved(chosen)[0]
    design = lambda z: np.column_stack([np.ones(len(z)), z[:, chosen]])
    return {"ahead": lambda h: (design(future) @ coef)[:h], "fits": design(x) @ coef, "chosen": chosen}


# MacKinnon's (1994) response surface for the p-value of the
# unit-root statistic with a constant and one variable.
_TAU = {"star": -1.61, "min": -18.83, "max": 2.74, "small": (2.1659, 1.4412, 0.038269), "large": (1.7339, 0.93202, -0.12745, -0.010368)}


def adf_p_value(y: np.ndarray) -> float | None:
    """Augmented Dickey-Fuller test with a constant; the lag with the least AIC."""
    n = len(y)
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    if most < 0:
        return None
    dy = np.diff(y)

    def fit(lag: int, skip: int):
        rows = np.arange(skip, len(dy))
        a = np.column_stack([y[rows], *[dy[rows - i] for i in range(1, lag + 1)], np.ones(len(rows))])
        b, *_ = np.linalg.lstsq(a, dy[rows], rcond=None)
        e = dy[rows] - a @ b
        return a, b, e

    best, aic = 0, math.inf
    for lag in range(most + 1):
        a, _, e = fit(lag, most)
        value = len(e) * math.log(max(e @ e / len(e), 1e-300)) + 2 * a.shape[1]
        if value < aic:
            best, aic = lag, value
    a, b, e = fit(best, best)
    free = len(e) - a.shape[1]
    if free <= 0:
        return None
    var = np.linalg.pinv(a.T @ a)[0, 0] * (e @ e) / free
    if var <= 0:
        return None
    tau = b[0] / math.sqrt(var)
    if tau > _TAU["max"]:
        return 1.0
    if tau < _TAU["min"]:
        return 0.0
    coef = _TAU["small"] if tau <= _TAU["star"] else _TAU["large"]
    return NormalDist().cdf(sum(c * tau**i for i, c in enumerate(coef)))
