"""Rolling operators as Columns over the last ``d`` rows of a series. Rows before the first full window are 0, never null."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scope import Scope

#: ``ts_rank`` and ``decay`` take a lag column for each row of the window up to this window; wider ones run by their kernels.
MOST_LAGS = 32


def _full(scope: Scope, d: int, value: Column) -> Column:
    return F.when(scope.number() >= d, value).otherwise(F.lit(0.0))


def ts_delta(v: Column, d: int, scope: Scope) -> Column:
    return F.coalesce(v - F.lag(v, d).over(scope.window()), F.lit(0.0))


def ts_mean(v: Column, d: int, scope: Scope) -> Column:
    return _full(scope, d, F.avg(v).over(scope.frame(d)))


def ts_sum(v: Column, d: int, scope: Scope) -> Column:
    return _full(scope, d, F.sum(v).over(scope.frame(d)))


def ts_max(v: Column, d: int, scope: Scope) -> Column:
    return _full(scope, d, F.max(v).over(scope.frame(d)))


def ts_min(v: Column, d: int, scope: Scope) -> Column:
    return _full(scope, d, F.min(v).over(scope.frame(d)))


def ts_stddev(v: Column, d: int, scope: Scope) -> Column:
    if d < 2:
        return F.lit(0.0)
    var = F.var_samp(v).over(scope.frame(d))
    return F.when((scope.number() < d) | (var < 1e-12), 0.0).otherwise(F.sqrt(var))


def ts_rank(v: Column, d: int, scope: Scope) -> Column:
    """The share of the window that isn't above the current value."""
    below = reduce(add, (F.when(F.lag(v, k).over(scope.window()) <= v, 1.0).otherwise(0.0) for k in range(1, d)), F.lit(1.0))
    return _full(scope, d, below / F.lit(float(d)))


def decay(v: Column, d: int, scope: Scope) -> Column:
    """Linearly weighted mean; the newest row weighs d."""
    total = reduce(add, (F.lag(v, k).over(scope.window()) * float(d - k) for k in range(1, d)), v * float(d))
    return F.coalesce(total / F.lit(d * (d + 1) / 2.0), F.lit(0.0))


def ts_corr(a: Column, b: Column, d: int, scope: Scope) -> Column:
    if d < 2:
        return F.lit(0.0)
    f = scope.frame(d)
    norm = F.sqrt(F.var_pop(a).over(f) * d * F.var_pop(b).over(f) * d)
    return F.when((scope.number() < d) | (norm < 1e-8), 0.0).otherwise(F.covar_pop(a, b).over(f) * d / norm)


def ts_cov(a: Column, b: Column, d: int, scope: Scope) -> Column:
    if d < 2:
        return F.lit(0.0)
    return _full(scope, d, F.covar_samp(a, b).over(scope.frame(d)))
