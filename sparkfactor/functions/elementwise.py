"""Element-wise operators as Columns. None can fail or return null on doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what keeps denominators and arguments away from zero.
EPS = 1e-6


def clamp(x: Column, lo: float, hi: float) -> Column:
    """x held to [lo, hi]; NaN stays NaN."""
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(lo), F.least(x, F.lit(hi))))


def safe_sqrt(x: Column) -> Column:
    return F.sqrt(F.abs(x) + EPS)


def safe_log(x: Column) -> Column:
    return F.log(F.abs(x) + EPS)


def safe_inv(x: Column) -> Column:
    return F.lit(1.0) / (F.abs(x) + EPS)


def safe_neg(x: Column) -> Column:
    return -x


def safe_sin(x: Column) -> Column:
    return F.sin(clamp(x, -1e4, 1e4))


def safe_cos(x: Column) -> Column:
    return F.cos(clamp(x, -1e4, 1e4))


def safe_tan(x: Column) -> Column:
    return F.tan(clamp(x, -1.5, 1.5))


def safe_tanh(x: Column) -> Column:
    return F.tanh(x)


def absolute(x: Column) -> Column:
    return F.abs(x)


def safe_add(x: Column, y: Column) -> Column:
    return x + y


def safe_sub(x: Column, y: Column) -> Column:
    return x - y


def safe_mul(x: Column, y: Column) -> Column:
    return x * y


def safe_div(x: Column, y: Column) -> Column:
    return x / (F.abs(y) + EPS)


def safe_pow(x: Column, y: Column) -> Column:
    return F.pow(F.abs(x), clamp(y, -5.0, 5.0))


def signed_power(x: Column, y: Column) -> Column:
    return F.signum(x) * F.pow(F.abs(x), clamp(y, -5.0, 5.0))


def half_up(x: Column | str, digits: int) -> Column:
    """x rounded to ``digits`` as SQL engines on binary doubles do it: by its product with a power of ten, halves away from zero.

    ``F.round`` goes by the shortest decimal form, which gives another last digit where the product is a half and the decimal isn't, or the other way round.
    """
    x = F.col(x) if isinstance(x, str) else x
    held = F.abs(x) * float(10**digits)
    # larger products have no fraction, and no place in a long
    whole = F.when(held < float(1 << 52), F.floor(held) + F.when(held - F.floor(held) >= 0.5, 1).otherwise(0)).otherwise(held)
    out = F.signum(x) * whole / float(10**digits)
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), x).otherwise(out)
