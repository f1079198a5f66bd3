"""One signal from several: weighted sum, average rank or vote."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cross_section import average_ranks, cs_rank
from ..functions.scope import GLOBAL, Scope

COMBINATIONS = ("weighted_sum", "rank_average", "vote")


def combine(df: DataFrame, signals: list[str], how: str, out: str = "f", weights: list[float] | None = None, scope: Scope = GLOBAL) -> DataFrame:
    """``df`` with the combined signal; 0 everywhere if there are no signals."""
    if how not in COMBINATIONS:
        raise ValueError(f"unknown combination {how}")
    if not signals:
        return df.withColumn(out, F.lit(0.0))
    if how == "weighted_sum":
        w = weights or [1.0 / len(signals)] * len(signals)
        return df.withColumn(out, reduce(add, (F.col(s) * float(k) for s, k in zip(signals, w, strict=True))))
    if how == "vote":
        return df.withColumn(out, F.signum(reduce(add, (F.signum(F.col(s)) for s in signals))))
    if scope.kind == "global":
        return average_ranks(df, {s: s for s in signals}, scope, mean=out)
    ranked = df
    for i, s in enumerate(signals):
        ranked = cs_rank(ranked, s, f"__rank{i}", scope)
    total = reduce(add, (F.col(f"__rank{i}") for i in range(len(signals))))
    return ranked.withColumn(out, total / len(signals)).drop(*(f"__rank{i}" for i in range(len(signals))))
