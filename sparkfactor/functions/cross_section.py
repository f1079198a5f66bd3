"""Cross-sectional operators. They take a column's name, because all but the panel forms need an aggregate of the whole table.

Aggregates of a global cross-section are scalar subqueries, so rows stay where they are; ranks are joined by ``row_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written
from .ranking import positions
from .scope import HALO, Scope


def _aggregate(df: DataFrame, scope: Scope, expr: Column) -> Column:
    """An aggregate over each row's cross-section."""
    if scope.kind == "panel":
        return expr.over(W.partitionBy(scope.date))
    return df.where(~F.col(HALO)).agg(expr.alias("a")).scalar()


def _moments(df: DataFrame, v: str, scope: Scope) -> tuple[Column, Column]:
    return _aggregate(df, scope, F.avg(v)), F.coalesce(_aggregate(df, scope, F.stddev_samp(v)), F.lit(0.0))


def cs_rank(df: DataFrame, v: str, out: str, scope: Scope) -> DataFrame:
    """Position / n in ascending order; ties go by row order."""
    if scope.kind == "panel":
        w = W.partitionBy(scope.date)
        return df.withColumn(out, F.row_number().over(w.orderBy(v, scope.order)) / F.count(F.lit(1)).over(w))
    n, copies = df.agg(F.count(F.lit(1)), F.count(F.when(F.col(HALO), 1))).first() if HALO in df.columns else (df.count(), 0)
    if copies:
        return average_ranks(df, {v: out}, scope)
    # no row stands twice, so rows are numbered where they are
    return positions(df, [v, scope.order], "_pos").withColumn(out, F.col("_pos") / F.lit(n)).drop("_pos")


def average_ranks(df: DataFrame, signals: dict[str, str], scope: Scope, mean: str | None = None) -> DataFrame:
    """Global cross-sectional ranks of several columns (column: name of its rank), or with ``mean`` only their average.

    ``df`` is written once; all columns are ranked in one pass over (column, value) and joined back once.
    """
    held = written(df, "signals")
    rows = held.where(~F.col(HALO)) if HALO in held.columns else held
    long = rows.select(F.col(scope.order).alias("_row"), F.posexplode(F.array(*(F.col(s).cast("double") for s in signals))).alias("_k", "_v"))
    n = rows.count()
    share = (F.col("_pos") - F.col("_k") * n) / n
    placed = positions(long, ["_k", "_v", "_row"], "_pos").groupBy("_row")
    if mean:
        ranked = placed.agg((F.sum(share) / F.lit(len(signals))).alias(mean))
    else:
        ranked = placed.agg(*(F.max(F.when(F.col("_k") == k, share)).alias(out) for k, out in enumerate(signals.values())))
    return held.join(ranked, F.col(scope.order) == F.col("_row")).drop("_row")


def cs_zscore(df: DataFrame, v: str, out: str, scope: Scope) -> DataFrame:
    mean, sd = _moments(df, v, scope)
    return df.withColumns({"__cs_m": mean, "__cs_s": sd}).withColumn(out, F.when(F.col("__cs_s") < 1e-8, 0.0).otherwise((F.col(v) - F.col("__cs_m")) / F.col("__cs_s"))).drop("__cs_m", "__cs_s")


def cs_scale(df: DataFrame, v: str, out: str, scope: Scope) -> DataFrame:
    total = _aggregate(df, scope, F.sum(F.abs(F.col(v))))
    return df.withColumn("__cs_s", total).withColumn(out, F.when(F.col("__cs_s") < 1e-8, F.col(v)).otherwise(F.col(v) / F.col("__cs_s"))).drop("__cs_s")


def cs_winsorize(df: DataFrame, v: str, out: str, scope: Scope) -> DataFrame:
    mean, sd = _moments(df, v, scope)
    held = F.when(F.isnan(v), F.col(v)).otherwise(F.greatest(F.col("__cs_m") - 3 * F.col("__cs_s"), F.least(F.col(v), F.col("__cs_m") + 3 * F.col("__cs_s"))))
    return df.withColumns({"__cs_m": mean, "__cs_s": sd}).withColumn(out, F.when(F.col("__cs_s") < 1e-8, F.col(v)).otherwise(held)).drop("__cs_m", "__cs_s")
