"""Scores of a signal against a target, as aggregates.

A correlation is covariance over standard deviations with a guard, never ``corr``: a constant side, or one that holds NaN or an
infinite value, gives 0, as in the kernels. Ranks count NaN as the largest value. What a metric reads twice is written once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import grouped_tied_ranks, positions, tied_ranks
from ..sources.shared import written

LEAST_SD = 1e-8


def guarded_corr(f: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; 0 where a side hardly varies or there are fewer than two rows."""
    sf, sy = F.coalesce(F.stddev_samp(f), F.lit(0.0)), F.coalesce(F.stddev_samp(y), F.lit(0.0))
    value = F.covar_samp(f, y) / (sf * sy)
    odd = F.isnan(sf) | F.isnan(sy) | (F.greatest(sf, sy) == float("inf"))
    return F.when((sf < LEAST_SD) | (sy < LEAST_SD) | odd, F.lit(0.0)).otherwise(F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)))


def ic(df: DataFrame, f: str = "f", y: str = "y") -> DataFrame:
    return df.agg(guarded_corr(F.col(f), F.col(y)).alias("ic"))


def _ranked(df: DataFrame, f: str, y: str) -> DataFrame:
    own = written(df.select(f, y), "signal")
    return tied_ranks(tied_ranks(own, f, "_rf"), y, "_ry", base=own)


def rank_ic(df: DataFrame, f: str = "f", y: str = "y") -> DataFrame:
    return _ranked(df, f, y).agg(guarded_corr(F.col("_rf"), F.col("_ry")).alias("rank_ic"))


def rre_bins(rank_share: Column, n_bins: int) -> Column:
    return F.least(F.ceil(rank_share * n_bins), F.lit(n_bins))


def rre(df: DataFrame, f: str = "f", n_bins: int = 10) -> DataFrame:
    """1 less the relative entropy of the tied ranks' bins; 0 with fewer rows than bins."""
    own = written(df.select(f), "signal")
    ranked = tied_ranks(own, f, "_rf")
    n = own.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = ranked.groupBy(rre_bins(F.col("_rf") / n, n_bins).alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
    total = F.sum("_c")
    p = F.col("_c") / F.lit(1.0)
    # sum of p ln p with p = c / n, from sums over c alone
    entropy = F.sum(p * F.log(p)) / total - F.log(total)
    return counts.agg(F.when(F.coalesce(total, F.lit(0)) < n_bins, F.lit(0.0)).otherwise(1.0 + entropy / math.log(n_bins)).alias("rre"))


def pps(df: DataFrame, f: str = "f", y: str = "y", beta: float = 0.3) -> DataFrame:
    """ic, rank_ic and their mixture in one row."""
    both = _ranked(df, f, y).agg(guarded_corr(F.col(f), F.col(y)).alias("ic"), guarded_corr(F.col("_rf"), F.col("_ry")).alias("rank_ic"))
    return both.withColumn("pps", beta * F.col("ic") + (1 - beta) * F.col("rank_ic"))


def periods(df: DataFrame, n_periods: int, order: str = "row_id", remainder: bool = False) -> DataFrame:
    """Adds ``period``: equal blocks of consecutive rows from 0. The rows behind the last block are dropped, or with ``remainder`` join it."""
    n = df.count()
    size = n // n_periods if n_periods else 0
    if size < 1:
        return df.withColumn("period", F.lit(0).cast("long")).where(F.lit(False))
    placed = positions(df, [order], "_pos").withColumn("period", F.floor((F.col("_pos") - 1) / size)).drop("_pos")
    return placed.withColumn("period", F.least("period", F.lit(n_periods - 1))) if remainder else placed.where(F.col("period") < n_periods)


def rolling_rank_ic(df: DataFrame, n_periods: int, f: str = "f", y: str = "y", order: str = "row_id") -> DataFrame:
    """(period, rank_ic), ranked anew in every period; no rows with fewer than two periods or two rows a period."""
    df = written(df.select(order, f, y), "signal")
    if n_periods < 2 or df.count() // n_periods < 2:
        return df.limit(0).select(F.lit(0).cast("long").alias("period"), F.lit(0.0).alias("rank_ic"))
    cut = written(periods(df, n_periods, order).select(F.col("period").cast("string").alias("period"), f, y), "periods")
    ranked = grouped_tied_ranks(grouped_tied_ranks(cut, "period", f, "_rf"), "period", y, "_ry")
    return ranked.groupBy(F.col("period").cast("long").alias("period")).agg(guarded_corr(F.col("_rf"), F.col("_ry")).alias("rank_ic"))


def icir(df: DataFrame, n_periods: int, f: str = "f", y: str = "y", order: str = "row_id") -> DataFrame:
    """Mean over standard deviation of the periods' rank correlations; 0 where that hardly varies."""
    sd = F.coalesce(F.stddev_samp("rank_ic"), F.lit(0.0))
    return rolling_rank_ic(df, n_periods, f, y, order).agg(F.when(sd < LEAST_SD, 0.0).otherwise(F.avg("rank_ic") / sd).alias("icir"))


def error_matrix(df: DataFrame, signals: list[str], n_periods: int, y: str = "y", order: str = "row_id") -> DataFrame:
    """(signal, period, err): mean absolute error by period; the last period takes the remaining rows."""
    cut = periods(df, min(n_periods, max(1, df.count())), order, remainder=True)
    long = cut.select("period", y, F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).alias("v")) for s in signals))).alias("s"))
    return long.groupBy(F.col("s.signal").alias("signal"), "period").agg(F.avg(F.abs(F.col("s.v") - F.col(y))).alias("err"))


def normal_draw(key: Column) -> Column:
    """A standard normal draw (Box and Muller) that hangs on ``key`` alone, not on how rows are dealt: from two halves of its MD5."""
    u = [(F.conv(F.substring(F.md5(key.cast("binary")), at, 13), 16, 10).cast("double") + 0.5) / float(1 << 52) for at in (1, 14)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])


def pfs(panel: DataFrame, tree, features: list[str], scope, n_copies: int = 5, noise: float = 0.01, seed: int = 42) -> DataFrame:
    """Mean rank correlation of a signal with itself on noisy copies of the features; noise follows each feature's spread.

    The copies are made side by side as columns of one table, so the signal and its copies share one pass of windows.
    """
    from ..plans.compiler import compile_forest
    from ..plans.ir import Node

    if scope.kind == "global":
        # one individual of a population: blocks of rows, ranked by ranges of values
        from .evaluation import population_steadiness
        from .genetic import Individual

        own = [Individual((tree,), (1.0,), "weighted_sum")]
        return population_steadiness(panel, own, features, scope.order, n_copies, noise, seed).select("pfs")
    used = sorted(tree.features())
    spread = panel.agg(*(F.greatest(F.coalesce(F.stddev_samp(features[k - 1]), F.lit(0.0)), F.lit(LEAST_SD)).alias(f"s{k}") for k in used)).first() if used else {}
    noisy, names, trees = panel, list(features), {"_s0": tree}
    for copy in range(n_copies):
        moved = {}
        for k in used:
            name = f"_x{k}_{copy}"
            normal = normal_draw(F.concat_ws("-", F.lit(seed), F.lit(copy), F.lit(k), F.col(scope.order)))
            noisy = noisy.withColumn(name, F.col(features[k - 1]) + normal * noise * spread[f"s{k}"])
            names.append(name)
            moved[k] = len(names)

        def put(n: Node, moved=moved) -> Node:
            return Node(n.op, tuple(map(put, n.children)), n.window, moved.get(n.feature), n.value)

        trees[f"_s{copy + 1}"] = put(tree)
    wide = written(compile_forest(noisy, trees, names, scope).select(scope.order, *trees), "noisy-signals")
    long = wide.select(scope.order, F.explode(F.array(*(F.struct(F.lit(s).alias("name"), F.col(s).alias("v")) for s in trees))).alias("s")).select(scope.order, "s.*")
    # all signals are ranked in one pass
    by_row = grouped_tied_ranks(long, "name", "v", "r").groupBy(scope.order)
    out = by_row.agg(*(F.max(F.when(F.col("name") == s, F.col("r"))).alias(f"{s}_r") for s in trees), F.max(F.when(F.col("name") == "_s0", F.col("v"))).alias("_s0"))
    scores = [guarded_corr(F.col("_s0_r"), F.col(f"_s{c + 1}_r")) for c in range(n_copies)]
    flat = F.coalesce(F.stddev_samp("_s0"), F.lit(0.0)) < LEAST_SD
    return out.agg(F.when(flat, 0.0).otherwise(sum(F.when(F.isnan(s), 0.0).otherwise(s) for s in scores) / n_copies).alias("pfs"))
