"""Positions in a global order without one task for all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written

#: Up to so many rows one sorted window is cheaper than a range partitioning.
ONE_WINDOW_ROWS = 2_000_000


def positions(df: DataFrame, order: list[str], name: str = "pos", one_window: int | None = None) -> DataFrame:
    """``df`` with each row's number from 1 in ``order``, which must tell rows apart.

    A large table is dealt by range, sorted within partitions and written; a partition's offset is the number of rows in those before
    it, one number a partition.
    """
    if df.count() <= (ONE_WINDOW_ROWS if one_window is None else one_window):
        return df.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("long"))
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = written(placed.withColumns({"_part": F.shiftright("_id", 33), "_nth": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id"), "positions")
    sizes = sorted((r["_part"], r.n) for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    ends = [0, *accumulate(n for _, n in sizes)]
    before = spark.createDataFrame([(p, ends[i]) for i, (p, _) in enumerate(sizes)], "_part long, _before long")
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_nth") + 1).drop("_part", "_nth", "_before")


def tied_ranks(df: DataFrame, value: str, name: str, within: list[str] | None = None, base: DataFrame | None = None) -> DataFrame:
    """``df`` with average ranks from 1 of ``value`` (within groups).

    ``base``: the same rows in a cheaper plan, to count values in. Without it a chain of k ranks would compute its start 2 ** k times.
    """
    if within:
        rank, same = F.rank().over(W.partitionBy(*within).orderBy(value)), F.count(F.lit(1)).over(W.partitionBy(*within, value))
        return df.withColumn(name, rank + (same - 1) / F.lit(2.0))
    counts = written((df if base is None else base).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "value-counts")
    ranks = _below(counts, ["_v"]).select("_v", (F.col("_below") + (F.col("_n") + 1) / F.lit(2.0)).alias(name))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("_v"))).drop("_v")


def grouped_tied_ranks(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``df`` with average ranks from 1 of ``value`` within few large groups; no group ends in one task."""
    counts = written(df.groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "value-counts")
    starts, before = {}, 0
    for r in sorted(counts.groupBy("_g").agg(F.sum("_n").alias("n")).collect(), key=lambda r: r["_g"]):
        starts[r["_g"]], before = before, before + r.n
    start = F.broadcast(df.sparkSession.createDataFrame(list(starts.items()) or [("", 0)], "_s string, _start long"))
    ranks = _below(counts, ["_g", "_v"]).join(start, F.col("_g") == F.col("_s"))
    ranks = ranks.select("_g", "_v", (F.col("_below") - F.col("_start") + (F.col("_n") + 1) / F.lit(2.0)).alias(name))
    return df.join(ranks, (F.col(group) == F.col("_g")) & F.col(value).eqNullSafe(F.col("_v"))).drop("_g", "_v")


def _below(counts: DataFrame, order: list[str]) -> DataFrame:
    """Adds to written counts (..., _n) ``_below``, the sum of _n over what comes before in ``order``.

    Beyond ``ONE_WINDOW_ROWS`` values by range partitions and one offset a partition.
    """
    w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    if counts.count() <= ONE_WINDOW_ROWS:
        return counts.withColumn("_below", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    placed = written(counts.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "values")
    sizes = sorted((r["_part"], r.n) for r in placed.groupBy("_part").agg(F.sum("_n").alias("n")).collect())
    ends = [0, *accumulate(n for _, n in sizes)]
    before = counts.sparkSession.createDataFrame([(p, ends[i]) for i, (p, _) in enumerate(sizes)], "_part int, _before long")
    within = F.sum("_n").over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return placed.join(F.broadcast(before), "_part").withColumn("_below", F.col("_before") + F.coalesce(within, F.lit(0))).drop("_part", "_before")
