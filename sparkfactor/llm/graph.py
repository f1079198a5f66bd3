"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard
from .common import written


def _least(e: DataFrame, node: str) -> DataFrame:
    other = "b" if node == "a" else "a"
    return e.groupBy(F.col(node).alias("node")).agg(F.min(other).alias("low"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is the least node that can be reached.

    Alternates large-star and small-star steps (Kiveris et al., 2014): every step links neighbours to the least neighbour, so the
    edges end as stars after a number of rounds that grows with the logarithm of the longest path. Each round is written to
    the shared folder; only two numbers a round reach the driver.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, last = written(e, "edges"), None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
        last = now
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _least(both, "a").withColumn("low", F.least("low", "node"))
        large = both.join(low, both.a == low.node).where("b > node").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = _least(large, "a")
        joined = large.join(low, large.a == low.node)
        small = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").union(joined.select("a", F.col("low").alias("b"))).distinct()
        before, e = e, written(small, "edges")
        discard(before)
