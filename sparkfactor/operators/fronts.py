"""Pareto fronts of (pps high, rre high, complexity low), and the bounded hall of fame that keeps one over arriving batches.

One rule for odd members, in all forms: who has a null, NaN or infinite objective, or a fitness that isn't finite where there is one, takes
no part. Of members with equal objectives the first to arrive counts.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written

#: What tasks leave is put together in one task up to so many members, else by a sweep over a tree of complexities. Both are exact.
ONE_TASK = 200_000
#: A complexity's members are dealt to so many tasks for a first front.
PARTS = 64
OBJECTIVES = ("pps", "rre", "complexity")


def comparable(columns: list[str]) -> Column:
    """Whether a member takes part."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return finite("pps") & finite("rre") & finite("complexity") & (finite("fitness") if "fitness" in columns else F.lit(True))


def unbeaten(members: pa.Table, arrival: list[str]) -> pa.Table:
    """The front of a table: by falling pps a member is kept if no earlier one of its complexity or less reaches its rre."""
    keys = [("pps", "descending"), ("rre", "descending"), ("complexity", "ascending"), *((a, "ascending") for a in arrival)]
    order = pc.sort_indices(members, sort_keys=keys).to_pylist()
    rre, complexity = members.column("rre").to_pylist(), members.column("complexity").to_pylist()
    steps, best, kept = [], [], []  # a staircase: with rising complexity the best rre rises
    for i in order:
        at = bisect_right(steps, complexity[i])
        if at and best[at - 1] >= rre[i]:
            continue
        end = at
        while end < len(best) and best[end] <= rre[i]:
            end += 1
        at -= bool(at and steps[at - 1] == complexity[i])
        steps[at:end], best[at:end] = [complexity[i]], [rre[i]]
        kept.append(i)
    return members.take(pa.array(kept, pa.int64()))


def _local(members: DataFrame, arrival: list[str]) -> DataFrame:
    """The front of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        front = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            front = unbeaten(now if front is None else pa.concat_tables([front, now]), arrival)
        if front is not None:
            yield from front.to_batches()

    return members.mapInArrow(run, members.schema)


def pareto_front(members: DataFrame, *arrival: str, one_task: int = ONE_TASK) -> DataFrame:
    """Members that none dominates; of equal ones the first by the columns ``arrival`` (ind_id).

    Tasks first leave their own fronts. What is left is usually little and goes through one more task; beyond ``one_task`` members a sweep for each
    node of a binary tree over the complexities finds who is dominated, so that no task sees all.
    """
    arrival = list(arrival) or ["ind_id"]
    local = written(_local(members.where(comparable(members.columns)), arrival), "local-fronts")
    return _local(local.coalesce(1), arrival) if local.count() <= one_task else _swept(local, arrival)


def _unbeaten_within(members: DataFrame, *by: str) -> DataFrame:
    """Of each group with one complexity the members that none of it dominates, by running maxima."""
    above = W.partitionBy("complexity", *by).orderBy(F.desc("pps"), F.desc("rre")).rowsBetween(W.unboundedPreceding, -1)
    return members.withColumn("__best", F.max("rre").over(above)).where("__best is null or rre > __best").drop("__best")


def _swept(members: DataFrame, arrival: list[str]) -> DataFrame:
    """A member stands in the nodes of a Fenwick tree above its own complexity and asks those that cover all below it."""
    w = W.partitionBy("pps", "rre", "complexity").orderBy(*arrival)
    first = members.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    parts = _unbeaten_within(first.withColumn("__part", F.pmod(F.xxhash64("pps", "rre"), F.lit(PARTS))), "__part").drop("__part")
    fronts = written(_unbeaten_within(parts), "fronts")
    levels = written(fronts.select("complexity").distinct(), "complexities")
    top = max(1, levels.count())
    place = levels.withColumn("__at", F.row_number().over(W.orderBy("complexity")))
    # up adds the lowest bit, down takes it away
    lowest = lambda x: x.bitwiseAND(-x)
    steps = F.sequence(F.lit(1), F.lit(top.bit_length() + 1))
    up = F.aggregate(steps, F.array("__at"), lambda a, _: F.concat(a, F.array(F.element_at(a, -1) + lowest(F.element_at(a, -1)))))
    down = F.aggregate(steps, F.array(F.col("__at") - 1), lambda a, _: F.concat(a, F.array(F.element_at(a, -1) - lowest(F.element_at(a, -1)))))
    placed = written(fronts.join(place, "complexity").withColumn("__id", F.monotonically_increasing_id()), "placed")
    # a node is cut into ranges of pps; what a range needs of the ones above it is one number, their best rre
    cuts = sorted({r[0] for r in placed.select(F.explode(F.percentile_approx("pps", [k / PARTS for k in range(1, PARTS)], 10_000))).collect()})
    ranged = lambda df: df.withColumn("__range", F.lit(len(cuts)) - F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("pps"))))
    stands = placed.select(F.explode(F.array_distinct(F.filter(up, lambda x: x <= top))).alias("__node"), "pps", "rre", F.lit(None).cast("long").alias("__id"))
    asks = placed.select(F.explode(F.array_distinct(F.filter(down, lambda x: x > 0))).alias("__node"), "pps", "rre", "__id")
    seen = written(ranged(stands.union(asks)), "asked-nodes")
    best = seen.where("__id is null").groupBy("__node", "__range").agg(F.max("rre").alias("__own"))
    above = W.partitionBy("__node").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    ranges = seen.select("__node", "__range").distinct().join(best, ["__node", "__range"], "left").withColumn("__above", F.max("__own").over(above)).drop("__own")
    over = W.partitionBy("__node", "__range").orderBy(F.desc("pps")).rangeBetween(W.unboundedPreceding, W.currentRow)
    within = seen.withColumn("__best", F.max(F.when(F.col("__id").isNull(), F.col("rre"))).over(over)).where("__id is not null")
    beaten = within.join(ranges, ["__node", "__range"]).where(F.greatest("__best", "__above") >= F.col("rre")).select("__id").distinct()
    return placed.join(beaten, "__id", "left_anti").select(*members.columns)


def trimmed(pps: np.ndarray, rre: np.ndarray, complexity: np.ndarray, size: int) -> np.ndarray:
    """The places, in order, of the ``size`` members left when of the closest pair the one of lower pps goes, again and again.

    Each member holds its nearest one among those behind it in a heap; an entry whose partner has gone is made anew when it comes up.
    Ties go to the first pair in order, and in it with equal pps the first member goes.
    """
    p, r, c = (np.asarray(v, float) for v in (pps, rre, complexity))
    alive, left, heap = np.ones(len(p), bool), len(p), []

    def push(i: int) -> None:
        others = i + 1 + np.flatnonzero(alive[i + 1 :])
        if len(others):
            d = (p[others] - p[i]) ** 2 + (r[others] - r[i]) ** 2 + ((c[others] - c[i]) / np.maximum(np.maximum(c[others], c[i]), 1)) ** 2
            j = int(np.argmin(d))
            heapq.heappush(heap, (float(d[j]), i, int(others[j])))

    if left > size:
        for i in range(len(p)):
            push(i)
    while left > size:
        _, i, j = heapq.heappop(heap)
        if not alive[i]:
            continue
        if not alive[j]:
            push(i)
            continue
        gone = i if p[i] <= p[j] else j
        alive[gone] = False
        left -= 1
        if gone == j:
            push(i)
    return np.flatnonzero(alive)


def trim(front: DataFrame, size: int, *order: str) -> DataFrame:
    """``front`` cut to ``size`` members by ``trimmed`` in ``order``, with ``place`` numbered anew; one task, as a front is what a bounded hall and one batch leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held).sort_by([(o, "ascending") for o in order])
            table = table.take(pa.array(trimmed(*(table.column(o).to_numpy() for o in OBJECTIVES), size)))
            yield from table.set_column(table.column_names.index("place"), "place", pa.array(range(1, len(table) + 1), pa.int64())).to_batches()

    return front.coalesce(1).mapInArrow(run, front.schema)


def hall_of_fame(members: DataFrame, size: int, batch: str = "batch", arrival: str = "ind_id") -> DataFrame:
    """The hall after all batches, with each member's ``place`` in the order of admission from 1.

    A batch joins the hall as a whole: the front of both, in which the hall's members come first and newcomers follow by arrival, is trimmed to
    ``size`` once. So a newcomer that is trimmed has still removed what it dominates.
    """
    batches = [r[0] for r in members.select(batch).distinct().orderBy(batch).collect()]
    hall = members.limit(0).withColumns({"place": F.lit(0).cast("long"), "__new": F.lit(0)})
    for b in batches:
        newcomers = members.where(F.col(batch) == b).withColumns({"place": F.lit(0).cast("long"), "__new": F.lit(1)})
        order = ["__new", "place", arrival]
        hall = written(trim(pareto_front(hall.unionByName(newcomers), *order), size, *order).withColumn("__new", F.lit(0)), "hall")
    return hall.drop("__new")
