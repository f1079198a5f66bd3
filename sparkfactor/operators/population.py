"""Relational operators over populations: fitness, fingerprints, selection, islands and migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import positions
from ..sources.shared import discard, written



def fitness(weights, novelty_weight: float, parsimony: float) -> Column:
    """Fitness of members (pps, rre, pfs, novelty, complexity) as a column; minus infinity where it isn't finite."""
    value = weights.pps * F.col("pps") + weights.rre * F.col("rre") + weights.pfs * F.col("pfs") + novelty_weight * F.col("novelty") - parsimony * F.col("complexity")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")) | value.isNull(), F.lit(float("-inf"))).otherwise(value)


def novelty_weight(generation: Column, weight: float, n_generations: int) -> Column:
    """The novelty bonus's weight as a column: constant up to three quarters of the run, then linear to 0."""
    start = int(0.75 * n_generations)
    left = F.greatest(F.lit(0.0), 1 - (generation - start) / F.lit(float(max(1, n_generations - start))))
    return F.when(generation <= start, F.lit(weight)).otherwise(weight * left)


def fingerprint_rows(panel: DataFrame, size: int, order: str = "row_id") -> DataFrame:
    """The ``size`` rows (place from 0, order) of least MD5 of their number: the fixed rows that all fingerprints are taken on."""
    chosen = panel.select(order, F.md5(F.col(order).cast("string").cast("binary")).alias("__m")).orderBy("__m").limit(size)
    return chosen.select((F.row_number().over(W.orderBy("__m")) - 1).alias("place"), order)


def fingerprints(signals: DataFrame, names: list[str], rows: DataFrame, order: str = "row_id") -> DataFrame:
    """(ind_id, behavior): each signal's values on the fixed rows, in their order, as float."""
    held = signals.join(F.broadcast(rows), order).select("place", F.explode(F.array(*(F.struct(F.lit(n).alias("ind_id"), F.col(n).cast("float").alias("v")) for n in names))).alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "s.v")))
    return held.groupBy("s.ind_id").agg(F.transform(ordered, lambda x: x["v"]).alias("behavior"))


def tournament(pool: DataFrame, draws: DataFrame) -> DataFrame:
    """The fittest of each slot's draws (slot, draw, ind_id), the first drawn of equals: (slot, ind_id, fitness)."""
    best = F.max_by(F.struct(F.col("ind_id"), F.col("fitness")), F.struct("fitness", -F.col("draw")))
    return draws.join(pool.select("ind_id", "fitness"), "ind_id").groupBy("slot").agg(best.alias("b")).select("slot", "b.ind_id", "b.fitness")


def lexicase_survivors(errors: Column, order: Column, epsilon: float) -> Column:
    """For bounded pools. From an array of (ind_id, e) structs, those left after each period of ``order``: error up to the least one plus epsilon."""
    return F.aggregate(
        order,
        errors,
        lambda left, k: F.filter(left, lambda x: F.get(x["e"], k) <= F.array_min(F.transform(left, lambda y: F.get(y["e"], k))) + epsilon),
    )


def lexicase(pool: DataFrame, orders: list[list[str]], epsilon: float, ind_id: str = "ind_id") -> DataFrame:
    """(slot, ind_id): of a pool of any size, those left after each slot's error columns in order, as by ``lexicase_survivors``.

    Each step takes the slots' least errors by one aggregate over the pool; only these, one for each slot, reach the driver.
    """
    left = [F.lit(True) for _ in orders]
    for k in range(max(map(len, orders), default=0)):
        now = [s for s, order in enumerate(orders) if k < len(order)]
        least = pool.agg(*(F.min(F.when(left[s], F.col(orders[s][k]).cast("double"))).alias(f"m{s}") for s in now)).first()
        for s in now:
            left[s] = left[s] & (F.col(orders[s][k]).cast("double") <= F.lit(least[f"m{s}"]).cast("double") + epsilon)
    slots = F.filter(F.array(*(F.when(keep, s) for s, keep in enumerate(left))), lambda s: s.isNotNull()) if orders else F.array().cast("array<int>")
    return pool.select(F.explode(slots).alias("slot"), F.col(ind_id).alias("ind_id"))


def islands(population: DataFrame, n_islands: int, order: str = "ind_id") -> DataFrame:
    """Adds ``island`` from 1: equal contiguous slices in order."""
    n = population.count()
    if n % n_islands:
        raise ValueError("the population doesn't divide by the islands")
    placed = positions(population, [order], "_pos")
    return placed.withColumn("island", (F.floor((F.col("_pos") - 1) / (n // n_islands)) + 1).cast("int")).drop("_pos")


def migration_targets(n: int, topology: str, rng=None) -> list[int]:
    """Each island's target, from 1."""
    if n == 1:
        return [1]
    if topology == "ring":
        return [i % n + 1 for i in range(1, n + 1)]
    if topology == "star":
        return [1] * n
    if topology == "random":
        return [int(rng.choice([j for j in range(1, n + 1) if j != i])) for i in range(1, n + 1)]
    raise ValueError(f"unknown topology {topology}")


def migrate(population: DataFrame, targets: list[int], m: int) -> DataFrame:
    """Copies of each island's ``m`` fittest, as they were before any move, replace the ``m`` least fit of its target.

    Gives (island, ind_id, fitness, origin). Sources that share a target deliver one after the other, so a later one may replace
    what an earlier one brought; islands with one source each take part in the first round. Of equals the first place counts.
    """
    spark = population.sparkSession
    now = population.select("island", F.row_number().over(W.partitionBy("island").orderBy("ind_id")).alias("slot"), "ind_id", "fitness", F.col("island").cast("int").alias("origin"))
    now = start = written(now, "before-migration")
    best = F.row_number().over(W.partitionBy("island").orderBy(F.desc("fitness"), "slot"))
    sent = now.withColumn("place", best).where(F.col("place") <= m).select(F.col("island").alias("source"), "place", F.col("ind_id").alias("new_id"), F.col("fitness").alias("new_fitness"))
    rounds: list[dict[int, int]] = []
    for source, target in enumerate(targets, 1):
        if source != target:
            if (nth := sum(target in r for r in rounds)) == len(rounds):
                rounds.append({})
            rounds[nth][target] = source
    for routes in rounds:
        route = F.broadcast(spark.createDataFrame(list(routes.items()), "target int, source int"))
        coming = sent.join(route, "source").select("target", "place", "new_id", "new_fitness", "source")
        worst = now.withColumn("worst", F.row_number().over(W.partitionBy("island").orderBy("fitness", "slot")))
        both = worst.join(coming, (F.col("island") == F.col("target")) & (F.col("worst") == F.col("place")), "left")
        before, now = now, written(both.select("island", "slot", F.coalesce("new_id", "ind_id").alias("ind_id"), F.coalesce("new_fitness", "fitness").alias("fitness"), F.coalesce("source", "origin").cast("int").alias("origin")), "migrated")
        if before is not start:
            discard(before)
    return now.drop("slot")
