"""Lexicase over whole tables: the same survivors as step by step in NumPy and as the array form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfactor.operators import population
from sparkfactor.plans import catalog

ORDERS = [[0, 1, 2], [1, 0, 2], [2, 1, 0], [2]]


def expected(ids, errors, epsilon):
    out = set()
    for slot, order in enumerate(ORDERS):
        left = np.arange(len(ids))
        for k in order:
            left = left[errors[left, k] <= errors[left, k].min() + epsilon]
        out |= {(slot, int(i)) for i in ids[left]}
    return out


def test_random_pools(spark):
    rng = np.random.default_rng(5)
    errors = rng.integers(0, 40, (500, 3)) / 4
    rows = [(i, *e) for i, e in enumerate(errors.tolist())]
    pool = spark.createDataFrame(rows, "ind_id long, e0 double, e1 double, e2 double").repartition(3)
    got = population.lexicase(pool, [[f"e{k}" for k in o] for o in ORDERS], 2.0)
    assert {tuple(r) for r in got.collect()} == expected(np.arange(500), errors, 2.0) and got.count() == len(got.distinct().collect())
    array = pool.agg(F.collect_list(F.struct("ind_id", F.array("e0", "e1", "e2").alias("e"))).alias("p"))
    for slot, o in enumerate(ORDERS):
        s = array.select(F.explode(population.lexicase_survivors(F.col("p"), F.array(*map(F.lit, o)), 2.0)).alias("s")).select("s.ind_id").collect()
        assert {r.ind_id for r in s} == {r.ind_id for r in got.where(F.col("slot") == slot).collect()}
    assert population.lexicase(pool.limit(0), [["e0", "e1"]], 2.0).count() == population.lexicase(pool, [], 2.0).count() == 0


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.1/part.parquet"), reason="needs the tables")
def test_whole_part_table(spark):
    pool = catalog.lexicase_errors(spark.read.parquet("/root/testdata/sf0.1/part.parquet"))
    rows = np.array([tuple(map(float, r)) for r in pool.collect()])
    assert len(rows) == 20_000
    got = population.lexicase(pool, [[f"e{k}" for k in o] for o in ORDERS], 2.0).collect()
    assert {tuple(r) for r in got} == expected(rows[:, 0].astype(int), rows[:, 1:], 2.0)
