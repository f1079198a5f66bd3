"""Fronts and the hall of fame against the sequential rules."""

import numpy as np
import pytest

from sparkfactor.operators import engine, fronts
from sparkfactor.operators.genetic import Individual
from sparkfactor.plans.ir import variable

SCHEMA = "ind_id long, pps double, rre double, complexity int, batch int, place string"


def beats(a, b):
    return a != b and a[0] >= b[0] and a[1] >= b[1] and a[2] <= b[2]


def sequential(hall, candidates, size):
    """One batch after the other: admission candidate by candidate, then one trim pair by pair."""
    hall = list(hall)
    for c in candidates:
        if any(beats(m[1], c[1]) or m[1] == c[1] for m in hall):
            continue
        hall = [m for m in hall if not beats(c[1], m[1])] + [c]
    while len(hall) > size:
        gap = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 + ((a[2] - b[2]) / max(a[2], b[2], 1)) ** 2
        _, i, j = min((gap(a[1], b[1]), i, j) for i, a in enumerate(hall) for j, b in enumerate(hall) if i < j)
        hall.pop(i if hall[i][1][0] <= hall[j][1][0] else j)
    return hall


def drawn(rng, n, spread):
    return [(i, (float(rng.integers(spread)) / spread, float(rng.integers(spread)) / spread, int(rng.integers(1, spread)))) for i in range(n)]


def test_hall_on_the_driver_equals_the_sequential_rule():
    rng = np.random.default_rng(1)
    for _ in range(60):
        size = int(rng.integers(1, 8))
        hof, plain = engine.ParetoHoF(size), []
        for _ in range(3):
            batch = drawn(rng, 40, 25)
            hof.update([_individual(t) for _, t in batch])
            plain = sequential(plain, batch, size)
            assert [(m.pps, m.rre, m.complexity) for m in hof.members] == [t for _, t in plain]


def _individual(t):
    return Individual((variable(1),) * t[2], (1 / t[2],) * t[2], "vote", pps=t[0], rre=t[1], fitness=0.0)


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_front_and_odd_members(spark, one_task):
    rng = np.random.default_rng(2)
    odd = [(900, float("nan"), 0.1, 5), (901, 0.5, float("nan"), 1), (902, None, 9.0, 1), (903, 9.0, None, 1), (904, 9.0, 9.0, None), (905, float("inf"), 9.0, 1), (906, 9.0, float("-inf"), 1)]
    for n, spread in ((1, 3), (150, 4), (300, 60)):
        own = drawn(rng, n, spread)
        rows = [(i, *t, 0, "x") for i, t in own] + [(*o, 0, None) for o in odd]
        got = fronts.pareto_front(spark.createDataFrame(rows, SCHEMA).repartition(5), one_task=one_task).collect()
        first = {}
        for i, t in own:
            first.setdefault(t, i)
        assert sorted((r.ind_id, (r.pps, r.rre, r.complexity)) for r in got) == sorted((i, t) for t, i in first.items() if not any(beats(o, t) for o in first))
    assert fronts.pareto_front(spark.createDataFrame([], SCHEMA), one_task=one_task).count() == 0
    assert fronts.pareto_front(spark.createDataFrame([(*o, 0, None) for o in odd], SCHEMA), one_task=one_task).count() == 0


def test_nan_removes_nobody(spark):
    rows = [(1, 0.6, 0.05, 5, 0, ""), (2, float("nan"), 0.1, 5, 0, "")]
    assert [r.ind_id for r in fronts.pareto_front(spark.createDataFrame(rows, SCHEMA)).collect()] == [1]


def test_hall_of_fame(spark):
    rng = np.random.default_rng(3)
    own = drawn(rng, 240, 40)
    rows = [(i, *t, i % 3, "x") for i, t in own] + [(999, float("nan"), 1.0, 1, 1, "x"), (998, 5.0, 5.0, 1, None, "no batch")]
    plain = []
    for b in range(3):
        plain = sequential(plain, [m for m in own if m[0] % 3 == b], 6)
    members = spark.createDataFrame(rows, SCHEMA).drop("place").repartition(4)
    got = fronts.hall_of_fame(members.where("batch is not null"), 6).orderBy("place").collect()
    assert [(r.place, r.ind_id) for r in got] == [(k, i) for k, (i, _) in enumerate(plain, 1)]
    assert fronts.hall_of_fame(members.limit(0), 6).count() == 0


def test_fitness_that_is_not_finite_takes_no_part(spark):
    rows = [(1, 0.1, 0.1, 5, 1.0), (2, 0.9, 0.9, 1, float("-inf")), (3, 0.9, 0.9, 1, None)]
    assert [r.ind_id for r in fronts.pareto_front(spark.createDataFrame(rows, "ind_id long, pps double, rre double, complexity int, fitness double")).collect()] == [1]
