"""Population operators, the panel pipeline and the search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfactor.config import GPConfig
from sparkfactor.operators import engine, fronts, neighbours, population
from sparkfactor.operators.combine import combine
from sparkfactor.operators.genetic import Individual
from sparkfactor.plans.ir import variable
from sparkfactor.sources import panel as sources


def ind(pps=0.0, rre=0.0, nodes=1, fitness=0.0):
    tree = variable(1)
    return Individual((tree,) * nodes, (1.0 / nodes,) * nodes, "vote", fitness=fitness, pps=pps, rre=rre)


def test_knn_novelty(spark):
    rng = np.random.default_rng(1)
    prints = rng.standard_normal((20, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(prints)] + [(99, [])], "ind_id long, behavior array<float>")
    archive = spark.createDataFrame([([0.0] * 4,)], "behavior array<float>")
    got = {r.ind_id: r.novelty for r in neighbours.knn_novelty(df, 3, archive).collect()}
    for i, p in enumerate(prints):
        assert np.isclose(got[i], engine.knn_mean(p, np.concatenate([np.delete(prints, i, 0), np.zeros((1, 4))]), 3))
    assert got[99] == 0 and engine.knn_mean(prints[0], np.empty((0, 4)), 3) == 0


def test_dominance_and_front(spark):
    a, b = ind(0.5, 0.5, 2), ind(0.4, 0.5, 2)
    assert engine.dominates(a, b) and not engine.dominates(b, a) and not engine.dominates(a, a) and not engine.dominates(ind(0.6, 0.1), ind(0.1, 0.6))
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.integers(8)), float(rng.integers(8)), int(rng.integers(1, 6))) for i in range(120)]
    hof = engine.ParetoHoF(1000)
    hof.update([ind(p, r, c, 1.0) for _, p, r, c in rows])
    front = fronts.pareto_front(spark.createDataFrame(rows, "ind_id long, pps double, rre double, complexity int")).collect()
    assert {(r.pps, r.rre, r.complexity) for r in front} == {(m.pps, m.rre, m.complexity) for m in hof.members} and len(front) == len(hof.members)
    small = engine.ParetoHoF(3)
    small.update([ind(p, r, c, 1.0) for _, p, r, c in rows] + [ind(9, 9, 1, float("-inf"))])
    assert len(small.members) == 3 and small.summary()["best_pps"] < 9


def test_archive_evicts():
    archive = engine.NoveltyArchive(3, 1, [np.array([x, 0.0]) for x in (0.1, 0.2, 0.3)])
    archive.update([np.array([100.0, 100.0])])
    assert len(archive.entries) == 3 and archive.entries[-1].tolist() == [100, 100]


def test_selection():
    rng = np.random.default_rng(3)
    fitness = np.array([1.0, 5.0, 3.0, 5.0])
    assert engine.tournament_select(rng, fitness, 10) in (1, 3)
    errors = 1.0 - np.eye(6)
    assert {engine.lexicase_select(rng, errors, 0.0) for _ in range(300)} == set(range(6))
    assert {engine.lexicase_select(rng, np.array([[0.0, 0.0], [1.0, 1.0]]), 0.1) for _ in range(20)} == {0}


def test_islands():
    assert population.migration_targets(4, "ring") == [2, 3, 4, 1] and population.migration_targets(4, "star") == [1] * 4 and population.migration_targets(1, "ring") == [1]
    assert all(t != i for i, t in enumerate(population.migration_targets(5, "random", np.random.default_rng(1)), 1))
    own = [[ind(fitness=float(10 * k + i)) for i in range(4)] for k in range(3)]
    out = engine.migrated(own, [2, 3, 1], 1)
    assert [len(o) for o in out] == [4, 4, 4] and [max(i.fitness for i in o) for o in out] == [23, 13, 23] and min(i.fitness for i in out[0]) == 1


@pytest.mark.parametrize("how", ["weighted_sum", "rank_average", "vote"])
def test_combine(spark, how):
    df = spark.createDataFrame([(0, 1.0, -1.0), (1, 2.0, -2.0), (2, -3.0, 3.0)], "row_id long, a double, b double")
    got = [r.f for r in combine(df, ["a", "b"], how).orderBy("row_id").collect()]
    assert np.allclose(got, 0.0 if how != "rank_average" else 2 / 3)
    assert {r.f for r in combine(df, [], how).collect()} == {0.0}


def test_csv_panel(spark, tmp_path):
    for name, step in (("AAA", 1), ("BBB", 2)):
        (tmp_path / f"{name}.csv").write_text("open_time,close,v\n" + "".join(f"2024-01-{d:02d} 00:00:00,{10 + step * d},{'NA' if d == 4 else 'null' if d == 6 else d}\n" for d in range(1, 13)))
    df = sources.with_row_id(sources.read_csv_assets(spark, str(tmp_path)), ["asset", "ts"])
    rows = df.orderBy("row_id").collect()
    assert len(rows) == 20 and [r.row_id for r in rows] == list(range(20)) and {r.asset for r in rows} == {"AAA", "BBB"}
    target = sources.forward_target(df, 2).orderBy("row_id").collect()
    assert len(target) == 16 and np.isclose(target[0].y, 13 / 11 / 11)
    train, test = sources.date_split(df, 0.5)
    assert train.count() + test.count() == 20 and train.agg(F.max("ts")).first()[0] < test.agg(F.min("ts")).first()[0]
    with pytest.raises(ValueError):
        sources.date_split(df, 0.5, least_train=50)
    sources.write_csv(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 20
    with pytest.raises(ValueError):
        sources.stack_assets([df, df.drop("v")])


def test_search_finds_the_feature(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((80, 4))
    y = x[:, 0] + 0.2 * rng.standard_normal(80)
    cfg = GPConfig(population_size=24, n_trees=1, max_depth=3, n_generations=3, elite_count=2, n_islands=2, behavior_sample_size=20, hof_size=6, migration_interval=2, const_opt_every_n_gens=2, combination="weighted_sum", fin_op_prob=0.2, lexicase_n_periods=4)
    logs = []
    first, again = engine.run_gp(spark, x, y, cfg, logs.append), engine.run_gp(spark, x, y, cfg)
    assert [m.key for m in first.members] == [m.key for m in again.members] and len(logs) == 3
    assert 0 < len(first.members) <= 6 and max(m.pps for m in first.members) > 0.4
    assert not any(engine.dominates(a, b) for a in first.members for b in first.members)
