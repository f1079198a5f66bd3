"""A front out of sample against the kernels, the run from CSV files, and plans that stay linear in trees."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfactor.config import GPConfig
from sparkfactor.functions import ranking
from sparkfactor.functions.kernels import tied_rank
from sparkfactor.operators import engine, fronts, neighbours, oos, population, scores
from sparkfactor.operators.combine import combine
from sparkfactor.operators.genetic import Individual
from sparkfactor.plans.compiler import compile_forest
from sparkfactor.plans.ir import parse

FEATURES = ["x1", "x2", "x3"]
TREES = [parse(t) for t in ("ts_mean(x1, d=3)", "safe_add(x1, safe_log(x2))", "cs_rank(ts_delta(x2, d=2))", "ts_corr(x1, x3, d=5)")]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((120, 3))
    y = x[:, 0] + 0.3 * rng.standard_normal(120)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "row_id long, x1 double, x2 double, x3 double, y double")


@pytest.mark.parametrize("most", [50, 2])
def test_members_and_trees_equal_the_kernels(table, most, monkeypatch):
    x, y, df = table
    monkeypatch.setattr(oos, "MOST_TREES", most)
    members = [
        Individual(tuple(TREES[:2]), (0.7, 0.3), "weighted_sum", pps=0.2),
        Individual((TREES[2], TREES[0]), (0.5, 0.5), "rank_average", pps=0.5),
        Individual((TREES[3],), (1.0,), "vote", pps=-0.1),
    ]
    own, trees = oos.evaluate_oos(df, members, FEATURES)
    y_rank = tied_rank(y)

    def expect(f):
        return [round(v, 4) for v in (scores.pps(f, y, y_rank), scores.corr(f, y), scores.rank_corr(f, y_rank), scores.rre(f))]

    ordered = [members[1], members[0], members[2]]
    by_train = {round(m.pps, 4): expect(scores.combined(m.trees, m.weights, m.combination, x)) for m in members}
    rows = own.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3] and [r.oos_pps for r in rows] == sorted((r.oos_pps for r in rows), reverse=True)
    for r in rows:
        assert np.allclose([r.oos_pps, r.oos_ic, r.oos_rankic, r.oos_rre], by_train[r.train_pps], atol=1.01e-4)
    found = trees.collect()
    assert len(found) == 5 and {(r.individual_rank, r.tree_idx) for r in found} == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)}
    for r in found:
        tree = ordered[r.individual_rank - 1].trees[r.tree_idx - 1]
        assert np.allclose([r.oos_pps, r.oos_ic, r.oos_rankic, r.oos_rre], expect(scores.combined((tree,), (1.0,), "weighted_sum", x)), atol=1.01e-4)
        assert (r.tree_size, r.tree_depth) == (tree.size, tree.depth)
    signals = oos.member_signals(df, members, FEATURES).orderBy("row_id").collect()
    for k, m in enumerate(ordered, 1):
        assert np.allclose([r[oos.signal_name(k, m)] for r in signals], scores.combined(m.trees, m.weights, m.combination, x))


def test_no_members(table):
    own, trees = oos.evaluate_oos(table[2], [], FEATURES)
    assert own.count() == trees.count() == 0 and oos.member_signals(table[2], [], FEATURES).columns == ["row_id"]
    assert oos.report_text([], []) == "no members" and oos.overfit([])["degradation"] is None


def test_overfit_and_text(spark):
    rows = spark.createDataFrame([(1, 0.3, 0.1, 0.2, 0.9, 0.4, 5), (2, 0.1, 0.1, 0.1, 0.9, 0.4, 3)], oos.MEMBER_KIND).collect()
    check = oos.overfit(rows)
    assert np.isclose(check["train_pps"], 0.4) and np.isclose(check["oos_pps"], 0.2) and np.isclose(check["degradation"], 50.0)
    trees = spark.createDataFrame([(1, i, 0.1, 0.1, 0.1, 0.5, 2, 1, i) for i in range(1, 6)], oos.TREE_KIND).collect()
    text = oos.report_text(rows, trees, most_trees=3)
    assert "50.0 % lost" in text and "first 3 of 5 rows" in text and "individual_rank" in text


def test_from_csv_to_results(spark, tmp_path):
    rng = np.random.default_rng(6)
    (tmp_path / "in").mkdir()
    for name in ("AAA", "BBB"):
        price = 100 * np.exp(np.cumsum(0.01 * rng.standard_normal(60)))
        lines = [f"2024-{1 + d // 28:02d}-{1 + d % 28:02d} 00:00:00,{p},{rng.standard_normal()}" for d, p in enumerate(price)]
        (tmp_path / "in" / f"{name}.csv").write_text("open_time,close,v\n" + "\n".join(lines) + "\n")
    cfg = GPConfig(population_size=8, n_trees=2, max_depth=2, n_generations=1, elite_count=1, n_islands=1, behavior_sample_size=20, hof_size=4, lexicase_n_periods=4)
    run = oos.discover(spark, str(tmp_path / "in"), str(tmp_path / "out"), cfg, horizon=2)
    n = len(run.front.members)
    assert n and run.members.count() == n and run.trees.count() == 2 * n and len(run.best) == 2
    assert spark.read.csv(str(tmp_path / "out" / "summary"), header=True).count() == n
    assert spark.read.csv(str(tmp_path / "out" / "trees"), header=True).count() == 2 * n
    signals = spark.read.parquet(str(tmp_path / "out" / "signals"))
    assert len(signals.columns) == n + 1 and signals.count() == signals.select("row_id").distinct().count() > 20
    assert "oos_pps" in run.text and "mean pps" in run.text
    with pytest.raises(ValueError):
        oos.discover(spark, str(tmp_path / "in"), str(tmp_path / "none"), cfg, horizon=2, least_train=500)


def scans(df, path):
    plan = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"FileScan parquet", plan)), path in plan


def test_rank_average_is_linear_in_trees(spark, table, tmp_path):
    x, _, df = table
    df.write.parquet(str(tmp_path / "source"))
    source = spark.read.parquet(str(tmp_path / "source"))
    trees = {f"t{k}": parse(f"ts_mean(x{k % 3 + 1}, d={k + 2})") for k in range(13)}
    wide = compile_forest(source, trees, FEATURES)
    out = combine(wide, list(trees), "rank_average")
    count, again = scans(out, str(tmp_path / "source"))
    assert count <= 3 and not again  # the signals are written once and read for the ranks, their number and the result
    got = [r.f for r in out.orderBy("row_id").collect()]
    assert np.allclose(got, scores.combined(tuple(trees.values()), (1.0,) * 13, "rank_average", x))
    several = compile_forest(source, {f"r{k}": parse(f"cs_rank(ts_sum(x{k % 3 + 1}, d={k + 2}))") for k in range(5)}, FEATURES)
    assert scans(several, "")[0] <= 3


@pytest.mark.parametrize("one_window", [10**6, 5])
def test_grouped_ranks(spark, one_window, monkeypatch):
    monkeypatch.setattr(ranking, "ONE_WINDOW_ROWS", one_window)
    rng = np.random.default_rng(7)
    rows = [(g, float(v)) for g, n in (("a", 40), ("b", 7), ("c", 1)) for v in rng.integers(0, 9, n)] + [("b", float("nan"))]
    got = ranking.grouped_tied_ranks(spark.createDataFrame(rows, "g string, v double"), "g", "v", "r").collect()
    for g in "abc":
        own = np.array([v for k, v in rows if k == g])
        expected = sorted(zip(np.nan_to_num(own, nan=99), tied_rank(np.nan_to_num(own, nan=99)), strict=True))
        assert np.allclose(sorted((99 if np.isnan(r.v) else r.v, r.r) for r in got if r.g == g), expected)


@pytest.mark.parametrize("topology", ["ring", "star", "random"])
def test_migration_of_rows_equals_the_search(spark, topology):
    rng = np.random.default_rng(8)
    for n, size, m in ((4, 4, 1), (5, 6, 2), (2, 3, 2)):
        targets = population.migration_targets(n, topology, rng)
        fitness = rng.integers(0, 12, (n, size)).astype(float)
        own = [[Individual((), (), "vote", fitness=f, pps=float(k * size + i)) for i, f in enumerate(row)] for k, row in enumerate(fitness)]
        expected = sorted((k, i.pps, i.fitness) for k, row in enumerate(engine.migrated(own, targets, m), 1) for i in row)
        df = spark.createDataFrame([(k + 1, float(k * size + i), float(f)) for k, row in enumerate(fitness) for i, f in enumerate(row)], "island int, ind_id double, fitness double")
        assert sorted((r.island, r.ind_id, r.fitness) for r in population.migrate(df, targets, m).collect()) == expected


def test_star_keeps_what_survives(spark):
    rows = [(1, i, float(i)) for i in (5, 6, 7, 8)] + [(k + 2, 100 + k, 100.0 + k) for k in range(3)]
    got = population.migrate(spark.createDataFrame(rows, "island int, ind_id int, fitness double"), [1, 1, 1, 1], 1)
    assert sorted(r.ind_id for r in got.where("island = 1").collect()) == [8, 100, 101, 102]


def test_front_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    for n, spread in ((150, 4), (200, 40)):
        rows = [(i, float(rng.integers(spread)), float(rng.integers(spread)), int(rng.integers(1, spread))) for i in range(n)]
        triples = {r[1:] for r in rows}
        beats = lambda a, b: a != b and a[0] >= b[0] and a[1] >= b[1] and a[2] <= b[2]
        expected = sorted(t for t in triples if not any(beats(o, t) for o in triples))
        got = fronts.pareto_front(spark.createDataFrame(rows, "ind_id long, pps double, rre double, complexity int"))
        assert sorted((r.pps, r.rre, r.complexity) for r in got.collect()) == expected
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert fronts.pareto_front(spark.createDataFrame([], "ind_id long, pps double, rre double, complexity int")).count() == 0


def test_novelty_in_blocks(spark):
    rng = np.random.default_rng(10)
    prints = rng.standard_normal((30, 3))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(prints)] + [(50, [1.0])], "ind_id long, behavior array<double>")
    whole = {r.ind_id: r.novelty for r in neighbours.knn_novelty(df, 4).collect()}
    blocks = {r.ind_id: r.novelty for r in neighbours.knn_novelty(df, 4, pivots=3, block_rows=4, chunk_rows=5).collect()}
    for i, p in enumerate(prints):
        assert np.isclose(whole[i], engine.knn_mean(p, np.delete(prints, i, 0), 4)) and np.isclose(blocks[i], whole[i])
    assert whole[50] == blocks[50] == 0.0


def test_archive_keeps_distances():
    rng = np.random.default_rng(11)
    archive, plain = engine.NoveltyArchive(5, 2), []
    for b in rng.standard_normal((40, 3)):
        own = [engine.knn_mean(e, np.array(plain[:i] + plain[i + 1 :]), 2) for i, e in enumerate(plain)]
        if not plain or engine.knn_mean(b, np.array(plain), 2) > np.mean(own):
            if len(plain) >= 5:
                plain.pop(int(np.argmin(own)))
            plain.append(b)
    rng = np.random.default_rng(11)
    archive.update(list(rng.standard_normal((40, 3))))
    assert np.allclose(np.array(archive.entries), np.array(plain))


def test_metrics_agree_on_what_is_not_finite(spark):
    from sparkfactor.operators import metrics

    f, y = np.array([1.0, float("nan"), 3.0, 2.0]), np.array([1.0, 2.0, 3.0, 4.0])
    df = spark.createDataFrame(list(zip(f.tolist(), y.tolist(), strict=True)), "f double, y double")
    got = metrics.pps(df).first()
    assert got.ic == scores.corr(f, y) == 0.0 and np.isclose(got.pps, scores.pps(f, y, tied_rank(y)))
    endless = df.withColumn("f", F.when(F.isnan("f"), float("inf")).otherwise(F.col("f")))
    assert metrics.ic(endless).first().ic == 0.0


def test_target_of_a_zero_price(spark):
    from sparkfactor.sources.panel import forward_target

    df = spark.createDataFrame([(0, "a", 0.0), (1, "a", 2.0), (2, "a", 0.0), (3, "a", 0.0)], "row_id long, asset string, close double")
    got = [r.y for r in forward_target(df, 1).orderBy("row_id").collect()]
    assert got[0] == float("inf") and got[1] == 0.0 and np.isnan(got[2])
    assert [r.y for r in forward_target(df, 1, target="simple_return").orderBy("row_id").collect()] == [0.0, -1.0, 0.0]


def test_elites_get_their_steadiness(spark):
    """PFS reaches the fittest by the scores of the same generation."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((60, 3))
    y = x[:, 0]
    cfg = GPConfig(population_size=6, n_trees=1, max_depth=2, elite_count=2, n_islands=1, behavior_sample_size=10, lexicase_n_periods=3, combination="weighted_sum")
    own = [Individual((parse(t),), (1.0,), "weighted_sum", fitness=f) for t, f in (("x2", 9.0), ("x3", 8.0), ("x1", 7.5), ("safe_mul(x1, 2.0)", 7.6), ("x2", 0.0), ("x3", 0.0))]
    own = [engine.replace(i, fitness=float(k)) for k, i in enumerate(own)]
    out = engine._steadied(spark, [own], x, y, slice(0, 60), cfg, np.arange(10), 1, 2, 0.0)[0]
    assert [i.pfs > 0.9 for i in out] == [False, False, False, False, True, True]
    assert out[5].fitness == engine.fitness_of(out[5], cfg, 0.0)
