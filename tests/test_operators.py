"""Operators: Columns against kernels, scopes against each other, and hand-made cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfactor.config import FitnessWeights, GPConfig, MutationProbs
from sparkfactor.functions import kernels
from sparkfactor.functions.ranking import positions, tied_ranks
from sparkfactor.functions.registry import OPS, lookup, register_op, validate_ops
from sparkfactor.functions.scope import Scope
from sparkfactor.operators import genetic, metrics, scores
from sparkfactor.plans.compiler import compile_forest, evaluate
from sparkfactor.plans.ir import call, constant, parse, variable

N = 160


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((N, 3)) * 3, 2)
    x[20:40, 0], x[60, :], x[::7, 1] = 1.5, 0.0, x[0, 1]
    return x


@pytest.fixture(scope="module")
def panel(spark, matrix):
    rows = [(i, f"a{i % 4}", i // 4, *map(float, r)) for i, r in enumerate(matrix)]
    return spark.createDataFrame(rows, "row_id long, asset string, ts long, x1 double, x2 double, x3 double").repartition(3).cache()


def column(panel, trees, scope):
    out = compile_forest(panel, trees, ["x1", "x2", "x3"], scope).orderBy("row_id").collect()
    return {n: np.array([r[n] for r in out]) for n in trees}


def tree_of(op):
    spec = lookup(op)
    return call(op, *(variable(k + 1) for k in range(spec.arity)), window=5 if spec.rolling else None)


@pytest.mark.parametrize("bucket", [1_000_000, 37])
def test_columns_equal_kernels(panel, matrix, bucket):
    trees = {f"t_{op}": tree_of(op) for op in OPS}
    got = column(panel, trees, Scope("global", bucket_rows=bucket))
    for name, tree in trees.items():
        np.testing.assert_allclose(got[name], evaluate(tree, matrix), rtol=1e-9, atol=1e-9, err_msg=name)


def test_panel_scope_is_by_asset_and_date(panel, matrix):
    trees = {"m": parse("ts_mean(x1, d=3)"), "r": parse("cs_rank(x2)"), "z": parse("cs_zscore(x1)")}
    got, asset, date = column(panel, trees, Scope("panel")), np.arange(N) % 4, np.arange(N) // 4
    for name, key, tree in (("m", asset, trees["m"]), ("r", date, trees["r"]), ("z", date, trees["z"])):
        for k in np.unique(key):
            np.testing.assert_allclose(got[name][key == k], evaluate(tree, matrix[key == k]), atol=1e-9)


def test_random_trees_equal_kernels(panel, matrix):
    cfg, trees = GPConfig(population_size=4, elite_count=1, unary_ops=("safe_log", "safe_tanh", "abs"), binary_ops=("safe_add", "safe_sub", "safe_div")), {}
    for seed in range(12):
        tree = genetic.random_tree(np.random.default_rng(seed), cfg, 3, "grow", 4)
        # a rank of values that differ in the last digit, or a guard met by rounding, depends on the order of sums
        if not {"cs_rank", "ts_rank", "ts_corr", "ts_stddev"} & {n.op for _, n, _ in tree.walk()}:
            trees[f"t{seed}"] = tree
    assert len(trees) >= 3
    got = column(panel, trees, Scope("global", bucket_rows=61))
    for name, tree in trees.items():
        np.testing.assert_allclose(got[name], evaluate(tree, matrix), rtol=1e-6, atol=1e-6, err_msg=str(tree))


def test_warm_up_and_constants():
    c = np.full(12, 2.5)
    for op, want in {"ts_mean": 2.5, "ts_stddev": 0, "ts_rank": 1, "ts_max": 2.5, "ts_min": 2.5, "ts_sum": 10, "decay": 2.5}.items():
        got = kernels.TS_UNARY[op](c, 4)
        assert np.allclose(got[3:], want) and not got[:3].any()
    assert not kernels.TS_UNARY["ts_delta"](np.arange(9.0), 4)[:4].any() and (kernels.TS_UNARY["ts_delta"](np.arange(9.0), 4)[4:] == 4).all()
    assert not kernels.TS_BINARY["ts_corr"](c, c, 4).any() and not kernels.TS_BINARY["ts_cov"](c, c, 4).any()
    assert not kernels.TS_UNARY["ts_mean"](c, 40).any()
    assert kernels.CROSS["cs_rank"](np.array([3.0, 1, 3, 2])).tolist() == [0.75, 0.25, 1.0, 0.5]
    assert np.isinf(kernels.BINARY["safe_pow"](np.array([0.0]), np.array([-1.0]))).all()


def test_metrics(spark, matrix):
    assert kernels.tied_rank(np.array([3.0, 1, 4, 1, 5])).tolist() == [3, 1.5, 4, 1.5, 5]
    y = matrix[:, 0] + 0.2 * matrix[:, 2]
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(matrix[:, 1], y, matrix[:, 0], strict=True))]
    df = spark.createDataFrame(rows, "row_id long, g double, y double, f double")
    rank = kernels.tied_rank(y)
    for f, v in (("f", matrix[:, 0]), ("g", matrix[:, 1])):
        one = metrics.pps(df, f, "y").first()
        assert np.allclose([one.ic, one.rank_ic, one.pps], [scores.corr(v, y), scores.rank_corr(v, rank), scores.pps(v, y, rank)])
        assert np.isclose(metrics.rre(df, f).first().rre, scores.rre(v))
        assert np.isclose(metrics.icir(df, 7, f, "y").first().icir, scores.icir(v, y, 7))
        assert metrics.rolling_rank_ic(df, 7, f, "y").count() == 7
    flat = df.withColumn("f", F.lit(1.0))
    assert metrics.ic(flat).first().ic == 0 == metrics.rank_ic(flat).first().rank_ic and metrics.rre(flat).first().rre == 1
    assert metrics.icir(df, 1).first().icir == 0 and metrics.rolling_rank_ic(df.limit(4), 10).count() == 0
    errors = {r.period: r.err for r in metrics.error_matrix(df, ["f"], 7).collect()}
    assert np.allclose([errors[k] for k in range(7)], [np.abs(matrix[c, 0] - y[c]).mean() for c in scores.periods(N, 7, True)])
    assert np.isclose(scores.rre(np.arange(100.0)), 0)


def test_pfs(panel):
    steady = metrics.pfs(panel, parse("ts_mean(x1, d=5)"), ["x1", "x2", "x3"], Scope("global"), n_copies=2).first().pfs
    assert 0.9 < steady <= 1 and metrics.pfs(panel, parse("safe_mul(0.0, x1)"), ["x1", "x2", "x3"], Scope("global"), n_copies=1).first().pfs == 0


def test_positions_by_range(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 9), i) for i in range(500)]
    df = spark.createDataFrame(rows, "v long, i long").repartition(4)
    for most in (10_000, 0):
        got = positions(df, ["v", "i"], one_window=most).orderBy("pos").collect()
        assert [(r.v, r.i) for r in got] == sorted(rows) and [r.pos for r in got] == list(range(1, 501))
    import sparkfactor.functions.ranking as ranking

    kept, ranking.ONE_WINDOW_ROWS = ranking.ONE_WINDOW_ROWS, 0
    try:
        ranks = {r.i: r.rank for r in tied_ranks(df, "v", "rank").collect()}
    finally:
        ranking.ONE_WINDOW_ROWS = kept
    assert [ranks[i] for i in range(500)] == kernels.tied_rank(np.array([v for v, _ in rows])).tolist()


def test_ir():
    t = parse("safe_add(x1, ts_mean(safe_log(x2), d=3))")
    assert (t.size, t.depth, t.reach, str(t)) == (5, 3, 2, "safe_add(x1, ts_mean(safe_log(x2), d=3))") and parse(str(t)) == t
    assert str(t.replaced(2, variable(3))) == "safe_add(x1, x3)" or str(t.replaced(2, variable(3))) == "safe_add(x1, ts_mean(x3, d=3))"
    assert [str(n) for _, n, _ in t.walk()][1] == "x1" and t.level(4) == 3 and t.features() == {1, 2}
    c = parse("safe_mul(2.5, x1)")
    assert c.constants() == [2.5] and c.with_constants([3.0]).constants() == [3.0]
    for wrong in (lambda: call("safe_add", variable(1)), lambda: call("ts_mean", variable(1)), lambda: call("abs", variable(1), window=3), lambda: c.with_constants([1, 2])):
        with pytest.raises(ValueError):
            wrong()


def test_registry():
    assert [sum(o.tier == t for o in OPS.values()) for t in ("unary", "binary", "ts_unary", "ts_binary", "cs")] == [9, 6, 8, 2, 4]
    with pytest.raises(KeyError):
        validate_ops(["nothing"])
    with pytest.raises(ValueError):
        register_op("abs", "unary", abs, abs)
    register_op("twice", "unary", lambda x: 2 * x, lambda x: x * 2)
    assert evaluate(parse("twice(x1)"), np.ones((2, 1))).tolist() == [2, 2]
    OPS.pop("twice")


def test_genetic_invariants():
    cfg = GPConfig(population_size=40, elite_count=2, n_trees=3, max_depth=4)
    rng = np.random.default_rng(2)
    everyone = genetic.init_population(rng, cfg, 4)
    assert len(everyone) == 40 and {max(t.depth for t in i.trees) for i in everyone} >= {2, 4}
    for k in range(200):
        a, b = everyone[k % 40], everyone[(k * 7 + 1) % 40]
        for ind in (*genetic.crossover(rng, a, b, cfg), genetic.mutate(rng, a, cfg, 4), genetic.hoist_mutate(rng, a), genetic.shrink_mutate(rng, a, cfg, 4), genetic.point_mutate(rng, a, cfg, 4)):
            assert all(t.depth <= cfg.max_depth for t in ind.trees) and ind.complexity == sum(t.size for t in ind.trees)
    same = lambda: [i.key for i in genetic.init_population(np.random.default_rng(5), cfg, 4)]
    assert same() == same()
    assert evaluate(constant(2.0), np.zeros((3, 1))).tolist() == [2, 2, 2]


def test_config_checks():
    for wrong in ({"min_depth": 7}, {"population_size": 10}, {"lexicase_n_periods": 1}, {"ts_windows": ()}, {"combination": "no"}, {"crossover_prob": 2}, {"unary_ops": ("safe_add",)}):
        with pytest.raises(ValueError):
            GPConfig(**wrong)
    for make in (lambda: MutationProbs(0.9, 0.9), lambda: FitnessWeights(-0.1)):
        with pytest.raises(ValueError):
            make()
    assert [round(scores.novelty_weight(0.3, g, 100), 3) for g in (1, 75, 100, 200)] == [0.3, 0.3, 0, 0] and 0 < scores.novelty_weight(0.3, 87, 100) < 0.3


def test_tuning_improves():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 3))
    y = x[:, 0] + 0.2 * rng.standard_normal(200)
    tree, rank = parse("safe_add(x1, safe_mul(10.0, x3))"), kernels.tied_rank(y)
    better = scores.tuned(tree, x, y, rank)
    assert scores.pps(evaluate(better, x), y, rank) > 0.7 > scores.pps(evaluate(tree, x), y, rank) and better.size == tree.size
    assert scores.tuned(parse("x1"), x, y, rank) == parse("x1")
