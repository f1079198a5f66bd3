"""Population scores over blocks of rows against the kernels on the whole panel."""

import datetime
import json
from dataclasses import replace

import numpy as np
import pytest

from sparkfactor.config import GPConfig
from sparkfactor.functions.kernels import tied_rank
from sparkfactor.operators import blocks, engine, scores
from sparkfactor.operators.evaluation import block_pps, cross_rounds, population_scores, target_ranked, tuned_constants
from sparkfactor.operators.genetic import Individual
from sparkfactor.plans import catalog
from sparkfactor.plans.compiler import evaluate
from sparkfactor.plans.ir import parse

TREES = [
    "ts_mean(safe_mul(x1, x2), d=5)",
    "cs_rank(ts_delta(x1, d=3))",
    "ts_mean(cs_rank(ts_sum(x1, d=4)), d=6)",
    "cs_zscore(ts_mean(cs_winsorize(cs_rank(x2)), d=3))",
    "safe_tanh(cs_scale(safe_sub(x1, cs_zscore(x2))))",
    "safe_mul(x3, 0.0)",
    "x3",
    "safe_log(ts_corr(x1, x2, d=10))",
]


@pytest.mark.parametrize("block_rows", [7, 64, 100_000])
def test_population_scores_equal_kernels(spark, block_rows):
    rng = np.random.default_rng(1)
    n = 300
    x = np.column_stack([rng.normal(size=n) * 3, np.abs(rng.normal(size=n)), rng.integers(0, 4, n).astype(float)])
    y = np.round(x[:, 0] * 0.3 + rng.normal(size=n), 1)
    trees = [parse(t) for t in TREES]
    own = [Individual((t,), (1.0,), "weighted_sum") for t in trees]
    own += [Individual((trees[0], trees[2], trees[3]), (0.5, 0.3, 0.2), how) for how in ("weighted_sum", "vote", "rank_average")]
    own += [Individual((trees[1], trees[1], trees[4]), (0.2, 0.2, 0.6), "rank_average"), Individual((), (), "vote")]
    rows = [(3 * i + 1, *map(float, x[i]), float(y[i]), 9) for i in range(n)]
    panel = spark.createDataFrame(rows, "row_id long, a double, b double, c double, y double, block int").repartition(5)
    got = {r.i: r for r in population_scores(panel, own, ["a", "b", "c"], block_rows=block_rows).collect()}
    assert sorted(got) == list(range(len(own)))
    for i, ind in enumerate(own):
        f = scores.combined(ind.trees, ind.weights, ind.combination, x)
        assert np.isclose(got[i].ic, scores.corr(f, y), atol=1e-9), i
        assert np.isclose(got[i].rank_ic, scores.rank_corr(f, tied_rank(y)), atol=1e-9), i
        assert np.isclose(got[i].pps, scores.pps(f, y, tied_rank(y)), atol=1e-9) and np.isclose(got[i].rre, scores.rre(f), atol=1e-9), i
        assert got[i].complexity == ind.complexity and np.isclose(got[i].fitness, 0.3 * got[i].pps + 0.3 * got[i].rre - 0.001 * ind.complexity)


def test_edges(spark):
    panel = spark.createDataFrame([(0, 1.0, 1.0)], "row_id long, a double, y double")
    one = [Individual((parse("cs_rank(x1)"),), (1.0,), "vote")]
    assert [(r.i, r.pps, r.rre) for r in population_scores(panel, one, ["a"]).collect()] == [(0, 0.0, 0.0)]
    assert population_scores(panel.limit(0), one, ["a"]).count() == 1 and population_scores(panel, [], ["a"]).count() == 0


def test_odd_values(spark):
    """NaN and infinite values of a signal: no correlation, ranks as in the kernels."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 1))
    x[3, 0], x[50, 0] = np.nan, np.inf
    y = rng.normal(size=60)
    panel = spark.createDataFrame([(i, float(x[i, 0]), float(y[i])) for i in range(60)], "row_id long, a double, y double")
    got = population_scores(panel, [Individual((parse("x1"),), (1.0,), "weighted_sum")], ["a"], block_rows=20).first()
    assert got.ic == 0 and np.isclose(got.rank_ic, scores.rank_corr(x[:, 0], tied_rank(y))) and np.isclose(got.rre, scores.rre(x[:, 0]))


def test_rounds_go_from_the_inside_out():
    own = [Individual((parse(TREES[3]), parse(TREES[4])), (0.5, 0.5), "rank_average")]
    rounds = cross_rounds(own)
    assert [sorted((c.op, c.root) for c in r) for r in rounds] == [[("cs_rank", False), ("cs_zscore", False)], [("cs_scale", False), ("cs_winsorize", False)], [("cs_rank", True), ("cs_zscore", False)], [("cs_rank", True)]]


def test_simplexes_together_equal_one_by_one(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 3))
    y = x[:, 0] + 0.2 * rng.normal(size=120)
    panel = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(120)], "row_id long, a double, b double, c double, y double")
    trees = [parse(t) for t in ("safe_add(x1, safe_mul(10.0, x3))", "safe_sub(x1, safe_mul(0.5, safe_add(x2, 1.5)))", "x2")]
    rank = tied_rank(y)
    want = []
    for t in trees:
        loss = lambda c, t=t: -scores.pps(evaluate(t, x, list(c)), y, rank)
        best = scores.nelder_mead(loss, np.array(t.constants()), most=4) if t.constants() else None
        want.append(best[0].tolist() if best and best[1] < loss(t.constants()) else t.constants())
    got = tuned_constants(panel, trees, ["a", "b", "c"], most=4, block_rows=50)
    assert all(np.allclose(g.constants(), w, atol=1e-9) for g, w in zip(got, want, strict=True)) and got[2] == trees[2]
    assert tuned_constants(panel, [], ["a"]) == []


@pytest.mark.parametrize("range_values", [20, 1 << 19])
def test_pps_by_one_exchange_equals_kernels(spark, monkeypatch, range_values):
    """Ranges of known and of sampled values, ties, values that aren't finite, crosses, few rows."""
    monkeypatch.setattr(blocks, "RANGE_VALUES", range_values)
    rng, n = np.random.default_rng(4), 300
    x = np.column_stack([np.sort(rng.normal(size=n)), np.round(rng.normal(size=n), 1), rng.normal(size=n)])
    x[[3, 70], 2] = np.inf, np.nan
    y = np.round(x[:, 1] * 0.3 + rng.normal(size=n), 1)
    panel = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(n)], "row_id long, a double, b double, c double, y double")
    trees = [parse(t) for t in ("x1", "safe_mul(x2, 2.0)", "x3", "safe_mul(x1, 0.0)", "safe_add(cs_rank(x2), ts_mean(x1, d=4))")]
    own = replace(target_ranked(blocks.panel_blocks(panel, ["a", "b", "c"], "y", "row_id", 4, 31)), shared=True)
    assert np.allclose(block_pps(own, trees), [scores.pps(evaluate(t, x), y, tied_rank(y)) for t in trees], atol=1e-9)
    assert block_pps(own.slice(5, 6), trees[:2]) == [0.0, 0.0]


def test_registered_tuning_takes_all_steps(spark, tmp_path):
    """The registered query against the kernel with the steps that a search has by default."""
    rng, n = np.random.default_rng(6), 200
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(i, start + datetime.timedelta(minutes=31 * i), i % 3, "click", float(rng.uniform(1, 9)), json.dumps({"k": int(rng.integers(100))})) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = [r.after for r in catalog.tuned_query(spark, str(tmp_path)).orderBy("tree", "constant").collect()]
    panel = catalog.forward_target(catalog.events_panel(spark, str(tmp_path)), 5, close="x1", target="simple_return")
    x, y = engine.panel_matrix(panel, catalog.FEATURES, "y")
    want = [c for t in catalog.TUNED_TREES for c in scores.tuned(parse(t), x, y, tied_rank(y), GPConfig().const_opt_steps).constants()]
    assert np.allclose(got, want, rtol=1e-9) and got != [5.0, 0.5, 1.5]


def test_search_to_unseen_rows(spark, tmp_path):
    """The registered query against the search's own front, scored by the kernels on the rows behind the date."""
    rng = np.random.default_rng(5)
    n = 260
    moments = [datetime.datetime(2024, 1, 1 + i // 20, tzinfo=datetime.timezone.utc) + datetime.timedelta(minutes=i) for i in range(n)]
    rows = [(i, moments[i], i % 3, "click", float(rng.uniform(1, 9)), json.dumps({"k": int(rng.integers(100))})) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(catalog.search_oos(spark, str(tmp_path)).collect(), key=lambda r: r["rank"])
    panel = catalog.forward_target(catalog.events_panel(spark, str(tmp_path)), 5, close="x1", target="simple_return")
    train, test = catalog.date_split(panel, 0.7, "day")
    front = engine.run_gp(spark, *engine.panel_matrix(train, catalog.FEATURES, "y"), catalog.SEARCH_CFG).members
    x, y = engine.panel_matrix(test, catalog.FEATURES, "y")
    want = []
    for m in front:
        f = scores.combined(m.trees, m.weights, m.combination, x)
        want.append((round(scores.pps(f, y, tied_rank(y)), 3), round(scores.corr(f, y), 3), round(scores.rre(f), 3), m.complexity))
    assert len(got) == len(front) > 0
    for r, w in zip(sorted((r.oos_pps, r.oos_ic, r.oos_rre, r.complexity) for r in got), sorted(want), strict=True):
        assert np.allclose(r, w, atol=2e-3)
    assert [r.oos_pps for r in got] == sorted((r.oos_pps for r in got), reverse=True)
