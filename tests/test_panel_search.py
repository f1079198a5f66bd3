"""The search on a table in blocks of rows against the search on a matrix, and what it asks of the table against the kernels."""

import datetime
import hashlib
import json

import numpy as np
import pytest

from sparkfactor.config import FitnessWeights, GPConfig
from sparkfactor.functions.kernels import tied_rank
from sparkfactor.operators import engine, scores
from sparkfactor.operators.evaluation import population_steadiness, population_traits
from sparkfactor.operators.genetic import Individual
from sparkfactor.plans import catalog
from sparkfactor.plans.ir import parse

TREES = [parse(t) for t in ("ts_mean(safe_mul(x1, x2), d=5)", "cs_rank(ts_delta(x1, d=3))", "cs_zscore(ts_mean(cs_rank(x2), d=3))", "safe_mul(x1, 0.0)", "x2")]
OWN = [Individual((t,), (1.0,), "weighted_sum") for t in TREES]
OWN += [Individual((TREES[0], TREES[1], TREES[2]), (0.5, 0.3, 0.2), how) for how in ("weighted_sum", "vote", "rank_average")] + [Individual((), (), "vote")]


def data(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), np.round(np.abs(rng.normal(size=n)), 1)])
    y = np.round(x[:, 0] * 0.3 + rng.normal(size=n), 1)
    rows = [(5 * i + 2, float(x[i, 0]), float(x[i, 1]), float(y[i]), "z") for i in range(n)]
    return x, y, spark.createDataFrame(rows, "row_id long, a double, b double, y double, place string").repartition(3)


@pytest.mark.parametrize("block_rows", [11, 1000])
def test_traits_equal_kernels(spark, block_rows):
    x, y, panel = data(spark, 103)
    places = [50, 0, 102, 10, 11, 50]
    got = sorted(population_traits(panel, OWN, ["a", "b"], places, 7, block_rows=block_rows).collect(), key=lambda r: r.i)
    cuts = scores.periods(len(y), 7, remainder=True)
    assert [r.i for r in got] == list(range(len(OWN)))
    for r, ind in zip(got, OWN, strict=True):
        f = scores.combined(ind.trees, ind.weights, ind.combination, x)
        assert np.allclose(r.behavior, f[places].astype(np.float32), atol=1e-6)
        assert np.allclose(r.errors, [np.abs(f[c] - y[c]).mean() for c in cuts], atol=1e-9)


def test_traits_of_few_rows(spark):
    x, y, panel = data(spark, 3)
    (r,) = population_traits(panel, OWN[4:5], ["a", "b"], [2, 7, 0], 10).collect()
    assert np.allclose(r.behavior, x[[2, 0], 1]) and np.allclose(r.errors, np.abs(x[:, 1] - y))
    (r,) = population_traits(panel.limit(0), OWN[4:5], ["a", "b"], [0], 4).collect()
    assert r.behavior == [] and r.errors == []
    assert population_traits(panel, [], ["a", "b"], [0], 4).count() == 0


def normal(key):
    h = hashlib.md5(key.encode()).hexdigest()
    u = [(int(h[k : k + 13], 16) + 0.5) / 2**52 for k in (0, 13)]
    return np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1])


@pytest.mark.parametrize("block_rows", [17, 1000])
def test_steadiness_equals_kernels_on_the_same_noise(spark, block_rows):
    x, _, panel = data(spark, 60)
    got = {r.i: r.pfs for r in population_steadiness(panel, OWN, ["a", "b"], n_copies=3, noise=0.3, seed=9, block_rows=block_rows).collect()}
    spread = x.std(axis=0, ddof=1)
    for i, ind in enumerate(OWN):
        signal = lambda m, ind=ind: scores.combined(ind.trees, ind.weights, ind.combination, m)
        base = signal(x)
        want = 0.0
        if base.std(ddof=1) >= 1e-8:
            noisy = [x + 0.3 * spread * np.array([[normal(f"9-{c}-{k}-{5 * r + 2}") for k in (1, 2)] for r in range(60)]) for c in range(3)]
            want = np.mean([scores.rank_corr(signal(m), tied_rank(base)) for m in noisy])
        assert np.isclose(got[i], want, atol=1e-9), i
    assert got[1] < 1 and got[3] == 0 and got[8] == 0
    assert [r.pfs for r in population_steadiness(panel.limit(1), OWN[:1], ["a", "b"]).collect()] == [0.0]
    assert population_steadiness(panel, [], ["a", "b"]).count() == 0


CFG = GPConfig(
    population_size=8, n_trees=2, max_depth=3, n_generations=3, elite_count=2, n_islands=2, behavior_sample_size=30, hof_size=6, lexicase_n_periods=4,
    const_opt_every_n_gens=2, const_opt_steps=1, const_prob=0.4, migration_interval=2, weights=FitnessWeights(0.4, 0.4, 0.0, 0.2), ts_windows=(3, 5),
)


def test_search_on_a_table_takes_the_steps_of_the_matrix(spark):
    """Without PFS, whose noise is drawn in two ways, both give one front, generation by generation."""
    x, y, panel = data(spark, 160)
    logs, want_logs = [], []
    want = engine.run_gp(spark, x, y, CFG, want_logs.append)
    got = engine.run_gp_panel(panel, ["a", "b"], "y", CFG, block_rows=70, log=logs.append)
    for a, b in zip(logs, want_logs, strict=True):
        assert all(np.isclose(a[k], b[k], atol=1e-6) for k in b), (a, b)
    key = lambda m: (m.pps, m.rre, m.complexity)
    assert len(got.members) == len(want.members) > 0
    for a, b in zip(sorted(got.members, key=key), sorted(want.members, key=key), strict=True):
        assert np.allclose(key(a), key(b), atol=1e-6) and [t.size for t in a.trees] == [t.size for t in b.trees] and np.allclose(a.behavior, b.behavior, atol=1e-4)


def test_an_empty_table_is_refused(spark):
    _, _, panel = data(spark, 2)
    with pytest.raises(ValueError, match="no rows"):
        engine.run_gp_panel(panel.limit(0), ["a", "b"], "y", CFG)


class SameNoise(engine.MatrixScorer):
    """The matrix scorer with PFS on the noise that a panel draws, made here from its definition."""

    def steadiness(self, individuals, rows, behavior_rows, generation):
        x, c, out = self.x[rows], self.cfg, []
        seed, spread = c.seed * 100_000 + generation, np.maximum(x.std(axis=0, ddof=1), 1e-8)
        noise = [np.array([[normal(f"{seed}-{copy}-{k + 1}-{rows.start + r}") for k in range(x.shape[1])] for r in range(len(x))]) for copy in range(c.pfs_n_perturbations)]
        for ind in individuals:
            base = scores.combined(ind.trees, ind.weights, ind.combination, x)
            ok = np.isfinite(base).all() and base.std(ddof=1) >= 1e-8
            moved = [scores.combined(ind.trees, ind.weights, ind.combination, x + c.pfs_noise_scale * spread * m) for m in noise] if ok else []
            out.append(float(np.mean([scores.rank_corr(f, tied_rank(base)) for f in moved])) if ok else 0.0)
        return out


def test_registered_search_tunes_and_perturbs_in_full():
    """As many steps of tuning and noisy copies as a search has by default."""
    for c in (catalog.PANEL_CFG, catalog.SEARCH_CFG):
        assert (c.const_opt_steps, c.pfs_n_perturbations, c.eval_subsample) == (GPConfig().const_opt_steps, GPConfig().pfs_n_perturbations, GPConfig().eval_subsample)


def test_registered_search_equals_a_search_on_the_matrix(spark, tmp_path):
    """PFS, tuning and migration included, a generation behind them."""
    c = catalog.PANEL_CFG
    assert c.optimize_constants and max(c.const_opt_every_n_gens, c.migration_interval) < c.n_generations and c.n_islands > 1 and c.weights.pfs > 0
    rng, n = np.random.default_rng(8), 240
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(i, start + datetime.timedelta(minutes=7 * i), i % 3, "click", float(rng.uniform(1, 9)), json.dumps({"k": int(rng.integers(100))})) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.gp_search_panel(spark, str(tmp_path)).orderBy("rank").collect()
    panel = catalog.forward_target(catalog.events_panel(spark, str(tmp_path)), 5, close="x1", target="simple_return")
    want = engine.search(SameNoise(spark, *engine.panel_matrix(panel, catalog.FEATURES, "y"), c), c).members
    assert len(got) == len(want) > 0
    for r, w in zip(sorted((r.pps, r.rre, r.complexity) for r in got), sorted((m.pps, m.rre, m.complexity) for m in want), strict=True):
        assert np.allclose(r, w, atol=1e-6)
    assert [r.pps for r in got] == sorted((r.pps for r in got), reverse=True)
