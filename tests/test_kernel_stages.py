"""Operators whose kernels run between Column stages, and kernels that don't lay out their windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfactor.functions import kernels, registry
from sparkfactor.functions.scope import GLOBAL, Scope
from sparkfactor.plans import compiler
from sparkfactor.plans.ir import call, parse, variable


@pytest.fixture
def median():
    spec = registry.register_op("test_median", "ts_unary", lambda v, d: np.array([0.0 if i < d - 1 else float(np.median(v[i - d + 1 : i + 1])) for i in range(len(v))]), searched=False)
    twice = registry.register_op("test_twice", "unary", lambda v: 2 * v)
    yield spec
    del registry.OPS["test_median"], registry.OPS["test_twice"], twice


@pytest.mark.parametrize("kind", ["global", "panel"])
@pytest.mark.parametrize("stage_rows", [1, 11, 1000])
def test_kernel_only_op(spark, median, monkeypatch, kind, stage_rows):
    monkeypatch.setattr(compiler.kernel_stage, "__defaults__", (stage_rows,))
    rng = np.random.default_rng(1)
    n = 120
    rows = [(i, f"s{i % 3}" if i % 4 else "hot", i // 10, float(rng.normal()), float(rng.normal()), 7) for i in range(n)]
    panel = spark.createDataFrame(rows, "row_id long, asset string, ts int, a double, b double, piece int").repartition(4)
    scope = Scope("global", bucket_rows=50) if kind == "global" else Scope("panel")
    tree = parse("safe_add(ts_mean(test_median(test_twice(x1), d=4), d=3), test_median(x2, d=5))")
    got = {r.row_id: r.f for r in compiler.compile_forest(panel, {"f": tree}, ["a", "b"], scope).collect()}
    for asset in {r[1] for r in rows} if kind == "panel" else {None}:
        own = [r for r in rows if asset in (None, r[1])]
        want = compiler.evaluate(tree, np.array([[r[3], r[4]] for r in own]))
        assert np.allclose([got[r[0]] for r in own], want), asset
    assert len(got) == n


def test_plan_does_not_grow_with_the_window(spark):
    panel = spark.range(2000).select(F.col("id").alias("row_id"), F.rand(1).alias("a"))
    size = lambda op, d: len(compiler.compile_forest(panel, {"f": call(op, variable(1), window=d)}, ["a"])._jdf.queryExecution().optimizedPlan().toString())
    for op in ("ts_rank", "decay"):
        assert abs(size(op, 900) - size(op, 100)) < 40


@pytest.mark.parametrize("op", ["ts_rank", "decay"])
def test_wide_and_narrow_forms_agree(spark, op, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.integers(5))) for i in range(300)]
    panel = spark.createDataFrame(rows, "row_id long, a double").repartition(3)
    tree = call(op, variable(1), window=20)
    narrow = {r.row_id: r.f for r in compiler.compile_forest(panel, {"f": tree}, ["a"]).collect()}
    monkeypatch.setitem(registry.OPS, op, registry.OpSpec(op, "ts_unary", registry.OPS[op].kernel, registry.OPS[op].column, most_window=1))
    wide = {r.row_id: r.f for r in compiler.compile_forest(panel, {"f": tree}, ["a"], Scope("global", bucket_rows=70)).collect()}
    assert all(np.isclose(wide[i], narrow[i]) for i, _ in rows) and len(wide) == len(narrow) == 300
    assert compiler.compile_forest(panel.limit(0), {"f": tree}, ["a"]).count() == 0


def test_extremes_and_decay_without_windows_laid_out():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 64, 101):
        v = rng.normal(size=n)
        if n > 50:
            v[20], v[40] = np.nan, np.inf
        for d in (1, 2, 3, 7, 64, 100):
            for op, f in (("ts_max", np.max), ("ts_min", np.min), ("decay", lambda w: (w * np.arange(1, len(w) + 1)).sum() / (len(w) * (len(w) + 1) / 2))):
                want = [0.0 if i < d - 1 else f(v[i - d + 1 : i + 1]) for i in range(n)]
                assert np.allclose(kernels.TS_UNARY[op](v, d), want, equal_nan=True), (op, n, d)


def test_more_trees_than_one_plan_takes(spark, monkeypatch):
    monkeypatch.setattr(compiler, "MOST_TREES", 2)
    panel = spark.range(30).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("a"))
    out = compiler.compile_forest(panel, {f"f{k}": parse(f"ts_sum(safe_add(x1, {k}.0), d=3)") for k in range(5)}, ["a"])
    assert out.columns == ["row_id", "a", *(f"f{k}" for k in range(5))]
    assert [tuple(r) for r in out.where("row_id = 10").collect()] == [(10, 10.0, *(27.0 + 3 * k for k in range(5)))]


def test_cross_section_needs_a_column():
    with pytest.raises(ValueError):
        registry.register_op("test_cross", "cs", lambda v: v)
    assert GLOBAL.kind == "global"
