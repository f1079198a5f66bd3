"""Ranks by ranges of values, cut so small that ranges are many and crowded leading bits are split, against ranks of the whole."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkfactor.functions.kernels import tied_rank
from sparkfactor.operators import blocks as b
from sparkfactor.operators import evaluation
from sparkfactor.operators.genetic import Individual
from sparkfactor.plans import catalog
from sparkfactor.plans.ir import parse
from sparkfactor.sources import shared


def test_packed_integers_come_back():
    for a in ([5], [-(2**62), -3, 0, 0, 7, 2**62], [1, 2, 3]):
        assert b.unpacked(b.packed(np.array(a, np.int64))).tolist() == a
    v = np.array([-np.inf, -1.5, -0.0, 0.0, 1e-300, 2.0, np.inf, np.nan, -np.nan])
    s = b.sortable(v)
    assert (np.diff(s) >= 0).all() and s[2] == s[3] and s[7] == s[8]


def test_wide_records_stay_small(spark, monkeypatch):
    """Noisy copies make rows wide, so their blocks have fewer rows; and a written table's row groups close by bytes, not after 100 records."""
    sizes, pack = [], evaluation.panel_blocks
    monkeypatch.setattr(evaluation, "panel_blocks", lambda *a: sizes.append(pack(*a)) or sizes[-1])
    monkeypatch.setattr(b, "BLOCK_BYTES", 4000)
    panel = spark.range(200).select(F.col("id").alias("row_id"), *(F.rand(k).alias(c) for k, c in enumerate("abcd")))
    one = Individual((parse("safe_add(x1, safe_add(x2, safe_add(x3, x4)))"),), (1.0,), "rank_average")
    assert evaluation.population_steadiness(panel, [one], list("abcd"), n_copies=5).first().pfs > 0.9
    # 4 features, 20 noisy ones, 6 ranks of a member and its copies, and its own
    assert [s.block_rows for s in sizes] == [4000 // (8 * 31)]
    cells = lambda batches: (pa.record_batch({"cell": [np.random.default_rng(i.as_py()).bytes(4 << 20)]}) for batch in batches for i in batch.column(0))
    large = shared.written(spark.range(0, 12, 1, 1).mapInArrow(cells, "cell binary"), "panel-blocks")
    (file,) = large.inputFiles()
    assert pq.ParquetFile(file.removeprefix("file://")).num_row_groups > 1 and large.agg(F.sum(F.length("cell"))).first()[0] == 12 * (4 << 20)


@pytest.mark.parametrize("reach", [0, 6])
def test_ranks_by_ranges(spark, reach):
    rng = np.random.default_rng(6)
    n = 230
    near, ties = 1 + rng.integers(0, 40, n) * 1e-15, rng.integers(-2, 3, n).astype(float)
    y = rng.normal(size=n)
    ties[[4, 90]] = np.nan
    panel = spark.createDataFrame([(2 * i, float(near[i]), float(ties[i]), float(y[i])) for i in range(n)], "row_id long, a double, b double, y double").repartition(3)
    own = b.panel_blocks(panel, ["a", "b"], "y", "row_id", reach, 31)
    assert own.n == n
    jobs = [(lambda x, y: y, True), (lambda x, y: x[:, 0], False), (lambda x, y: x[:, 1], False), (lambda x, y: x[:, 1], True)]
    ranked = b.with_ranks(own.slice(0, n), jobs, range_values=5)
    got = {}
    for r in ranked.df.collect():
        rows = b._loaded(ranked, r.asDict())
        for i in range(len(rows.y)):
            got.setdefault(rows.row - rows.halo + i, set()).add(tuple(rows.x[i, 2:]))
    first = lambda v: [(np.flatnonzero(np.argsort(v, kind="stable") == i)[0] + 1) / n for i in range(n)]
    want = list(zip(tied_rank(y), first(near), first(ties), tied_rank(ties), strict=True))
    # copies in front of a block have the ranks of their rows
    assert all(len(got[i]) == 1 and np.allclose(next(iter(got[i])), want[i]) for i in range(n))
    signals = [lambda x, y: x[:, 0], lambda x, y: x[:, 1]]
    ranges, _ = b.value_ranges(ranked, signals, range_values=5)
    assert len(ranges.starts[0]) > 3
    sums = b.rank_sums(ranked, signals, [0, 0], ranges, 10)
    for k, v in enumerate((near, ties)):
        r, q = tied_rank(v) - (n + 1) / 2, tied_rank(y) - (n + 1) / 2
        assert np.isclose(sums[k][0], (r * r).sum()) and np.isclose(sums[k][1], (r * q).sum())
        assert sums[k][2] == np.bincount(np.ceil(tied_rank(v) / n * 10).astype(int), minlength=11)[1:].tolist()


def test_search_writes_little(spark, tmp_path, monkeypatch):
    """A score of a population writes no row for each row of the panel and individual: blocks and counts of leading bits alone."""
    sizes = []
    from sparkfactor.operators import blocks, evaluation

    for module in (blocks, evaluation):
        monkeypatch.setattr(module, "written", lambda df, name, w=module.written: sizes.append((name, (out := w(df, name)).count())) or out)
    rng = np.random.default_rng(3)
    panel = spark.createDataFrame([(i, float(rng.normal()), float(rng.normal())) for i in range(4000)], "row_id long, a double, y double")
    own = [evaluation.Individual((catalog.parse("x1"),), (1.0,), "weighted_sum"), evaluation.Individual((catalog.parse("safe_sin(x1)"),), (1.0,), "rank_average")]
    assert evaluation.population_scores(panel, own, ["a"], block_rows=2000).count() == 2
    assert sizes and max(n for _, n in sizes) < 2000, sizes
