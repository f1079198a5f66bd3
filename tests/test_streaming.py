import numpy as np
import pytest

from sparkfactor.functions.scope import Scope
from sparkfactor.plans.compiler import compile_forest
from sparkfactor.plans.ir import parse
from sparkfactor.streaming.scorer import score_stream

SCHEMA = "row_id long, asset string, ts long, x1 double, x2 double"
TREES = {"m": parse("ts_mean(safe_mul(x1, x2), d=4)"), "d": parse("ts_delta(ts_sum(x1, d=3), d=2)"), "e": parse("safe_add(x1, 1.0)")}


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, f"a{i % 3}", i // 3, float(rng.standard_normal()), float(rng.standard_normal())) for i in range(90)]
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q = score_stream(stream, TREES, ["x1", "x2"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.row_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = compile_forest(spark.createDataFrame(rows, SCHEMA), TREES, ["x1", "x2"], Scope("panel")).collect()
    assert len(got) == len(want) == 90
    for r in want:
        assert np.allclose([got[r.row_id][n] for n in TREES], [r[n] for n in TREES]), r


def test_cross_sections_are_refused(spark):
    with pytest.raises(ValueError):
        score_stream(spark.createDataFrame([], SCHEMA), {"r": parse("cs_rank(x1)")}, ["x1", "x2"])
