"""Rounding as SQL does it, where the shortest decimal form gives another digit."""

import math

import duckdb

from sparkfactor.functions.elementwise import half_up


def test_half_up_equals_sql(spark):
    rows = [0.0021875, 0.0000005, 1.0000005, 2.5, -2.5, 0.1234565, -0.1234565, 0.5103125, 1e-9, -1e-9, 0.0, 12345.6789015, 1e16, 1e300, 123456789012.3, math.inf, -math.inf, math.nan, None]
    rows += [k / 16 / 1e4 * s + 1 / 3e3 * (k % 3) for k in range(400) for s in (1, -1)] + [(k + 0.5) / 1e6 for k in range(2000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v double")
    got = [r.r for r in df.select("i", half_up("v", 6).alias("r")).orderBy("i").collect()]
    want = [duckdb.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in rows]
    same = lambda a, b: a is None and b is None or a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))
    assert [(v, a, b) for v, a, b in zip(rows, got, want, strict=True) if not same(a, b)] == []
