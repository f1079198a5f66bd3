"""CSV assets by folder: names as they stand, missing cells, large assets in several files; the overfit row."""

import pytest
from pyspark.sql import functions as F

from sparkfactor.operators.oos import MEMBER_KIND, overfit, overfit_table
from sparkfactor.sources import panel
from sparkfactor.sources.panel import read_csv_assets, write_csv_assets


def test_names_and_cells_come_back(spark, tmp_path):
    rows = [(a, f"2024-01-{d:02d} 10:00:00", str(d * 1.5) if d % 5 else ("NA", "NaN", "null", "")[d // 5 % 4], str(d)) for a in ("01", "a:b c", "x=y", "é/z") for d in range(1, 21)]
    write_csv_assets(spark.createDataFrame(rows, "asset string, open_time string, close string, volume string"), f"{tmp_path}/a")
    got = read_csv_assets(spark, f"{tmp_path}/a", by_folder=True).select("asset", F.date_format("ts", "dd").cast("int").alias("d"), "close", "volume")
    want = {(a, int(v), float(c), float(v)) for a, _, c, v in rows if c not in ("NA", "NaN", "null", "")}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_a_large_asset_is_several_files(spark, tmp_path):
    df = spark.range(4000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise("cold").alias("asset"), F.lpad(F.col("id").cast("string"), 6, "0").alias("open_time"), F.col("id").cast("string").alias("close"), F.lit("1").alias("v"))
    # so few rows would be put together again
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_csv_assets(df.repartition(8), f"{tmp_path}/b")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(tmp_path.glob("b/asset=hot/*.csv"))) > 1
    assert read_csv_assets(spark, f"{tmp_path}/b", by_folder=True).groupBy("asset").count().orderBy("asset").collect() == [("cold", 800), ("hot", 3200)]


def test_many_assets_share_files(spark, tmp_path, monkeypatch):
    """Beyond the bound no asset has a folder, and names and cells come back all the same."""
    monkeypatch.setattr(panel, "ASSET_FOLDERS", 40)
    odd = ["01", "a:b c", "x=y", "é/z", ' "q", +', "50%", "line\nend", "asset=1"]
    rows = [(a, f"2024-01-{d:02d} 10:00:00", str(d * 1.5) if d != 3 else "NA", str(d)) for a in [*odd, *(f"s{k:03d}" for k in range(60))] for d in range(1, 6)]
    for n, layout in ((5 * 40, 40), (len(rows), 0)):
        folder = f"{tmp_path}/{layout}"
        write_csv_assets(spark.createDataFrame(rows[:n], "asset string, open_time string, close string, volume string"), folder)
        assert len(list(tmp_path.glob(f"{layout}/asset=*"))) == layout
        got = read_csv_assets(spark, folder, by_folder=True).select("asset", F.date_format("ts", "dd").cast("int").alias("d"), "close", "volume").collect()
        assert sorted(map(tuple, got)) == sorted((a, int(v), float(c), float(v)) for a, _, c, v in rows[:n] if c != "NA")


def test_too_few_columns(spark, tmp_path):
    write_csv_assets(spark.createDataFrame([("a", "1", "2")], "asset string, open_time string, close string"), f"{tmp_path}/c")
    with pytest.raises(ValueError, match="another column"):
        read_csv_assets(spark, f"{tmp_path}/c", by_folder=True)


@pytest.mark.parametrize("pps", [[], [(0.4, 0.1), (0.2, 0.2)], [(-0.1, 0.3)], [(0.0, 0.0)]])
def test_overfit_row_equals_the_check(spark, pps):
    members = spark.createDataFrame([(k, oos, 0.0, 0.0, 0.0, train, 3) for k, (train, oos) in enumerate(pps, 1)], MEMBER_KIND)
    (got,), want = overfit_table(members).collect(), overfit(members.collect())
    for name, value in want.items():
        assert got[name] is None if value is None else abs(got[name] - value) < 1e-12
