"""The registered search holds no large table as a matrix."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from sparkfactor.operators import engine
from sparkfactor.plans import catalog


def test_large_tables_are_read_in_blocks(spark, monkeypatch):
    """Beyond the bound no row reaches the driver."""
    seen = []
    monkeypatch.setattr(catalog, "events_panel", lambda s, d: s.range(40).select(F.col("id").alias("row_id"), F.lit("a").alias("asset"), F.col("id").cast("double").alias("x1")))
    monkeypatch.setattr(catalog, "MATRIX_ROWS", 34)
    monkeypatch.setattr(engine, "panel_matrix", lambda *_: 1 / 0)
    monkeypatch.setattr(engine, "run_gp_panel", lambda panel, features, y, cfg: seen.append((panel.count(), features, y)) or SimpleNamespace(members=[]))
    assert catalog.gp_search(spark, "").count() == 0
    assert seen == [(35, catalog.FEATURES, "y")]
