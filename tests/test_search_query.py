"""The registered search reaches PFS, constant tuning and migration, with a generation after them."""

from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from sparkfactor.operators import engine
from sparkfactor.plans import catalog


def test_registered_search_reaches_all(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(catalog, "events_panel", lambda s, d: s.range(4).select(F.col("id").alias("row_id"), F.lit("a").alias("asset"), F.col("id").cast("double").alias("x1")))
    monkeypatch.setattr(engine, "panel_matrix", lambda *_: (np.zeros((4, 4)), np.zeros(4)))
    monkeypatch.setattr(engine, "run_gp", lambda s, x, y, cfg: seen.append(cfg) or SimpleNamespace(members=[]))
    catalog.gp_search(spark, "")
    (cfg,) = seen
    assert cfg.optimize_constants and max(cfg.const_opt_every_n_gens, cfg.migration_interval) < cfg.n_generations and cfg.n_islands > 1
