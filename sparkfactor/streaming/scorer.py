"""Frozen factors over a stream of panel rows.

Each asset keeps the last rows that its factors' windows reach back to, so a micro-batch is scored as if it were the end of the whole
series. Rows of an asset must come in order of ``row_id``; within a batch they are sorted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.registry import lookup
from ..plans.compiler import evaluate
from ..plans.ir import Node


def score_stream(rows: DataFrame, trees: dict[str, Node], features: list[str], asset: str = "asset", order: str = "row_id") -> DataFrame:
    """(asset, row_id, one double for each tree) for a streaming or batch DataFrame; rolling operators look back within an asset.

    Cross-sectional operators need all assets of a date and are refused.
    """
    for tree in trees.values():
        if any(n.op and lookup(n.op).tier == "cs" for _, n, _ in tree.walk()):
            raise ValueError("cross-sectional operators can't be scored asset by asset")
    reach = max((t.reach for t in trees.values()), default=0)
    names, constants = list(trees), list(trees.values())
    kinds = dict(rows.dtypes)

    def run(key, frames, state):
        seen, kept = state.get if state.exists else (0, [])
        before = np.array(kept, float).reshape(-1, len(features))
        own = pd.concat(list(frames)).sort_values(order)
        x = np.concatenate([before, own[features].to_numpy(float)])
        out = {asset: key[0], order: own[order].to_numpy()}
        # windows that reach behind the asset's first row are warm-up, which the kept rows alone can't show once older ones are dropped
        for name, tree in zip(names, constants, strict=True):
            out[name] = evaluate(tree, x)[len(before) :]
        state.update((int(seen + len(own)), x[max(0, len(x) - reach) :].ravel().tolist() if reach else []))
        yield pd.DataFrame(out)

    schema = f"`{asset}` {kinds[asset]}, `{order}` {kinds[order]}, " + ", ".join(f"`{n}` double" for n in names)
    return rows.groupBy(asset).applyInPandasWithState(run, schema, "seen long, kept array<double>", "append", "NoTimeout")
