"""Trees to DataFrames, and trees to NumPy.

A forest becomes one chain of projections: every distinct subtree is computed once. Element-wise operators stay inside expressions;
a rolling or cross-sectional operator becomes a column, because aggregates over it need a name. Windows of one series share their
order, so Spark plans one exchange and one sort for all of them. An operator that has a kernel alone, or whose Column form would grow with its
window, becomes a stage of grouped Arrow tables between them.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.registry import OpSpec, lookup
from ..functions.scope import GLOBAL, Scope
from ..sources.shared import written
from .ir import Node

#: More trees than this in one plan cost more in planning than in work, so they are compiled in batches of so many.
MOST_TREES = 50
#: Rows of a series that a kernel's task holds, besides those before them that its window reaches.
STAGE_ROWS = 200_000


def compile_forest(panel: DataFrame, trees: dict[str, Node], features: list[str], scope: Scope = GLOBAL) -> DataFrame:
    """``panel`` with a double column for each named tree.

    More than ``MOST_TREES`` go in batches: each but the last is written, and the next one starts from there.
    """
    if len(trees) > MOST_TREES:
        own = list(trees.items())
        first = written(compile_forest(panel, dict(own[:MOST_TREES]), features, scope), "forest")
        return compile_forest(first, dict(own[MOST_TREES:]), features, scope)
    names: dict[Node, Column] = {}
    prefix = f"__node_{uuid.uuid4().hex[:8]}_"
    fresh = (f"{prefix}{k}" for k in itertools.count())
    df = scope.prepared(panel, max((t.reach for t in trees.values()), default=0))

    def staged(node: Node) -> Column:
        """A column that holds the node."""
        nonlocal df
        if node not in names:
            value, name = column(node), next(fresh)
            df = df.withColumn(name, value)
            names[node] = F.col(name)
        return names[node]

    def column(node: Node) -> Column:
        nonlocal df
        if node in names:
            return names[node]
        if node.feature is not None:
            return F.col(features[node.feature - 1]).cast("double")
        if node.op is None:
            return F.lit(node.value)
        spec = lookup(node.op)
        if spec.elementwise and spec.column is not None:
            return spec.column(*map(column, node.children))
        held, name = [staged(c) for c in node.children], next(fresh)
        if spec.by_kernel(node.window):
            sources = {next(fresh): h for h in held}
            df = kernel_stage(df.withColumns(sources), spec, list(sources), node.window, name, scope).drop(*sources)
        elif spec.rolling:
            df = df.withColumn(name, spec.column(*held, node.window, scope))
        else:
            source = next(fresh)
            df = spec.column(df.withColumn(source, held[0]), source, name, scope).drop(source)
        names[node] = F.col(name)
        return names[node]

    for name, tree in trees.items():
        value = column(tree)
        df = df.withColumn(name, value)
    return scope.finished(df).drop(*(c for c in df.columns if c.startswith(prefix)))


def kernel_stage(df: DataFrame, spec: OpSpec, sources: list[str], window: int | None, name: str, scope: Scope, stage_rows: int = STAGE_ROWS) -> DataFrame:
    """``df`` with a column that the operator's kernel makes of ``sources``.

    A rolling kernel gets pieces of a series of bounded rows, each behind the rows that its window reaches back to. So its plan has
    one size whatever the window, and no series is a task.
    """
    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])

    def valued(table: pa.Table, *more) -> pa.Array:
        with np.errstate(all="ignore"):
            columns = [table.column(c).to_numpy() if isinstance(table, pa.Table) else table.column(c).to_numpy(zero_copy_only=False) for c in sources]
            return pa.array(np.asarray(spec.kernel(*(np.asarray(c, float) for c in columns), *more), float))

    if not spec.rolling:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, valued(batch)], names=[*batch.schema.names, name])

        return df.mapInArrow(run, schema)
    size = max(stage_rows, window)
    place = F.row_number().over(scope.window()) - 1
    late = F.col("__place") % size >= size - window
    own = F.floor(F.col("__place") / size)
    pieces = df.withColumn("__place", place).withColumn("__own", own)
    pieces = pieces.withColumn("__piece", F.explode(F.when(late, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))))

    def run_piece(table):
        table = table.sort_by("__place")
        mine = pc.equal(table.column("__own"), table.column("__piece"))
        out = table.append_column(name, valued(table, window)).filter(mine)
        return out.select([f.name for f in schema.fields])

    return pieces.groupBy(scope.series, "__piece").applyInArrow(run_piece, schema)


def evaluate(tree: Node, x: np.ndarray, constants: list[float] | None = None, cross: Callable | None = None) -> np.ndarray:
    """The tree on a matrix of rows and features; ``constants`` stand in for its own.

    ``cross(node, argument)``: gives a cross-sectional node where ``x`` isn't the whole cross-section; ``argument()`` is its argument here.
    """
    left = iter(constants if constants is not None else tree.constants())

    def run(node: Node) -> np.ndarray:
        if node.feature is not None:
            return x[:, node.feature - 1]
        if node.op is None:
            return np.full(len(x), next(left))
        if cross is not None and lookup(node.op).tier == "cs":
            return cross(node, lambda: run(node.children[0]))
        args = [run(c) for c in node.children]
        with np.errstate(all="ignore"):
            return np.asarray(lookup(node.op).kernel(*args, *([node.window] if node.window is not None else [])), float)

    return run(tree)
