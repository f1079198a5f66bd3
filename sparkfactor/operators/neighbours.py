"""Exact k-nearest-neighbour novelty by metric pruning.

Fingerprints are dealt to the cells of their nearest pivots, and a cell to blocks of bounded rows. A fingerprint first meets its own
block, which bounds the distance of its k-th neighbour. By the triangle inequality a cell whose members are between r_min and
r_max from their pivot p holds nothing nearer to q than max(d(q, p) - r_max, r_min - d(q, p)), so q visits only the cells where that is below its bound.
Visitors of a block come in chunks, each with a copy of the block, and within a task all distances are one matrix product; those of the
k nearest are then computed anew from the differences. Nothing but the pivots, a bounded sample, and one row for each cell passes
through the driver.

How much is pruned hangs on the data: clustered fingerprints meet few cells, while uniformly random ones of many components meet all, as no
exact method can leave them out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import discard, written

#: Pivots for each length of fingerprints, rows of a block, and visitors of one copy of a block.
PIVOTS, BLOCK_ROWS, CHUNK_ROWS = 64, 16384, 4096
#: Distances that a task holds at once.
HELD = 1 << 23


def distances(a: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean distances of one fingerprint."""
    return np.sqrt(((others - a) ** 2).sum(1))


def _pivots(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
    """For each length up to ``n`` distinct fingerprints, those of least hash."""
    hashed = rows.select(F.size("a").alias("dim"), F.xxhash64("a").alias("h"), "a")
    least = hashed.select("dim", "h").distinct().withColumn("r", F.row_number().over(W.partitionBy("dim").orderBy("h"))).where(F.col("r") <= n)
    held: dict[int, list] = {}
    for r in hashed.join(F.broadcast(least.drop("r")), ["dim", "h"]).groupBy("dim", "h").agg(F.min("a").alias("a")).orderBy("dim", "h").collect():
        held.setdefault(r.dim, []).append(r.a)
    return {dim: np.array(v) for dim, v in held.items()}


def _vectors(column: pa.Array) -> Iterator[np.ndarray]:
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b in zip(at, at[1:], strict=False):
        yield values[a:b]


def _placed(rows: DataFrame, pivots) -> DataFrame:
    """(row, own, a, dim, cell, r): each row's nearest pivot and its distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [distances(v, pivots.value[len(v)]) for v in _vectors(batch.column(2))]
            cell = [int(d.argmin()) for d in found]
            more = [pa.array([len(v) for v in _vectors(batch.column(2))], pa.int32()), pa.array(cell, pa.int32()), pa.array([float(d[c]) for d, c in zip(found, cell, strict=True)], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=["row", "own", "a", "dim", "cell", "r"])

    return rows.select("row", "own", "a").mapInArrow(run, "row long, own boolean, a array<double>, dim int, cell int, r double")


def _nearest(ids: np.ndarray, asked: np.ndarray, others: np.ndarray, other_ids: np.ndarray, k: int) -> list[np.ndarray]:
    """The ``k`` least distances of each asked fingerprint from the others, its own row left out."""
    step = max(1, HELD // max(1, len(others)))
    if len(asked) > step:
        return [d for at in range(0, len(asked), step) for d in _nearest(ids[at : at + step], asked[at : at + step], others, other_ids, k)]
    with np.errstate(over="ignore", invalid="ignore"):
        apart = (asked**2).sum(1)[:, None] + (others**2).sum(1)[None, :] - 2 * asked @ others.T
    apart[ids[:, None] == other_ids[None, :]] = np.inf
    # a few more than k, as the product rounds
    most = min(k + 4, len(others))
    near = np.argpartition(apart, most - 1, axis=1)[:, :most] if most else np.empty((len(asked), 0), int)
    out = []
    for i, own in enumerate(near):
        own = own[other_ids[own] != ids[i]]
        out.append(np.sort(distances(asked[i], others[own]))[:k])
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows."""
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _table(rows: np.ndarray, found: list[np.ndarray]) -> pa.Table:
    return pa.table({"row": pa.array(rows, pa.int64()), "d": pa.array(found, pa.list_(pa.float64()))})


def knn_novelty(population: DataFrame, k: int, archive: DataFrame | None = None, ind_id: str = "ind_id", behavior: str = "behavior", pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS, report: dict | None = None) -> DataFrame:
    """(ind_id, novelty): mean distance to the min(k, n) nearest of all other rows and archive entries.

    Null and empty fingerprints get 0 and are nobody's neighbours, and so do those with a null, NaN or infinite value. Fingerprints of different
    length don't meet. Rows that share an id are individuals of their own. ``report`` receives the numbers of pairs and of those compared.
    """
    spark = population.sparkSession
    finite = lambda c: F.size(c).cast("int") > F.lit(0)
    usable = lambda c: finite(c) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = population.select(F.col(ind_id).alias("ind_id"), F.col(behavior).cast("array<double>").alias("a"))
    own = written(own.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    rows = own.where(usable("a")).select("row", F.lit(True).alias("own"), "a")
    if archive is not None:
        held = archive.select((-1 - F.monotonically_increasing_id()).alias("row"), F.lit(False).alias("own"), F.col(behavior).cast("array<double>").alias("a"))
        rows = written(rows.union(held.where(usable("a"))), "all-fingerprints")
    chosen = _pivots(rows, pivots)
    shared = spark.sparkContext.broadcast(chosen)
    cells = written(_placed(rows, shared), "cells")
    sizes = {(r.dim, r.cell): r for r in cells.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()}
    parts = spark.createDataFrame([(d, c, -(-r.n // block_rows)) for (d, c), r in sizes.items()], "dim int, cell int, parts int")
    blocks = cells.join(F.broadcast(parts), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    blocks = written(blocks.select("dim", "cell", "part", "row", "own", "a"), "blocks")

    def at_home(table):
        x, ids, mine = _matrix(table.column("a")), table.column("row").to_numpy(), table.column("own").to_numpy()
        return _table(ids[mine], _nearest(ids[mine], x[mine], x, ids, k))

    home = written(blocks.groupBy("dim", "cell", "part").applyInArrow(at_home, "row long, d array<double>"), "home")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            columns = [batch.column(c).to_pylist() for c in ("row", "dim", "cell", "part", "bound")]
            for row, dim, cell, part, bound, v in zip(*columns, _vectors(batch.column(5)), strict=True):
                d = distances(v, shared.value[dim])
                for c, apart in enumerate(d.tolist()):
                    size = sizes.get((dim, c))
                    # a hair wider than the bound, as distances round
                    if size is None or max(apart - size.high, size.low - apart) > bound * (1 + 1e-9):
                        continue
                    for p in range(-(-size.n // block_rows)):
                        if (c, p) != (cell, part):
                            for o, value in zip(out, (row, dim, c, p), strict=True):
                                o.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["row", "dim", "cell", "part"])

    bounded = home.select("row", F.when(F.size("d") >= k, F.element_at("d", -1)).otherwise(float("inf")).alias("bound"))
    leaving = blocks.where("own").join(bounded, "row").select("row", "dim", "cell", "part", "bound", "a")
    visits = written(leaving.mapInArrow(visit, "row long, dim int, cell int, part int"), "visits")
    chunks = written(visits.groupBy("dim", "cell", "part").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("chunks"), F.count(F.lit(1)).alias("n")), "chunks")
    key = ["dim", "cell", "part", "chunk"]
    few = F.broadcast(chunks) if chunks.count() <= 100_000 else chunks
    guests = visits.join(few.drop("n"), ["dim", "cell", "part"]).withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int"))
    guests = guests.join(blocks.where("own").select("row", "a"), "row").select(*key, "row", "a")
    hosts = blocks.join(few.drop("n"), ["dim", "cell", "part"]).select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    hosts = hosts.select(*(F.col(c).alias(f"h_{c}") for c in (*key, "row", "a")))

    def meet(guest, host):
        if not len(guest) or not len(host):
            return _table(np.empty(0, np.int64), [])
        q, x, ids = _matrix(guest.column("a")), _matrix(host.column("h_a")), guest.column("row").to_numpy()
        return _table(ids, _nearest(ids, q, x, host.column("h_row").to_numpy(), k))

    abroad = guests.groupBy(*key).cogroup(hosts.groupBy(*(f"h_{c}" for c in key))).applyInArrow(meet, "row long, d array<double>")
    if report is not None:
        inside = blocks.groupBy("dim", "cell", "part").agg(F.count(F.lit(1)).alias("m"), F.count(F.when(F.col("own"), 1)).alias("mine"))
        compared = inside.join(chunks, ["dim", "cell", "part"], "left").agg(F.sum(F.col("m") * (F.col("mine") + F.coalesce("n", F.lit(0)))), F.sum("m"), F.sum("mine")).first()
        report.update(compared=compared[0] or 0, pairs=(compared[1] or 0) * (compared[2] or 0))
    least = F.slice(F.array_sort(F.flatten(F.collect_list("d"))), 1, k)
    merged = written(home.union(abroad).groupBy("row").agg(least.alias("d")), "nearest")
    mean = F.when(F.size("d") > 0, F.aggregate("d", F.lit(0.0), lambda s, v: s + v) / F.size("d"))
    out = own.select("ind_id", "row").join(merged.select("row", mean.alias("novelty")), "row", "left").select("ind_id", F.coalesce("novelty", F.lit(0.0)).alias("novelty"))
    discard(cells, blocks, home, visits, chunks)
    return out
