"""Blocks of consecutive rows as records, and exact ranks of many signals on them with one small exchange.

A block is one record: its rows' features, target and ranks as packed arrays, with copies of the rows before it that windows reach back to. Work on
blocks is a map over files, so no pass shuffles the panel again.

Ranks need an order over all rows, but only of values. First, blocks count their distinct values by the leading bits of an integer that sorts as the double does;
crowded leading bits are counted again by further ones. That cuts each signal's values into ranges of bounded size whose numbers of rows are known. Then
each block sends its distinct values of a range, sorted and packed, to the range's task, which knows the exact ranks of all of them. Signals
are computed again for each pass rather than written. A range may hold more than its bound only where one leading part can't be split, that is of one value in all blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import positions
from ..sources.shared import discard, written

#: Distinct values of all blocks that a range has at most, but for what can't be split.
RANGE_VALUES = 1 << 19

#: What a record's features and rank columns should take at most; a task holds several copies of a record.
BLOCK_BYTES = 8 << 20

#: Values of a block and signal that show where ranges of many rows should begin; numbers that a block says of a signal.
SAMPLED, MOMENTS = 64, 8

#: (signal of a block's rows, whether equal values share a rank); a signal is made of features with rank columns, and of the target.
Job = tuple[Callable[[np.ndarray, np.ndarray], np.ndarray], bool]


@dataclass(frozen=True)
class Blocks:
    """``tied``: for each rank column whether equal values share a rank. Rows from ``start`` to before ``stop`` count, and start anew from 0."""

    df: DataFrame
    n: int
    block_rows: int
    width: int
    reach: int
    tied: tuple[bool, ...] = ()
    start: int = 0
    stop: int | None = None
    shared: bool = False

    def slice(self, start: int, stop: int) -> Blocks:
        stop = min(stop, self.n)
        return replace(self, n=max(0, stop - start), start=self.start + start, stop=self.start + stop, shared=True)

    def drop(self) -> None:
        if not self.shared:
            discard(self.df)


def panel_blocks(panel: DataFrame, features: list[str], y: str, order: str, reach: int, block_rows: int, first: int | None = None) -> Blocks:
    """The panel's blocks; ``first``: ``order`` is dense and starts there."""
    own = panel.select(F.col(order).alias("_o"), *(F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)), F.col(y).cast("double").alias("y"))
    own = positions(own, ["_o"], "row").withColumn("row", F.col("row") - 1) if first is None else own.withColumn("row", F.col("_o") - first)
    size, width = max(block_rows, reach, 1), len(features)
    mine = F.expr(f"row div {size}")
    late = (F.lit(reach) > 0) & (F.col("row") % size >= size - reach)
    dealt = own.drop("_o").withColumn("block", F.explode(F.when(late, F.array(mine, mine + 1)).otherwise(F.array(mine))))

    def pack(key, table):
        row = table.column("row").to_numpy()
        order_ = np.argsort(row)
        block = key[0].as_py()
        halo = int((row < block * size).sum())
        if halo == len(row):
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        x = np.column_stack([table.column(f"f{k}").to_numpy()[order_] for k in range(width)]) if width else np.empty((len(row), 0))
        cells = ([block], [int(row.min())], [halo], [x.astype(float).tobytes()], [table.column("y").to_numpy()[order_].astype(float).tobytes()], [b""])
        return pa.table({c: pa.array(v, t) for (c, t), v in zip(kinds.items(), cells, strict=True)})

    kinds = {"block": pa.int64(), "first": pa.int64(), "halo": pa.int32(), "x": pa.binary(), "y": pa.binary(), "ranks": pa.binary()}
    df = written(dealt.groupBy("block").applyInArrow(pack, "block long, first long, halo int, x binary, y binary, ranks binary"), "panel-blocks")
    n = df.agg(F.coalesce(F.sum(F.length("y") / 8 - F.col("halo")), F.lit(0)).cast("long")).first()[0]
    return Blocks(df, n, size, width, reach)


def rows_within(cells: int, block_rows: int) -> int:
    """At most ``block_rows``, as many as ``BLOCK_BYTES`` hold with so many features and rank columns."""
    return max(1, min(block_rows, BLOCK_BYTES // (8 * max(1, cells))))


@dataclass
class Rows:
    """A block's rows: features behind which rank columns stand, the target, the number of copies in front, and the first own row's number."""

    block: int
    x: np.ndarray
    y: np.ndarray
    halo: int
    row: int
    features: np.ndarray
    ranks: np.ndarray


def _loaded(blocks: Blocks, record: dict) -> Rows | None:
    y = np.frombuffer(record["y"])
    x = np.frombuffer(record["x"]).reshape(len(y), blocks.width)
    ranks = np.frombuffer(record["ranks"], _kind(blocks)).reshape(len(blocks.tied), len(y))
    first, halo = record["first"], record["halo"]
    low, high = max(0, blocks.start - first), len(y) if blocks.stop is None else min(len(y), blocks.stop - first)
    halo = max(0, halo - low)
    if high - low <= halo:
        return None
    x, y, ranks = x[low:high], y[low:high], ranks[:, low:high]
    shown = [r / 2 if t else r / blocks.n for r, t in zip(ranks, blocks.tied, strict=True)]
    return Rows(record["block"], np.column_stack([x, *shown]) if shown else x, y, halo, first + low + halo - blocks.start, x, ranks)


def _kind(blocks: Blocks):
    return np.int32 if blocks.n < 1 << 29 else np.int64


def over_blocks(blocks: Blocks, jobs: int, work: Callable[[range, Rows], pa.Table], kinds: str) -> DataFrame:
    """``work(job numbers, rows)`` for every block; where blocks are fewer than cores, for every block and share of the jobs."""
    n_blocks = max(1, -(-blocks.n // blocks.block_rows))
    cores = blocks.df.sparkSession.sparkContext.defaultParallelism
    shares = max(1, min(jobs, cores // n_blocks))
    held = replace(blocks, df=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                record = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                rows = _loaded(held, record)
                if rows is not None:
                    with np.errstate(all="ignore"):
                        yield from work(range(record["share"], jobs, shares), rows).to_batches()

    dealt = blocks.df.withColumn("share", F.lit(0))
    if shares > 1:
        dealt = blocks.df.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(n_blocks * shares)
    return dealt.mapInArrow(run, kinds)


def sortable(v: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of doubles; 0 and -0 are equal, and NaN comes last."""
    bits = np.where(np.isnan(v), np.nan, np.asarray(v, float) + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))


def packed(a: np.ndarray) -> bytes:
    """Ascending integers as their first and the bytes of their steps, plane by plane, as many as the largest step needs."""
    steps = np.diff(a.astype(np.int64).view(np.uint64))
    wide = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return a[:1].astype(np.int64).tobytes() + bytes([wide]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8, offset=9).reshape(b[8], -1)
    steps = np.zeros((planes.shape[1] + 1, 8), np.uint8)
    steps[1:, : b[8]] = planes.T
    steps[0] = np.frombuffer(b[:8], np.uint8)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64).view(np.int64)


@dataclass(frozen=True)
class Ranges:
    """For each job the least values of its ranges, and how many rows come before each."""

    starts: list[np.ndarray]
    below: list[np.ndarray]

    def cut(self, k: int, values: np.ndarray) -> list[tuple[int, int, int]]:
        """(range, from, to) of sorted values."""
        at = [0, *np.searchsorted(values, self.starts[k][1:]).tolist(), len(values)]
        return [(b, i, j) for b, (i, j) in enumerate(zip(at, at[1:], strict=False)) if i < j]


def _counted(k: int, values: np.ndarray, m: np.ndarray, shift: int) -> tuple[np.ndarray, ...]:
    head = values >> shift
    at = np.flatnonzero(np.diff(head, prepend=head[:1] - 1))
    return np.full(len(at), k, np.int32), head[at], np.add.reduceat(m, at) if len(at) else m, np.diff(at, append=len(head))


def value_ranges(blocks: Blocks, signals: list[Callable], more: Callable[[range, Rows, dict[int, np.ndarray]], list[tuple]] | None = None, range_values: int | None = None) -> tuple[Ranges, list]:
    """The ranges of each signal's values, and the rows (k, numbers) that ``more`` makes of a block's own values, collected: one for each block and job."""
    bound = RANGE_VALUES if range_values is None else range_values
    kinds = "k int, head long, n long, m long, numbers array<double>"

    def table(parts: list[tuple], numbers: list[tuple]) -> pa.Table:
        cells = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 4
        names, types = ["k", "head", "n", "m", "numbers"], (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()))
        heads = pa.table([*(pa.array(c, t) for c, t in zip(cells, types, strict=False)), pa.nulls(len(cells[0]), types[4])], names=names)
        more_ = pa.table([pa.array([k for k, _ in numbers], types[0]), *(pa.nulls(len(numbers), t) for t in types[1:4]), pa.array([v for _, v in numbers], types[4])], names=names)
        return pa.concat_tables([heads, more_])

    def counts(shift: int, crowded: dict[int, np.ndarray] | None):
        def work(jobs: range, rows: Rows) -> pa.Table:
            parts, own = [], {}
            for k in jobs:
                if crowded is not None and k not in crowded:
                    continue
                v = signals[k](rows.x, rows.y)
                own[k] = v[rows.halo :]
                values, at = np.unique(sortable(v), return_inverse=True)
                m = np.bincount(at.ravel()[rows.halo :], minlength=len(values))
                if crowded is not None:
                    inside = np.isin(values >> (shift + 16), crowded[k])
                    values, m = values[inside], m[inside]
                if len(values):
                    parts.append(_counted(k, values, m, shift))
            return table(parts, more(jobs, rows, own) if more and crowded is None else [])

        return written(over_blocks(blocks, len(signals), work, kinds), "value-heads")

    found, tables = counts(48, None), []
    numbers = [(r.k, r.numbers) for r in found.where("numbers is not null").select("k", "numbers").collect()] if more else []
    leaves, shift = None, 48
    while True:
        tables.append(found)
        heads = written(found.where("head is not null").groupBy("k", "head").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "value-heads")
        tables.append(heads)
        crowd: dict[int, list] = {}
        for r in heads.where(F.col("m") > bound).select("k", "head").collect() if shift else []:
            crowd.setdefault(r.k, []).append(r["head"])
        kept = (heads.where(F.col("m") <= bound) if shift else heads).select("k", F.shiftleft("head", shift).alias("start"), "n", "m")
        leaves = kept if leaves is None else leaves.union(kept)
        if not crowd:
            break
        shift -= 16
        found = counts(shift, {k: np.array(v) for k, v in crowd.items()})
    before = W.partitionBy("k").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    placed = leaves.withColumns({"_m": F.coalesce(F.sum("m").over(before), F.lit(0)), "below": F.coalesce(F.sum("n").over(before), F.lit(0))})
    # a range begins with the first leaf beyond a multiple of the bound
    ranges = placed.groupBy("k", F.expr(f"_m div {bound}").alias("r")).agg(F.min("start").alias("start"), F.min("below").alias("below")).orderBy("k", "start").collect()
    own = [[r for r in ranges if r.k == k] for k in range(len(signals))]
    discard(*tables)
    return Ranges([np.array([r.start for r in o], np.int64) for o in own], [np.array([r.below for r in o], np.int64) for o in own]), numbers


def _joined(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, numbers of rows and the record of each value, of all records of a range."""
    values = [unpacked(v) for v in table.column("v").to_pylist()]
    m = [np.ones(len(v), np.int64) if c is None else np.frombuffer(c, np.int32).astype(np.int64) for v, c in zip(values, table.column("m").to_pylist(), strict=True)]
    return np.concatenate(values), np.concatenate(m), np.repeat(np.arange(len(values)), [len(v) for v in values])


def _few(m: np.ndarray) -> bytes | None:
    return None if (m == 1).all() else m.astype(np.int32).tobytes()


def tied_within(values: np.ndarray, m: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Twice the average rank from 1 of each entry, where ``m`` rows have it and ``below`` come before all; and the order of entries."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    first = np.flatnonzero(np.diff(s, prepend=s[:1] - 1))
    total = np.add.reduceat(m[order], first)
    ranks = 2 * (below + np.cumsum(total) - total) + total + 1
    out = np.empty(len(s), np.int64)
    out[order] = np.repeat(ranks, np.diff(first, append=len(s)))
    return out, order


def with_ranks(blocks: Blocks, jobs: list[Job], range_values: int | None = None) -> Blocks:
    """The blocks with a further rank column for each job: average ranks, or positions where equal values go by row."""
    signals, tied, wanted = [s for s, _ in jobs], [t for _, t in jobs], blocks.n
    ranges, _ = value_ranges(blocks, signals, None, range_values)

    def send(ks: range, rows: Rows) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("k", "r", "block", "v", "m")}
        for k in ks:
            values, at = np.unique(sortable(signals[k](rows.x, rows.y)), return_inverse=True)
            m = np.bincount(at.ravel()[rows.halo :], minlength=len(values))
            for r, i, j in ranges.cut(k, values):
                for o, v in zip(out.values(), (k, r, rows.block, packed(values[i:j]), _few(m[i:j])), strict=True):
                    o.append(v)
        return pa.table({c: pa.array(o, t) for (c, o), t in zip(out.items(), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)})

    def rank(key, table):
        k = key[0].as_py()
        table = table.sort_by("block")
        values, m, record = _joined(table)
        if tied[k]:
            place, _ = tied_within(values, m, 0)
        else:
            order, place = np.argsort(values, kind="stable"), np.empty(len(values), np.int64)
            place[order] = np.cumsum(m[order]) - m[order]
        ends = np.cumsum(np.bincount(record, minlength=len(table)))[:-1]
        return pa.table({"k": table.column("k"), "r": table.column("r"), "block": table.column("block"), "p": pa.array([packed(p) for p in np.split(place, ends)], pa.binary())})

    sent = over_blocks(blocks, len(jobs), send, "k int, r int, block long, v binary, m binary")
    back = sent.groupBy("k", "r").applyInArrow(rank, "k int, r int, block long, p binary")
    held, kind = replace(blocks, df=None), _kind(blocks)

    def put(own, found):
        record = own.to_pylist()
        rows = _loaded(held, record[0]) if record else None
        if rows is None:
            return own.schema.empty_table()
        parts: dict[int, list] = {}
        for r in sorted(found.to_pylist(), key=lambda r: r["r"]):
            parts.setdefault(r["k"], []).append(unpacked(r["p"]) + int(ranges.below[r["k"]][r["r"]]) * (2 if tied[r["k"]] else 1))
        more = []
        for k, signal in enumerate(signals):
            with np.errstate(all="ignore"):
                values, at = np.unique(sortable(signal(rows.x, rows.y)), return_inverse=True)
            at, place = at.ravel(), np.concatenate(parts[k])
            if not tied[k]:
                # the copies in front are the last rows of their value before the block
                order = np.argsort(at, kind="stable")
                total = np.bincount(at, minlength=len(values))
                nth = np.empty(len(at), np.int64)
                nth[order] = np.arange(len(at)) - np.repeat(np.cumsum(total) - total, total)
                more.append(place[at] - np.bincount(at[: rows.halo], minlength=len(values))[at] + nth + 1)
            else:
                more.append(place[at])
        ranks = np.concatenate([rows.ranks, np.array(more).astype(kind)]).astype(kind)
        cells = {"block": [rows.block], "first": [rows.row - rows.halo], "halo": [rows.halo], "x": [rows.features.tobytes()], "y": [rows.y.tobytes()], "ranks": [ranks.tobytes()]}
        return pa.table({f.name: pa.array(cells[f.name], f.type) for f in own.schema})

    df = written(blocks.df.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(put, blocks.df.schema), "ranked-blocks")
    blocks.drop()
    return Blocks(df, wanted, blocks.block_rows, blocks.width, blocks.reach, (*blocks.tied, *tied))


SENT = "k int, r int, v binary, m binary, q binary"


def _beside_target(ks: range, rows: Rows, signal: Callable[[int], np.ndarray], targets: list[int], ranges: Ranges) -> pa.Table:
    """A block's distinct values of each signal by ranges, how often each occurs, and the sum of the target's ranks there."""
    out: dict[str, list] = {c: [] for c in ("k", "r", "v", "m", "q")}
    for k in ks:
        values, at, m = np.unique(sortable(signal(k)), return_inverse=True, return_counts=True)
        # twice the target's ranks, whole numbers below 2 ** 53
        q = np.bincount(at.ravel(), rows.ranks[targets[k]][rows.halo :], len(values))
        q = q.astype(np.int32 if q.max(initial=0) < 1 << 31 else np.int64)
        for r, i, j in ranges.cut(k, values):
            for o, v in zip(out.values(), (k, r, packed(values[i:j]), _few(m[i:j]), bytes([q.itemsize]) + q[i:j].tobytes()), strict=True):
                o.append(v)
    return pa.table({c: pa.array(o, t) for (c, o), t in zip(out.items(), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)})


def _target_ranks(table: pa.Table) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, np.int32 if b[0] == 4 else np.int64, offset=1).astype(float) for b in table.column("q").to_pylist()]) / 2


def sampled_starts(blocks: Blocks, signals: list[Callable], bound: int) -> Ranges:
    """Ranges of about ``bound`` rows, by evenly spaced values of every block; how many rows come before each isn't known. For few signals."""

    def work(jobs: range, rows: Rows) -> pa.Table:
        own = [np.sort(sortable(signals[k](rows.x, rows.y)[rows.halo :])) for k in jobs]
        step = max(1, len(rows.y) // SAMPLED)
        return pa.table({"k": pa.array(jobs, pa.int32()), "step": pa.array([step] * len(own), pa.int64()), "v": pa.array([v[::step].tolist() for v in own], pa.list_(pa.int64()))})

    found: dict[int, list] = {}
    # SAMPLED values for each block and signal
    for r in over_blocks(blocks, len(signals), work, "k int, step long, v array<long>").collect():
        found.setdefault(r.k, []).append((np.array(r.v, np.int64), r.step))
    starts = []
    for k in range(len(signals)):
        values, m = np.concatenate([v for v, _ in found[k]]), np.concatenate([np.full(len(v), step) for v, step in found[k]])
        order = np.argsort(values, kind="stable")
        starts.append(np.unique(values[order][np.flatnonzero(np.diff(np.cumsum(m[order]) // bound, prepend=-1))]))
    return Ranges(starts, [])


def rank_products(blocks: Blocks, signals: list[Callable], target: int, more: Callable[[range, Rows, dict[int, np.ndarray]], list[tuple]]) -> tuple[list[tuple[float, float]], list[tuple]]:
    """For each signal the squares of its average ranks from their mean and their products with those of the rank column ``target``; and the rows of ``more``.

    One exchange, before it a look at each block's values if there are more rows than a range should hold. A range knows the ranks within it; as
    they balance around its middle, the rows before it are added behind.
    """
    n, bound = blocks.n, RANGE_VALUES
    ranges = sampled_starts(blocks, signals, bound) if n > bound else Ranges([np.zeros(1, np.int64)] * len(signals), [])
    centre = (n + 1) / 2

    def send(ks: range, rows: Rows) -> pa.Table:
        own = {k: signals[k](rows.x, rows.y)[rows.halo :] for k in ks}
        numbers, sent = more(ks, rows, own), _beside_target(ks, rows, own.__getitem__, [target] * len(signals), ranges)
        none = [None] * len(numbers)
        apart = pa.table([[k for k, _ in numbers], [-1] * len(numbers), [np.array(v).tobytes() for _, v in numbers], none, none], schema=sent.schema)
        return pa.concat_tables([sent, apart])

    def summed(key, table):
        r = key[1].as_py()
        if r < 0:
            found = (0, 0.0, 0.0, 0.0, [float(v) for b in table.column("v").to_pylist() for v in np.frombuffer(b)])
        else:
            values, m, _ = _joined(table)
            rows = int(m.sum())
            off, q = tied_within(values, m, 0)[0] / 2 - (rows + 1) / 2, _target_ranks(table) - m * centre
            found = (rows, float((m * off * off).sum()), float(q.sum()), float((q * off).sum()), None)
        cells = (key[0].as_py(), r, *found)
        return pa.table([pa.array([c], t) for c, t in zip(cells, (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64())), strict=True)], names=["k", "r", "n", "rr", "q", "rq", "numbers"])

    sent = over_blocks(blocks, len(signals), send, SENT)
    out, numbers, below = [[0.0, 0.0] for _ in signals], [], [0] * len(signals)
    # a row for each range, and the blocks' numbers
    for p in sorted(sent.groupBy("k", "r").applyInArrow(summed, "k int, r int, n long, rr double, q double, rq double, numbers array<double>").collect(), key=lambda p: (p.k, p.r)):
        if p.r < 0:
            numbers += [(p.k, list(v)) for v in np.array(p.numbers).reshape(-1, MOMENTS)]
            continue
        ahead = below[p.k] + (p.n + 1) / 2 - centre
        out[p.k][0] += p.rr + p.n * ahead * ahead
        out[p.k][1] += p.rq + ahead * p.q
        below[p.k] += p.n
    return [(rr, rq) for rr, rq in out], numbers


def rank_sums(blocks: Blocks, signals: list[Callable], targets: list[int], ranges: Ranges, bins: int) -> dict[int, tuple[float, float, list[int]]]:
    """For each signal, the squares of its average ranks from their mean, their products with those of the rank column ``targets[k]``, and rows by tenths of ranks.

    ``bins``: so many parts instead of tenths.
    """
    n, centre = blocks.n, (blocks.n + 1) / 2

    def summed(key, table):
        k, r = key[0].as_py(), key[1].as_py()
        values, m, _ = _joined(table)
        q = _target_ranks(table)
        rank = tied_within(values, m, int(ranges.below[k][r]))[0] / 2
        off = rank - centre
        part = np.minimum(np.ceil(rank / float(n) * bins), bins).astype(int) - 1
        rows = np.bincount(part, m, bins).astype(np.int64).tolist()
        return pa.table({"k": pa.array([k], pa.int32()), "rr": [float((m * off * off).sum())], "rq": [float(((q - m * centre) * off).sum())], "rows": pa.array([rows], pa.list_(pa.int64()))})

    sent = over_blocks(blocks, len(signals), lambda ks, rows: _beside_target(ks, rows, lambda k: signals[k](rows.x, rows.y)[rows.halo :], targets, ranges), SENT)
    parts = sent.groupBy("k", "r").applyInArrow(summed, "k int, rr double, rq double, rows array<long>")
    out = parts.groupBy("k").agg(F.sum("rr").alias("rr"), F.sum("rq").alias("rq"), *(F.sum(F.col("rows")[b]).alias(f"b{b}") for b in range(bins)))
    # one row for each signal
    return {r.k: (r.rr, r.rq, [r[f"b{b}"] for b in range(bins)]) for r in out.collect()}
