"""Exact top-k by inner product over a bit-sliced index.

Vectors are turned into integers floor(scale * x). A block holds up to ``BLOCK_ROWS`` of them, and for each component and each bit
one bitmap over the rows (of the value less the block's least value of that component). A query's weight is written in digits
-1, 0, 1; a digit times a bit is a bitmap of known weight, or for -1 the complement and a constant. All bitmaps of a weight are
added with carry-save adders, three bitmaps to a sum and a carry, many at a time, until one bitmap is left for each weight: the
scores of all rows of the block, sliced by bit. The k best rows are selected from the most significant slice down; rows that tie
at the boundary are resolved by their id, and the scores of the selected rows are read back from the slices, so all is exact.

Rows are dealt to blocks and written once. The queries come to the blocks where they lie, in groups of ``GROUP_BYTES`` at most, each
broadcast for one pass over the index without an exchange. A block's k best of a query are merged by rank.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite component, and rows without an id, take no part.
Queries and rows of different length don't meet. Components may be of any size: values and scores beyond 64 bits are exact Python
integers, ranks follow them, and only the score that is returned ends at a long's ends. A vector whose scaled component is beyond
a double's range counts as non-finite. A query's own rows are all rows with its id; of rows that share an id every one is a candidate, and the least vector makes the query. Other columns
are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

BLOCK_ROWS, LEAST_ROWS, GROUP_BYTES, LONG = 1 << 15, 1 << 10, 16 << 20, 1 << 63


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as a whole double; null if one of them can't be used."""
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    usable = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # doubles from 2 ** 52 on are whole, and floor() would turn them into longs
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x))
    return F.when(usable & (F.size(vector) > 0), whole)


def integers(rows: list | np.ndarray) -> np.ndarray:
    """Whole doubles as integers: 64-bit ones where no difference of two can overflow, else Python's."""
    x = np.asarray(rows, float)
    return x.astype(np.int64) if not x.size or np.abs(x).max() < 2.0**61 else np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def order_key(score: int) -> bytes:
    """Bytes in the order of the scores, of any size."""
    size = (abs(score).bit_length() + 7) // 8
    if score >= 0:
        return b"\x01" + size.to_bytes(2, "big") + score.to_bytes(size, "big")
    return b"\x00" + (0xFFFF - size).to_bytes(2, "big") + (256**size - 1 + score).to_bytes(size, "big")


def digits(w: int) -> list[tuple[int, int]]:
    """(power, sign) of the digits of ``w`` in non-adjacent form."""
    out, a = [], 0
    while w:
        if w & 1:
            d = 2 - (w & 3)
            out.append((a, d))
            w -= d
        w >>= 1
        a += 1
    return out


class BitSlices:
    """Bitmaps of a block of integer vectors; rows are in ascending order of id."""

    def __init__(self, ids: np.ndarray, least: np.ndarray, slices: np.ndarray):
        self.ids, self.least, self.slices = ids, least, slices  # slices: component, bit, words of 64 rows

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> BitSlices:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        least = vectors.min(0)
        above = vectors - least
        bits = max(1, int(above.max()).bit_length())
        words = -(-len(ids) // 64)
        packed = np.zeros((vectors.shape[1], bits, words * 8), np.uint8)
        for b in range(bits):
            p = np.packbits(((above >> b) & 1).astype(np.uint8), axis=0, bitorder="little")
            packed[:, b, : len(p)] = p.T
        return cls(ids, least, packed.view(np.uint64))

    def to_row(self) -> dict:
        return {"n": len(self.ids), "bits": self.slices.shape[1], "ids": self.ids.astype("<i8").tobytes(), "least": ",".join(map(str, self.least.tolist())), "slices": self.slices.tobytes()}

    @classmethod
    def from_row(cls, dim: int, bits: int, ids: bytes, least: str, slices: bytes) -> BitSlices:
        return cls(np.frombuffer(ids, "<i8"), np.array([int(x) for x in least.split(",")], object), np.frombuffer(slices, np.uint64).reshape(dim, bits, -1))

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """The slices of every row's score, least significant first, and what is to be added to it."""
        bits, words = self.slices.shape[1:]
        added = sum(q * x for q, x in zip(query.tolist(), self.least.tolist(), strict=True))
        at: dict[int, tuple[list, list, list]] = {}
        for j, w in enumerate(query.tolist()):
            for a, sign in digits(w):
                for b in range(bits):
                    js, bs, flip = at.setdefault(a + b, ([], [], []))
                    js.append(j)
                    bs.append(b)
                    flip.append(sign < 0)
                    if sign < 0:
                        added -= 1 << (a + b)
        out: list[np.ndarray] = []
        carries: list[np.ndarray] = []
        weight, last = 0, max(at, default=-1)
        while weight <= last or carries:
            js, bs, flip = at.get(weight, ([], [], []))
            own = self.slices[js, bs] if js else np.empty((0, words), np.uint64)
            own = own ^ np.where(flip, ~np.uint64(0), np.uint64(0))[:, None] if js else own
            x, up = np.concatenate([own, *carries]), []
            while len(x) > 2:
                k = len(x) // 3
                a, b, c = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
                u = a ^ b
                up.append((a & b) | (u & c))
                x = np.concatenate([u ^ c, x[3 * k :]])
            if len(x) == 2:
                up.append((x[:1] & x[1:]))
                x = x[:1] ^ x[1:]
            out.append(x[0] if len(x) else np.zeros(words, np.uint64))
            carries = up
            weight += 1
        return out, added

    def top(self, query: np.ndarray, k: int, own: int | None = None) -> list[tuple[int, int]]:
        """The ``k`` best (id, score), best first, ties to the smaller id; rows with the id ``own`` are left out."""
        n, words = len(self.ids), self.slices.shape[2]
        alive = np.zeros(words * 64, np.uint8)
        alive[:n] = 1
        if own is not None:
            alive[np.searchsorted(self.ids, own, "left") : np.searchsorted(self.ids, own, "right")] = 0
        tied = np.packbits(alive, bitorder="little").view(np.uint64)
        sure, (slices, added) = np.zeros(words, np.uint64), self.scores(query)
        for s in reversed(slices):
            more = sure | (tied & s)
            found = int(np.bitwise_count(more).sum())
            if found > k:
                tied = tied & s
            else:
                sure, tied = more, tied & ~s
                if found == k:
                    tied = np.zeros_like(tied)
                    break
        rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        rest = np.flatnonzero(np.unpackbits(tied.view(np.uint8), bitorder="little"))[: max(0, k - len(rows))]
        rows = np.concatenate([rows, rest])
        scores = [added + sum(int(s[r >> 6] >> np.uint64(r & 63) & np.uint64(1)) << i for i, s in enumerate(slices)) for r in rows.tolist()]
        return sorted(zip(self.ids[rows].tolist(), scores, strict=True), key=lambda x: (-x[1], x[0]))


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks (block, dim, n, bits, ids, least, slices) of (vec_id, v); written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, held = TaskContext.get().partitionId(), 0, {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, rows = held.pop(dim)
            made += 1
            row = {"block": (task << 32) + made, "dim": dim, **BitSlices.build(np.array(ids, np.int64), integers(rows)).to_row()}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, rows = held.setdefault(len(v), ([], []))
                ids.append(i)
                rows.append(v.values.to_numpy())
                if len(ids) >= block_rows:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("bits", pa.int32()), ("ids", pa.binary()), ("least", pa.string()), ("slices", pa.binary())])
    count = vectors.count()
    # smaller blocks where there are few, so that each task has its own
    block_rows = min(block_rows, max(LEAST_ROWS, -(-count // (2 * vectors.sparkSession.sparkContext.defaultParallelism))))
    n = max(1, -(-count // block_rows))
    kinds = "block long, dim int, n int, bits int, ids binary, least string, slices binary"
    return written(vectors.select("vec_id", "v").repartition(n).mapInArrow(run, kinds), "bit-slices")


def search(index: DataFrame, queries: DataFrame, k: int, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of the index for each query (query_id, v)."""
    spark = index.sparkSession
    n_queries, n_values = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    n_groups = max(1, -(-8 * (n_queries + n_values) // group_bytes))
    dealt, found = queries.select("query_id", "v").withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(n_groups))), []
    for g in range(n_groups):
        asked = spark.sparkContext.broadcast([(r.query_id, np.array(r.v)) for r in dealt.where(F.col("g") == g).select("query_id", "v").collect()])

        def run(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    block = BitSlices.from_row(row["dim"], row["bits"], row["ids"], row["least"], row["slices"])
                    best = [(q, i, s) for q, v in asked.value if len(v) == row["dim"] for i, s in block.top(integers([v])[0], k, q)]
                    q, i, s = zip(*best, strict=True) if best else ((), (), ())
                    scores = pa.array([max(-LONG, min(LONG - 1, x)) for x in s], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), scores, pa.array(map(order_key, s), pa.binary())], names=["query_id", "vec_id", "score", "key"])

        found.append(written(index.mapInArrow(run, "query_id long, vec_id long, score long, key binary"), "near"))
        asked.unpersist()
    best = W.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    return reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    return table.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(embedding), scale).alias("v")).where("vec_id is not null and v is not null")
