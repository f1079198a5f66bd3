"""Best-fit packing planned on the histogram of lengths.

Documents are cut into pieces of at most ``max_len`` tokens. Only the number of pieces of each length reaches the driver, at most
``max_len`` numbers at any corpus size. Best-fit-decreasing runs over these counts and gives runs of slots: the pieces of a length
whose ranks lie in a run go into equal bins, one behind the other. Each piece then finds its slot by its rank within its length.

The rank is the piece's number among the pieces of its length in its task plus the pieces of that length in earlier tasks, so a
length that holds a third of all rows is not gathered anywhere. The pieces are written once, which fixes the ranks.

Defined cases: a null or empty text is the end token alone. Rows with the same doc_id, or none, are documents of their own. Other
columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import release, written
from .tokenizing import encoder

#: A plan of more runs than this is joined by a shuffle instead of being broadcast (about 50 bytes a run).
BROADCAST_RUNS = 100_000
#: Characters that are encoded in one go: few, as the pipeline's executors still hold what the stages before have left.
CHUNK_CHARS = 1_000_000


class Run(NamedTuple):
    """Pieces of ``length`` with ranks from ``first``: ``n`` of them, ``each`` to a bin from ``bin`` on, behind ``offset`` tokens."""

    length: int
    first: int
    n: int
    each: int
    bin: int
    offset: int


def best_fit_plan(counts: dict[int, int], max_len: int) -> tuple[list[Run], int]:
    """Best-fit-decreasing over counts; gives the runs and the number of bins.

    Bins of one history are kept as a range. Equal pieces fill a bin before the next one is touched, because the bin just used
    has the least room that still fits.
    """
    runs: list[Run] = []
    open_bins: dict[int, list[tuple[int, int]]] = {}
    rooms, n_bins = 0, 0  # rooms: bit r is set if a bin has room r

    def put(room: int, first: int, n: int) -> None:
        nonlocal rooms
        if room and n:
            open_bins.setdefault(room, []).append((first, n))
            rooms |= 1 << room

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fits = rooms >> length << length
            if fits:
                room = (fits & -fits).bit_length() - 1
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    rooms ^= 1 << room
            else:
                room, first, n = max_len, n_bins, -(-left // (max_len // length))
                n_bins += n
            each = room // length
            full = min(n, left // each)
            for bins, per_bin in ((full, each), (int(full < n and 0 < left - full * each), left - full * each)):
                if bins:
                    runs.append(Run(length, rank, bins * per_bin, per_bin, first, max_len - room))
                    put(room - per_bin * length, first, bins)
                    rank, left, first, n = rank + bins * per_bin, left - bins * per_bin, first + bins, n - bins
            put(room, first, n)
    return runs, n_bins


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, max_len: int = 2048, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents with their ids' checksum, and the ids where asked for; ``task`` and ``nth`` make the rank."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task, seen = encoder(tokenizer_path), TaskContext.get().partitionId(), np.zeros(max_len + 1, np.int64)
        for batch in batches:
            for first, ids, bounds in enc.encode(batch.column(1), CHUNK_CHARS):
                rows = {k: [] for k in schema.names}
                for k in range(len(bounds) - 1):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], enc.dtype.type(end_id)).astype("<u4")
                    key = batch.column(0)[first + k].as_py()
                    for at in range(0, len(own), max_len):
                        part = own[at : at + max_len]
                        values = (key, at // max_len, at, len(part), zlib.crc32(part), task, int(seen[len(part)]))
                        seen[len(part)] += 1
                        for name, value in zip(rows, (*values, part.astype(np.int32)) if with_ids else values, strict=True):
                            rows[name].append(value)
                yield pa.RecordBatch.from_pydict(rows, schema=schema)

    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda batches: release(cut(batches), keep=True), kinds)


def place(pieces: DataFrame, max_len: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to written pieces (any columns, with length, task and nth)."""
    spark = pieces.sparkSession
    dealt = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    dealt = written(dealt, "lengths")
    counts = {r.length: r.n for r in dealt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = best_fit_plan(counts, max_len)
    # from Arrow, as a list would start a second set of Python workers that stay beside the first
    columns = np.array(runs, np.int64).reshape(-1, len(Run._fields)).T
    plan = spark.createDataFrame(pa.table({f"r_{name}": pa.array(c) for name, c in zip(Run._fields, columns, strict=True)}))
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = dealt.select(F.col("task").alias("b_task"), F.col("length").alias("b_length"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, (F.col("task") == F.col("b_task")) & (F.col("length") == F.col("b_length"))).withColumn("rank", F.col("before") + F.col("nth"))
    own = (F.col("length") == F.col("r_length")) & (F.col("rank") >= F.col("r_first")) & (F.col("rank") < F.col("r_first") + F.col("r_n"))
    placed = ranked.join(F.broadcast(plan) if len(runs) <= BROADCAST_RUNS else plan, own)
    i = F.col("rank") - F.col("r_first")
    return placed.select(
        *(c for c in pieces.columns if c not in ("task", "nth")),
        (F.col("r_bin") + F.floor(i / F.col("r_each"))).cast("long").alias("sequence_id"),
        (F.col("r_offset") + i % F.col("r_each") * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, max_len: int = 2048, with_ids: bool = False) -> DataFrame:
    """Tokenises, cuts and places all documents; a row for each piece."""
    return place(written(token_pieces(docs, tokenizer_path, end_id, max_len, with_ids), "pieces"), max_len)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves (placed with ids): sequence_id, ids, and each piece's doc_id and offset."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    grouped = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))
