"""Token-id files: Elias-Fano coded document boundaries over one concatenated id array.

A file is a sequence of blocks. A block holds the ids of whole documents in ascending document order and two Elias-Fano
sequences: the documents' bounds in the id array and their doc_ids. Both give any entry by ``select`` without a table of
64-bit offsets: about 2 + log2(universe / n) bits an entry and 32 bits for each 64 entries.

The blocks of a corpus are binary values of a Parquet table in the shared folder, so any store that Spark writes to will do and
task commits make retries safe. ``(shard, block)`` orders them; ``export`` puts a shard into one plain file.

Defined cases: a null text is an empty document. A null doc_id sorts first and stays null. Rows with the same doc_id are separate
documents, ordered by their text's hash. Other columns are ignored, whatever their names. An empty table gives a file without blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .tokenizing import encoder

MAGIC, HEADER = b"EFTOKEN1", struct.Struct("<8sQQQqIQQ")
EF_HEADER = struct.Struct("<QQBQ")
SAMPLE = 64
#: A block ends with the document that brings it to so many ids.
BLOCK_TOKENS = 1 << 18
BLOCKS = "shard int, block int, before long, n_tokens long, data binary"


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.packbits(((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return EF_HEADER.pack(self.n, len(self.low), self.low_bits, len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, n_low, bits, n_high = EF_HEADER.unpack_from(data)
        at = EF_HEADER.size
        low, high = (np.frombuffer(data, np.uint8, size, at + skip) for size, skip in ((n_low, 0), (n_high, n_low)))
        return cls(n, bits, low, high, np.frombuffer(data, "<u4", -(-n // SAMPLE), at + n_low + n_high))

    def select(self, i: int) -> int:
        """Entry ``i``: from the sampled one before it, bits are counted up to the i-th one."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, here = start // 8, int(self.high[start // 8]) >> (start % 8) << (start % 8)
        while left >= (ones := here.bit_count()):
            left -= ones
            byte += 1
            here = int(self.high[byte])
        for _ in range(left):
            here &= here - 1
        one = 8 * byte + (here & -here).bit_length() - 1
        first = i * self.low_bits
        window = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little") >> (first % 8)
        return (one - i) << self.low_bits | window & ((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        """All entries at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.int64)
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return (ones - np.arange(self.n)) << self.low_bits | low @ (1 << np.arange(self.low_bits, dtype=np.int64))


class Block:
    """A block of a token file, read in place."""

    def __init__(self, data: bytes):
        magic, self.n_docs, self.n_null, self.width, self.base, n_bounds, n_doc_ids, n_ids = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block of a token file")
        at = HEADER.size
        self.bounds = EliasFano.from_bytes(data[at : at + n_bounds])
        self._doc_ids = EliasFano.from_bytes(data[at + n_bounds : at + n_bounds + n_doc_ids])
        self.ids = np.frombuffer(data, f"<u{self.width}", n_ids, at + n_bounds + n_doc_ids)

    @staticmethod
    def build(doc_ids: list[int | None], bounds: np.ndarray, ids: np.ndarray) -> bytes:
        known = [x for x in doc_ids if x is not None]
        base = known[0] if known else 0
        first, second = EliasFano.build(bounds).to_bytes(), EliasFano.build(np.array([x - base for x in known], np.int64)).to_bytes()
        head = HEADER.pack(MAGIC, len(doc_ids), len(doc_ids) - len(known), ids.dtype.itemsize, base, len(first), len(second), len(ids))
        return head + first + second + ids.tobytes()

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + (self._doc_ids.values() + self.base).tolist()

    def document(self, i: int) -> np.ndarray:
        """The ids of document ``i`` of the block, by two selects."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def _blocks(shard: int, batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple]:
    enc = encoder(path)
    doc_ids, parts, size, before, block = [], [], 0, 0, 0
    for batch in batches:
        keys = batch.column(0).to_pylist()
        for first, ids, bounds in enc.encode(batch.column(1)):
            for k in range(len(bounds) - 1):
                doc_ids.append(keys[first + k])
                parts.append(np.append(ids[bounds[k] : bounds[k + 1]], enc.dtype.type(end_id)))
                size += len(parts[-1])
                if size >= BLOCK_TOKENS:
                    yield shard, block, before, size, _block(doc_ids, parts)
                    doc_ids, parts, size, before, block = [], [], 0, before + size, block + 1
    if parts:
        yield shard, block, before, size, _block(doc_ids, parts)


def _block(doc_ids: list, parts: list[np.ndarray]) -> bytes:
    return Block.build(doc_ids, np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.concatenate(parts))


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes whole texts, ends each with ``end_id`` and writes blocks in ascending doc_id order; gives the written blocks.

    The texts are dealt by range of (doc_id, hash of the text), so a repeated doc_id doesn't pile up in one task; they cross the
    network once, before encoding. ``before`` counts the shard's ids in earlier blocks.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for row in _blocks(TaskContext.get().partitionId(), batches, tokenizer_path, end_id):
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "block", "before", "n_tokens", "data"), row, strict=True))], schema=schema)

    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return written(ordered.mapInArrow(encode, BLOCKS), "token-files")


def shard_starts(blocks: DataFrame) -> DataFrame:
    """(shard, first): the ids of all shards before it. There is a shard for each task that wrote, so the list is short at any size."""
    sizes = sorted((r.shard, r.n) for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    ends = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    return blocks.sparkSession.createDataFrame([(s, ends[i]) for i, (s, _) in enumerate(sizes)], "shard int, first long")


def read_documents(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """A row for each document of the files: doc_id, start in the whole corpus, n_tokens, ids_crc32, and ids where asked for."""

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for row in range(frame.num_rows):
                start, data = frame.column(0)[row].as_py(), frame.column(1)[row].as_py()
                block = Block(data)
                bounds = np.fromiter((block.bounds.select(i) for i in range(block.n_docs + 1)), np.int64, block.n_docs + 1)
                wide = block.ids.astype("<u4")
                out = {
                    "doc_id": pa.array(block.doc_ids(), pa.int64()),
                    "start": pa.array(start + bounds[:-1]),
                    "n_tokens": pa.array(np.diff(bounds)),
                    "ids_crc32": pa.array([zlib.crc32(wide[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(wide.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    placed = blocks.join(F.broadcast(shard_starts(blocks)), "shard").select((F.col("first") + F.col("before")).alias("start"), "data")
    return placed.mapInArrow(read, schema)


def export(blocks: DataFrame, shard: int, path: str) -> int:
    """Writes one shard's blocks to a plain local file, one behind the other, each behind its length; gives the number of blocks."""
    n = 0
    with open(path, "wb") as out:
        for row in blocks.where(F.col("shard") == shard).orderBy("block").toLocalIterator():
            out.write(struct.pack("<Q", len(row.data)) + row.data)
            n += 1
    return n


def token_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes the token files of ``docs`` and reads every document back from them."""
    return read_documents(write_token_files(docs, tokenizer_path, end_id))
