"""Importance resampling towards a target text collection, over hashed runs of words.

Every run of one to ``longest`` consecutive words, joined by blanks, is a feature; its bucket is its CRC-32 modulo the number of buckets. The
strings of runs are never made: each distinct word's CRC is taken once, and that of a run grows word by word, as

    crc(run + " " + word) = shift(crc(run), 1 + len(word)) ^ crc(" " + word),

where shift by n bytes is a 32 x 32 matrix over GF(2), a power of the matrix of one zero bit. Powers are composed from squarings and
applied to whole arrays by four tables of 256 entries.

One pass over the documents and one over the target count features a bucket; a task sends its counts alone, at most one row a
bucket. The log ratios (one number a bucket) go out with the second pass, which gives each document's weight. Gumbel noise from a
hash of the doc_id then makes the highest scores a draw without replacement. Ranks come from a range partitioning and one offset for
each of its parts, so no task sorts all rows.

Defined cases: a null or empty text has no features and the weight 0. A row without doc_id counts for the statistics but has
neither score nor rank, and isn't drawn. Rows that share a doc_id are documents of their own with equal noise; ties of score and
doc_id go by a row number, which only equal rows can differ in. Other columns are ignored, whatever their names. An empty table gives no rows; an empty target
makes every count of it 0.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytewords import byte_class, words_of_batch
from .common import release, written

WORD_BYTES = byte_class(string.digits + string.ascii_lowercase)
#: Rows that one task of the ranking sorts.
PART_ROWS = 1 << 20
#: Fixed value: the polynomial of CRC-32, lowest bit first.
POLYNOMIAL = 0xEDB88320


def _times(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The product over GF(2) of a matrix (the image of each bit) with each 32-bit vector."""
    out = np.zeros_like(vectors)
    for bit in range(32):
        out ^= np.where(vectors >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


@lru_cache(maxsize=64)
def _doubled(k: int) -> np.ndarray:
    """The shift by 2 ** k zero bytes."""
    if k > 0:
        half = _doubled(k - 1)
        return _times(half, half)
    m = np.array([POLYNOMIAL, *(1 << b for b in range(31))], np.uint32)  # one zero bit
    for _ in range(3):
        m = _times(m, m)
    return m


@lru_cache(maxsize=1024)
def shift_table(n: int) -> np.ndarray:
    """The shift of a CRC by ``n`` bytes, as images of each value of its four bytes (4 x 256)."""
    m = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for k in range(n.bit_length()):
        if n >> k & 1:
            m = _times(_doubled(k), m)
    byte = np.arange(256, dtype=np.uint32)
    return np.stack([_times(m, byte << np.uint32(8 * b)) for b in range(4)])


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC as it is after so many more bytes, before those are added."""
    sizes, at = np.unique(lengths, return_inverse=True)
    tables = np.stack([shift_table(int(n)) for n in sizes]) if len(sizes) else np.zeros((0, 4, 256), np.uint32)
    out = np.zeros(len(crcs), np.uint32)
    for b in range(4):
        out ^= tables[at, b, crcs >> np.uint32(8 * b) & np.uint32(255)]
    return out


def run_crcs(code: np.ndarray, text: np.ndarray, distinct: list, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``longest`` words: (text, CRC-32) of every run of so many words of one text."""
    own = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))
    spaced = shifted(np.full(len(own), zlib.crc32(b" "), np.uint32), size) ^ own
    crc = own[code]
    yield text, crc
    for k in range(1, longest):
        if len(code) <= k:
            return
        last = code[k:]
        crc = shifted(crc[:-1], 1 + size[last]) ^ spaced[last]
        same = text[k:] == text[:-k]
        yield text[k:][same], crc[same]


def _buckets(texts: pa.Array, longest: int, n_buckets: int) -> Iterator[tuple[int, int, np.ndarray, list]]:
    """For each run of texts: its first text, their number, each one's words, and (text, bucket) arrays."""
    for w in words_of_batch(texts, WORD_BYTES):
        found = [(t, (crc % np.uint32(n_buckets)).astype(np.int64)) for t, crc in run_crcs(w.code, w.text, w.distinct, longest)]
        yield w.first, w.n_texts, np.bincount(w.text, minlength=w.n_texts), found


def bucket_counts(docs: DataFrame, longest: int, n_buckets: int, text: str = "text") -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for _, _, _, found in _buckets(batch.column(0), longest, n_buckets):
                for _, bucket in found:
                    n += np.bincount(bucket, minlength=n_buckets)
        filled = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(filled, pa.int64()), "n": pa.array(n[filled], pa.int64())})

    return docs.select(F.col(text).cast("string")).mapInArrow(lambda batches: release(run(batches)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = 2, n_buckets: int = 10_000, text: str = "text") -> DataFrame:
    """(bucket, gain): floor(1000 * ln of the smoothed target frequency over that of the documents), for every bucket."""
    counted = bucket_counts(docs, longest, n_buckets, text).withColumnRenamed("n", "s")
    wanted = bucket_counts(target, longest, n_buckets, text).withColumnRenamed("n", "t")
    every = docs.sparkSession.range(n_buckets).withColumnRenamed("id", "bucket")
    both = written(every.join(counted, "bucket", "left").join(wanted, "bucket", "left").fillna(0), "bucket-counts")
    n_docs, n_target = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1.0) * float(n_docs + n_buckets) / ((F.col("s") + 1.0) * float(n_target + n_buckets))
    return both.select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, gain: np.ndarray, longest: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of a document's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, n_words, found in _buckets(batch.column(1), longest, len(gain)):
                size, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for t, bucket in found:
                    size += np.bincount(t, minlength=n)
                    # whole numbers below 2 ** 53, so doubles add them exactly
                    total += np.bincount(t, weights=gain[bucket], minlength=n).astype(np.int64)
                columns = [batch.column(0).slice(first, n), pa.array(n_words, pa.int64()), pa.array(size), pa.array(total // np.maximum(size, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(lambda batches: release(run(batches)), "doc_id long, n_words long, n_features long, weight long")


def draw(weighted: DataFrame, percent: int, seed: int, least_words: int, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds score and rank to (doc_id, n_words, weight, ...): the ``percent`` of highest scores of documents long enough are ranked from 1."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    scored = written(weighted.withColumn("score", F.col("weight") + noise).withColumn("_row", F.monotonically_increasing_id()), "scored")
    long_enough = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    n = scored.where(long_enough).count()
    order = [F.desc("score"), F.asc("doc_id"), F.asc("_row")]
    ranged = scored.where(long_enough).repartitionByRange(max(1, -(-n // part_rows)), *order).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "by-score")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order)) + F.col("_before")
    ranked = ranged.join(F.broadcast(before), "_part").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= n * percent // 100, F.col("rank")))
    others = scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*others.columns).union(others).drop("_row")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, least_words: int = 20, longest: int = 2, n_buckets: int = 10_000) -> DataFrame:
    """A row for each document: doc_id, n_words, n_features, weight, score, rank (null where it isn't drawn)."""
    found = gains(docs, target, longest, n_buckets).collect()
    gain = np.zeros(n_buckets, np.int64)
    gain[[r.bucket for r in found]] = [r.gain for r in found]
    return draw(weights(docs, gain, longest), percent, seed, least_words)


def oracle_sql(percent: int = 25, seed: int = 7, least_words: int = 20, n_buckets: int = 10_000) -> str:
    """The same for runs of one and two words, with CRC-32 byte by byte over the runs' strings."""
    text_words = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
    runs = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    step = "xor(c >> 8, k[(xor(c, ('0x' || h[2 * b + 1 : 2 * b + 2])::bigint) & 255) + 1])"
    return f"""with k as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: case when c & 1 = 1 then xor(c >> 1, {POLYNOMIAL}::bigint) else c >> 1 end, i::bigint)) as k),
d as (select row_number() over () as r, doc_id, {text_words} as w from documents), b as (select {text_words} as w from benchmark),
df as (select r, unnest({runs}) as f from d), bf as (select unnest({runs}) as f from b),
names as (select f, hex(encode(f)) as h from (select f from df union select f from bf)),
hashed as (select f, xor(list_reduce(range(len(h) // 2), lambda c, b: {step}, 4294967295::bigint), 4294967295::bigint) % {n_buckets} as bucket from names, k),
s as (select bucket, count(*) as s from df join hashed using (f) group by bucket), t as (select bucket, count(*) as t from bf join hashed using (f) group by bucket),
g as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from s) + {n_buckets})::double
  / ((s + 1)::double * ((select coalesce(sum(t), 0) from t) + {n_buckets})::double)))::bigint as gain from s left join t using (bucket)),
m as (select r, count(*) as n_features, floor(sum(gain)::hugeint / count(*)::double)::bigint as weight from df join hashed using (f) join g using (bucket) group by r),
x as (select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || sha256('{seed}:' || doc_id)[1:8])::bigint as h from d left join m using (r)),
y as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score, n_words >= {least_words} and doc_id is not null as fit from x),
z as (select *, case when fit then row_number() over (partition by fit order by score desc, doc_id) end as place, count(*) filter (fit) over () as n from y)
select doc_id, n_features, weight, score, case when place <= n * {percent} // 100 then place end as rank from z"""
