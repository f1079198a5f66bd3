"""Helpers that the operators share: inputs, the shared folder and word splitting."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, written  # noqa: F401

#: Fixed value: what separates words, as a class body for Java and Python patterns.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


#: Functions that drop what an operator keeps in its workers from task to task; a module adds its own when it is imported.
drop_kept: list[Callable[[], None]] = []


def release(batches: Iterator, keep: bool = False) -> Iterator:
    """The batches; when they end, the worker gives the memory that it has freed back to the system.

    Workers live on between stages, so what one stage has freed but kept would add to the next one's peak. What operators keep from
    task to task goes before the first batch, unless the task is of one that uses it (``keep``).
    """
    if not keep:
        for drop in drop_kept:
            drop()
        _trim()
    yield from batches
    _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+"), lambda w: w != "")


#: Up to so many groups their bounds are broadcast.
FEW_GROUPS = 10_000
#: A table of up to so many rows of two numbers is broadcast (some 20 bytes each).
BROADCAST_ROWS = 200_000
#: A group is dealt to so many tasks for its first cut.
PARTS = 64


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def bounded_sample(rows: DataFrame, group: str, most: int) -> DataFrame:
    """The ``most`` rows of each group with the least hash of all their columns, for models that learn from a bounded sample.

    All rows of a group that has no more are taken. Only hashes are ranked: first in parts of each group, of which no more than ``most``
    are kept, then in the group. The rows are those up to the group's last hash; of equal rows as many as are still missing.
    """
    hashed = rows.withColumn("_tie", F.xxhash64(F.lit(7), *rows.columns))

    def least(df: DataFrame, *by) -> DataFrame:
        return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("_tie"))).where(F.col("_r") <= most).drop("_r")

    first = least(hashed.select(group, "_tie").withColumn("_part", F.pmod("_tie", F.lit(PARTS))), group, "_part").drop("_part")
    last = written(least(first, group).groupBy(F.col(group).alias("_g")).agg(F.max("_tie").alias("_last")), "last-hashes")
    last = F.broadcast(last) if last.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else last
    near = hashed.join(last, F.col(group) == F.col("_g")).where("_tie <= _last")
    return written(least(near, group).select(*rows.columns), "sample")
