"""The novelty archive over a stream of fingerprints of any length.

Admission is sequential: a fingerprint enters if its mean distance to its k nearest entries exceeds the entries' own mean novelty, and a full
archive first gives up its least novel entry. Most fingerprints of a long stream are refused, and that can be told without their turn:
as long as no more than ``slack`` entries have gone since a snapshot, the novelty of a fingerprint isn't above the mean of its distances
number slack + 1 to slack + k to the snapshot's entries, as new entries only bring neighbours nearer. So executors drop all whose bound is at or below a floor a
little under the threshold; the rest take their turn in order on the driver, a bounded number at a time. When the threshold falls below
the floor, or more entries have gone, the rest of the stream is filtered anew.

An archive can stay small for ever, so executors refuse from the first entries on: nothing goes while there is room, and with fewer than k
entries the novelty is told as it is, which holds until another one enters. A stretch of the stream has twice the rows that the last round
got through, and where that was fewer than take their turn at once, the next ones all do. So the rows read grow with the stream,
however often rounds are broken off.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import positions
from ..sources.shared import discard, written
from .neighbours import distances

#: Entries that may go, how far below the threshold the floor lies, fingerprints that take their turn in one round, and those of the first stretch of the stream.
SLACK, MARGIN, TURNS, FIRST = 4, 0.01, 256, 1024
#: Fingerprints are wide, so only up to so many are put in order in one task.
ONE_TASK_ROWS = 16_384


class NoveltyArchive:
    """A bounded list of fingerprints. Each entry holds its distances to the others in order, kept up to date as entries come and go."""

    def __init__(self, size: int, k: int, entries: list | None = None):
        self.size, self.k, self.entries, self.near, self.names = size, k, [], [], []
        self.gone = 0
        for e in entries or []:
            self._push(np.asarray(e, float), None)

    def _push(self, b: np.ndarray, name) -> None:
        d = distances(b, np.array(self.entries)).tolist() if self.entries else []
        for own, x in zip(self.near, d, strict=True):
            insort(own, x)
        self.entries.append(b)
        self.near.append(sorted(d))
        self.names.append(name)

    def _drop(self, i: int) -> None:
        b = self.entries.pop(i)
        self.near.pop(i)
        self.names.pop(i)
        if self.entries:
            for own, x in zip(self.near, distances(b, np.array(self.entries)).tolist(), strict=True):
                own.pop(bisect_left(own, x))
        self.gone += 1

    def own_novelty(self) -> np.ndarray:
        """Of each entry relative to the others."""
        return np.array([float(np.mean(d[: self.k])) if d else 0.0 for d in self.near])

    def threshold(self) -> float:
        return float(self.own_novelty().mean()) if self.entries else float("-inf")

    def offer(self, b: np.ndarray, name=None) -> bool:
        """Whether ``b`` was admitted."""
        b, own = np.asarray(b, float), self.own_novelty()
        if self.entries and float(np.sort(distances(b, np.array(self.entries)))[: self.k].mean()) <= own.mean():
            return False
        if len(self.entries) >= self.size:
            self._drop(int(own.argmin()))
        self._push(b, name)
        return True

    def update(self, behaviors: list[np.ndarray]) -> None:
        for b in behaviors:
            self.offer(b)


def _may_enter(rows: DataFrame, entries: np.ndarray, k: int, slack: int, floor: float) -> DataFrame:
    """The rows (pos, ind_id, a) that could be admitted while the threshold isn't below ``floor`` and up to ``slack`` of ``entries`` have gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            bound = [float(np.sort(distances(values[a:b], entries))[slack : slack + k].mean()) if b - a == entries.shape[1] else np.inf for a, b in zip(at, at[1:], strict=False)]
            yield batch.filter(pa.array(np.array(bound) * (1 + 1e-9) > floor, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def novelty_archive(prints: DataFrame, size: int, k: int, order: str = "ind_id", behavior: str = "behavior", slack: int = SLACK, margin: float = MARGIN, turns: int = TURNS, first: int = FIRST) -> DataFrame:
    """(place, ind_id): the archive's entries, oldest first, after all fingerprints have been offered in ``order``.

    Null and empty fingerprints, and those with a null, NaN or infinite value, are skipped. All must have one length. Rows of equal order go by the hash
    of their fingerprint.
    """
    spark = prints.sparkSession
    own = prints.select(F.col(order).alias("ind_id"), F.col(behavior).cast("array<double>").alias("a"))
    own = own.where((F.size("a") > 0) & F.forall("a", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    own = own.withColumn("tie", F.xxhash64("a"))
    rows = written(positions(own, ["ind_id", "tie"], "pos", ONE_TASK_ROWS).select("pos", "ind_id", "a"), "offered")
    n, lengths = rows.agg(F.count(F.lit(1)), F.count_distinct(F.size("a"))).first()
    if lengths > 1:
        raise ValueError("fingerprints of several lengths")
    archive, at, stretch, whole = NoveltyArchive(size, k), 0, first, True
    while at < n:
        start, end, held = at, min(n, at + (turns if whole else stretch)), len(archive.entries)
        ahead = rows.where((F.col("pos") > at) & (F.col("pos") <= end))
        if not whole:
            # nothing goes while there is room
            may_go = max(0, min(held - k, slack - (size - held)))
            floor, most = archive.threshold() * (1 - margin * (held >= k)), archive.gone + may_go
            ahead = _may_enter(ahead, np.array(archive.entries), k, may_go, floor)
        taken = ahead.orderBy("pos").limit(turns).collect()
        for r in taken:
            # whoever was left out behind one that enters may have been judged by a bound that no longer holds
            if archive.offer(np.array(r.a), r.ind_id) and not whole and (held < k or archive.gone > most or archive.threshold() < floor):
                at = r.pos
                break
        else:
            at = taken[-1].pos if len(taken) == turns else end
        stretch, whole = max(first, 2 * (at - start)), not whole and at - start < turns
    discard(rows)
    kind = prints.schema[order].dataType.simpleString()
    return spark.createDataFrame([(p, i) for p, i in enumerate(archive.names, 1)], f"place long, ind_id {kind}")
