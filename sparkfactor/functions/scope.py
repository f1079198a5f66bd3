"""Where an operator looks: the order of rows and what counts as one series.

``panel`` partitions rolling windows by asset and cross-sections by date. ``global`` treats the whole table as one series in the
order of a dense ``row_id`` that starts at 0. So that a global series doesn't end in one task, it is cut into buckets of
``BUCKET_ROWS`` rows, and each bucket gets a copy of the rows before it that its windows reach (``halo``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_ROWS = 1_000_000
BUCKET, HALO = "_bucket", "_halo"


@dataclass(frozen=True)
class Scope:
    kind: str = "global"
    asset: str = "asset"
    date: str = "ts"
    order: str = "row_id"
    bucket_rows: int = BUCKET_ROWS

    def __post_init__(self):
        if self.kind not in ("global", "panel"):
            raise ValueError(f"unknown scope {self.kind}")

    @property
    def series(self) -> str:
        return BUCKET if self.kind == "global" else self.asset

    def window(self):
        return W.partitionBy(self.series).orderBy(self.order)

    def frame(self, d: int):
        return self.window().rowsBetween(-(d - 1), 0)

    def number(self) -> Column:
        """The row's number in its series, from 1."""
        return F.col(self.order) + 1 if self.kind == "global" else F.row_number().over(self.window())

    def prepared(self, df: DataFrame, reach: int) -> DataFrame:
        """Rows in buckets, with copies of up to ``reach`` rows before each bucket; ``HALO`` marks the copies."""
        if self.kind == "panel":
            return df.withColumn(HALO, F.lit(False))
        size = max(self.bucket_rows, reach)
        own = F.expr(f"{self.order} div {size}")
        if reach <= 0:
            return df.withColumns({BUCKET: own, HALO: F.lit(False)})
        late = F.col(self.order) % size >= size - reach
        both = df.withColumn("_b", F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))
        return both.withColumn(BUCKET, F.explode("_b")).withColumn(HALO, F.col(BUCKET) != own).drop("_b")

    def finished(self, df: DataFrame) -> DataFrame:
        """Without the copies and the helper columns."""
        return df.where(~F.col(HALO)).drop(BUCKET, HALO)


GLOBAL, PANEL = Scope("global"), Scope("panel")
