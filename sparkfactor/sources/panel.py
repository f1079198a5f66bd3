"""Panels of assets over time: reading, cleaning, order, target and split."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import positions

#: Fixed value: cells that mean a missing value.
NULL_TOKENS = ("", "NA", "NaN", "null")

#: Beyond so many assets, files hold ranges of assets; the driver would list and hold a folder for each.
ASSET_FOLDERS = 10_000


def drop_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turns null tokens of text columns and NaN into nulls and drops rows that hold any."""
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    clean = {}
    for c in columns:
        if kinds[c] == "string":
            clean[c] = F.when(F.trim(F.col(c)).isin(*NULL_TOKENS), None).otherwise(F.col(c))
        elif kinds[c] in ("double", "float"):
            clean[c] = F.nanvl(F.col(c), F.lit(None).cast(kinds[c]))
    return df.withColumns(clean).na.drop("any", subset=columns)


def read_csv_assets(spark: SparkSession, folder: str, time: str = "open_time", close: str = "close", by_folder: bool = False) -> DataFrame:
    """All CSV files of a folder, one asset each: asset, ts, and double features. Cells are read as text, so every null token counts.

    ``by_folder``: the layouts of ``write_csv_assets``, a folder of files for each asset or files with the asset as a column. Fails without files,
    with fewer than three columns, or where files differ in their columns.
    """
    first = _first_asset(spark, folder) if by_folder else None
    path = f"{folder}/asset=*" if first else f"{folder}/*.csv"
    # with many assets, one folder shows the columns, so that all are listed only once
    raw = spark.read.option("basePath", folder).csv(first or path, header=True, inferSchema=False, enforceSchema=False)
    columns = [c for c in raw.columns if not (by_folder and c == "asset")]
    if len(columns) < 3 or time not in columns or close not in columns or (by_folder and "asset" not in raw.columns):
        raise ValueError(f"{folder}: needs {time}, {close} and another column")
    if by_folder and not first:
        raw = raw.withColumn("asset", F.url_decode("asset"))
    elif by_folder:
        # names of assets as they stand, not as numbers
        kinds = ", ".join(f"`{c}` string" for c in [*columns, "asset"])
        raw = spark.read.option("basePath", folder).csv(path, schema=kinds, header=True, enforceSchema=False)
    else:
        raw = raw.withColumn("asset", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))
    clean = drop_missing(raw, columns)
    order = F.coalesce(F.try_to_timestamp(F.col(time)), F.timestamp_millis(F.col(time).try_cast("long")))
    return clean.select("asset", order.alias("ts"), *(F.col(c).cast("double").alias(c) for c in columns if c != time))


def _first_asset(spark: SparkSession, folder: str) -> str | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatusIterator(path)
    while found.hasNext():
        at = found.next().getPath()
        if at.getName().startswith("asset="):
            # names may hold what a pattern would read as its own
            return re.sub(r"([\\*?\[\]{}])", r"\\\1", at.toString())
    return None


def write_csv_assets(df: DataFrame, folder: str, time: str = "open_time") -> None:
    """A panel with the column ``asset`` as CSV files with headers, a folder for each asset.

    Rows are dealt by ranges of asset and time, so small assets share a task and a large one is cut into several files. With more than
    ``ASSET_FOLDERS`` assets, a file holds its range of them, and their URL-encoded names are its first column, so files grow in number with the bytes.
    """
    dealt = df.repartitionByRange("asset", time).sortWithinPartitions("asset", time)
    if df.select("asset").distinct().limit(ASSET_FOLDERS + 1).count() > ASSET_FOLDERS:
        named = dealt.select(F.url_encode("asset").alias("asset"), *(F.col(c) for c in df.columns if c != "asset"))
        named.write.mode("overwrite").csv(folder, header=True, nullValue="", emptyValue="")
        return
    # tasks move their own files; else the driver would move those of all assets, one by one
    dealt.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("asset").csv(folder, header=True, nullValue="", emptyValue="")


def with_row_id(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds the dense ``row_id`` from 0 in ``order``, which must tell rows apart."""
    return positions(df, order, "_pos").withColumn("row_id", F.col("_pos") - 1).drop("_pos")


def stack_assets(frames: list[DataFrame], order: list[str] = ("asset", "ts")) -> DataFrame:
    """One panel of several, with a row order over all of them."""
    out = frames[0]
    for f in frames[1:]:
        if len(f.columns) != len(out.columns):
            raise ValueError("assets differ in their number of features")
        out = out.unionByName(f)
    return with_row_id(out, list(order))


def forward_target(df: DataFrame, horizon: int, close: str = "close", by: str = "asset", order: str = "row_id", target: str = "reference", name: str = "y") -> DataFrame:
    """Adds the target ``horizon`` rows ahead within an asset and drops rows without one.

    ``reference``: the price ratio over the price again, by IEEE rules, so a price of 0 gives an infinite target or NaN.
    ``simple_return``: the ratio less one, 0 for a price of 0.
    """
    w = W.partitionBy(by).orderBy(order)
    ahead = F.lead(close, horizon).over(w)
    price = F.col(close)
    over_zero = F.when(F.isnan(ahead) | (ahead == 0), F.lit(float("nan"))).otherwise(F.signum(ahead) * F.lit(float("inf")))
    y = F.when(price == 0, over_zero).otherwise(F.try_divide(F.try_divide(ahead, price), price)) if target == "reference" else F.coalesce(F.try_divide(ahead, price) - 1, F.lit(0.0))
    # the row of a price of 0 stays, as the series goes on
    return df.withColumns({"_ahead": ahead, name: y}).where(F.col("_ahead").isNotNull()).drop("_ahead")


def date_cutoff(df: DataFrame, fraction: float, date: str = "ts") -> Column:
    """The date at place max(1, floor(D * fraction)) of the D distinct dates, as a scalar."""
    dates = df.select(date).distinct()
    nth = max(1, int(dates.count() * fraction))
    return positions(dates, [date], "_p").where(F.col("_p") == nth).select(date).scalar()


def date_split(df: DataFrame, fraction: float, date: str = "ts", least_train: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows up to the cutoff date and the rows behind it."""
    marked = df.withColumn("_cut", date_cutoff(df, fraction, date))
    train, test = marked.where(F.col(date) <= F.col("_cut")).drop("_cut"), marked.where(F.col(date) > F.col("_cut")).drop("_cut")
    if least_train and train.count() < least_train:
        raise ValueError(f"fewer than {least_train} training rows")
    return train, test


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for reports, which are small."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_signals(df: DataFrame, path: str, key: str = "row_id") -> None:
    """Signals with their row key as Parquet, at any size."""
    df.select(key, *(F.col(f"`{c}`") for c in sorted(df.columns) if c != key)).write.mode("overwrite").parquet(path)


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a panel: row_id, asset, ts, day and the features x1 to x4."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").cast("string").alias("asset"),
        "ts",
        F.to_date("ts").alias("day"),
        F.col("value").alias("x1"),
        F.get_json_object("props", "$.k").cast("double").alias("x2"),
        F.hour("ts").cast("double").alias("x3"),
        F.col("user_id").cast("double").alias("x4"),
    )
