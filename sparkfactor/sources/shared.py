"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    application = spark.sparkContext.applicationId
    if application not in _own_dirs:
        _own_dirs[application] = tempfile.mkdtemp(prefix="sparkfactor-")
    return _own_dirs[application]


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/sparkfactor/{name}-{uuid.uuid4().hex}"


#: Tables with large cells. By default a file looks at its size only after 100 rows, and a reader takes a row group's as one batch.
LARGE_CELLS = ("panel-blocks", "ranked-blocks")
BY_BYTES = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there, which cuts its lineage and fixes its rows."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.options(**(BY_BYTES if name in LARGE_CELLS else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made. Nothing that is still to be computed may read them."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if "/sparkfactor/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
