"""Tables in the folder that all executors share, where a plan that is read many times is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that spark.checkpoint.dir names; a temporary one only in local mode, where none need be named."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="barflow-")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """The same rows read back from a table: what reads it twice does not compute it twice, and a lost executor loses nothing.

    ``partition_by`` lays it out in folders, so that a filter on these columns reads its own
    only; each has few files, and a large one is split.
    """
    path = shared_folder(df.sparkSession)
    if partition_by:
        df.hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` wrote and nobody reads any more."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
