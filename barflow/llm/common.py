"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and the control characters tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def ship(module_name: str) -> None:
    """Send a module's functions to the workers by value, so that they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: Column | str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(col: Column) -> Column:
    """The words of a text, in order; none for an empty text."""
    return F.filter(F.split(col, SPACE), lambda w: w != "")


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two longs that tell rows apart even where ids are null or repeated: rows that agree in both are equal rows."""
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**62))).alias("row_id"),
        F.xxhash64(whole_text(text_col)).alias("row_hash"),
    ]


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only in local mode, where none need be named."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="barflow-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from a table in the shared folder: lineage ends there and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/barflow-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut`` wrote and nobody reads any more."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done; it finds them when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()
