"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests on one machine, a folder under /tmp. A cluster has to set it."""
    conf = spark.sparkContext.getConf()
    if path := conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file:///tmp/itemloom-items"


def new_folder(spark: SparkSession) -> str:
    """A folder of its own, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/itemloom/{uuid.uuid4().hex}"
    _own.append((spark, path))
    return path


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, on the driver."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    at, files = hadoop_path(spark, path)
    files.delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _own:
        try:
            delete(spark, path)
        except Exception:  # the session has ended
            return


def written(df: DataFrame) -> DataFrame:
    """df as a table that is written once and read from then on: what made it isn't done again, also if executors are lost."""
    path = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
