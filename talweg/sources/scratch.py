"""Tables that one plan writes for itself, in the folder that all executors share, gone with the application."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_marked: set[str] = set()


def folder(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir; on one machine without that setting a temporary one, on a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = f"file://{tempfile.mkdtemp(prefix='talweg-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    own = f"{root.rstrip('/')}/talweg-plans/{spark.sparkContext.applicationId}"
    if own not in _marked:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _marked.add(own)
    return own


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read from there: what is behind it runs once, and isn't run again for a lost executor."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
