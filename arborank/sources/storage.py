"""Tables that are written once and read again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """This application's own folder under spark.checkpoint.dir.

    Only where that setting is missing (local tests) does a temporary folder of this machine stand in.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{tempfile.gettempdir()}/spark-shared"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder for one table."""
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def clear_shared(spark: SparkSession) -> None:
    """Deletes all tables that this application has written there; results that still read them must be done."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, cut from its lineage, safe from lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
