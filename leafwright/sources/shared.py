"""Tables between the steps of an iteration, in the folder that the driver and the executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder from ``spark.checkpoint.dir``; there is no other that all machines see."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return place.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a table of its own: later steps read it, and a lost executor never repeats what led to it."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame, path: str) -> DataFrame:
    """The table at ``path`` if an earlier run completed it, else ``df`` written there."""
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(path) if exists(spark, f"{path}/_SUCCESS") else written(df, path)
