"""Tables written once to the cluster's shared folder, to cut lineage and survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where that is unset, a local session, as in tests, takes a folder of its own and any other
    fails, since executors don't share local folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = os.path.join(tempfile.gettempdir(), "obscat-checkpoints")
    return f"{base.rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def written(df: DataFrame, purpose: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back under the same schema."""
    path = f"{shared_folder(df.sparkSession)}/{purpose}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Remove all tables that this application has written; call it when its results are saved."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
