"""Session settings the library is written for, and its folder for written tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("obscat")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """Folder for streaming checkpoints and written tables.

    The folder the cluster names in ``spark.checkpoint.dir``. Where that is unset, a local
    session takes a temporary one, and any other fails: executors don't share local folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if base is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if base is None:
        return os.path.join(tempfile.mkdtemp(prefix=f"obscat-{purpose}-"), "t")
    return os.path.join(base, "obscat", purpose, spark.sparkContext.applicationId, uuid.uuid4().hex)


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """Rows that several branches of a plan read, written once below the shared folder."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
