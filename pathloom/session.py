"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pathloom", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and bench.py; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        # One machine: a local folder is shared.  A folder named by spark.checkpoint.dir comes first.
        .config("spark.pathloom.folder", os.path.join(tempfile.gettempdir(), "pathloom-shared"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> SparkSession:
    """Epoch arithmetic and time fields are defined in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def slots(spark: SparkSession) -> int:
    """Number of tasks worth planning for: the cluster's cores or shuffle width, if larger."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir`` (or ``spark.pathloom.folder``)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.pathloom.folder", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir (or spark.pathloom.folder) to a folder that the driver and all executors share")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def save_shared(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    The table cuts the lineage and fixes values that depend on the physical layout
    (row numbers inside a partition), so a lost executor only means a re-read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)
