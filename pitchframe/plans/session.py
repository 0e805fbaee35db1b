"""Session settings and the shared folder for tables that are written once and read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Where a local session without a checkpoint folder remembers its temporary one.
LOCAL_FOLDER = "spark.pitchframe.folder"


def tune(spark: SparkSession) -> SparkSession:
    """Run-time settings the operators count on: adaptive plans, split of skewed join partitions, UTC times."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Take the extra shuffle when a skewed join feeds an aggregate on the same keys.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(LOCAL_FOLDER, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="pitchframe-")
    spark.conf.set(LOCAL_FOLDER, folder)
    return folder


def staged(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    For a plan with several readers, or one whose row numbers must not change when a lost task runs again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/pitchframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
