"""Files that tasks write and read themselves, on the file system their uri names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.plans.session import shared_folder, staged

# Spark's names of a store and those that pyarrow knows.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_fs(uri: str):
    """pyarrow file system and path of `uri`; a bare path is a local or mounted one."""
    from pyarrow import fs

    scheme, sep, rest = uri.partition("://")
    if not sep:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own in the shared folder, made on the driver."""
    uri = f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)
    return uri


def publish(written: DataFrame, folder: str) -> DataFrame:
    """Give written files their names, then write the manifest; returns the manifest as read back.

    `written` has a row (name, temp, ...) for each file that a task finished. It is written once first, so exactly one
    attempt of each task counts. Renaming runs in tasks and may be repeated: a file that already has its name is left.
    Readers go by the manifest, which Spark commits last; a run that dies before has published nothing.
    """
    rows = staged(written)

    def rename(batches):
        for batch in batches:
            for temp, name in zip(batch.column("temp").to_pylist(), batch.column("name").to_pylist()):
                fs, old = open_fs(temp)
                _, new = open_fs(f"{folder}/{name}")
                if fs.get_file_info(old).is_file:
                    fs.move(old, new)
                elif not fs.get_file_info(new).is_file:
                    raise FileNotFoundError(f"neither {old} nor {new}")
            yield batch

    spark = written.sparkSession
    named = rows.repartition("name").mapInArrow(rename, rows.schema)
    target = f"{folder}/manifest"
    named.withColumn("path", F.concat(F.lit(f"{folder}/"), "name")).drop("temp").write.parquet(target)
    return spark.read.parquet(target)
