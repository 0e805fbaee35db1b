"""What several operators share: reading tables, the A-Z lower case, text keys, row numbers of words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rows and bytes that one Arrow batch of whole texts may hold.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry whole texts to the Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one, `_row`, so that names of working columns can't clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z, all else stays. A text of one byte for each character may take the faster lower()."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_key(text: Column) -> Column:
    """16 bytes of the SHA-256 of a text."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def arrow_rows(schema: pa.Schema, work: Callable[[pa.RecordBatch], dict | None]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives the columns `work` returns for each batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def total_bytes(df: DataFrame, column: str) -> tuple[int, int]:
    """Rows of `df` and bytes of one of its text columns."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return n, int(size)
