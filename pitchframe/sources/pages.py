"""A table stored in key order with an index of its files, so that a page costs the reading of a page."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows that a file of the stored table holds at most.
FILE_ROWS = 1 << 20
# The place of a row: the number of the sorted partition and the row's number in it.
PLACE = "_place"
INDEX = "file string, first bigint, n bigint, start bigint"


def write_pages(df: DataFrame, path: str, key: str = "rid", file_rows: int = FILE_ROWS) -> None:
    """Store `df` under a new path in the order of a unique key, NULL first, and index its files.

    One range sort spreads the rows; they are written as they come out of it, with their place in it, so the place of a
    file's first row and its row count tell the row numbers it holds. The index, a row for each file, is written last:
    without it the path can't be read. An empty table has no pages. A column named `_place` is an error.
    """
    if PLACE in df.columns:
        raise ValueError(f"{PLACE} is the stored table's own column")
    spark = df.sparkSession
    placed = df.orderBy(key).withColumn(PLACE, F.monotonically_increasing_id())
    placed.write.option("maxRecordsPerFile", file_rows).parquet(f"{path}/rows")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    files = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(PLACE).alias("first"), F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    files.withColumn("start", F.coalesce(F.sum("n").over(upto), F.lit(0))).coalesce(1).write.parquet(f"{path}/index")


def page_index(spark: SparkSession, path: str) -> DataFrame:
    """file, first (place of its first row), n, start (number of its first row) of each file."""
    try:
        return spark.read.schema(INDEX).parquet(f"{path}/index")
    except AnalysisException as e:
        raise FileNotFoundError(f"no stored pages under {path}") from e


def read_page(spark: SparkSession, path: str, index: int, batch_size: int = 32) -> DataFrame:
    """Rows index*batch_size .. of the stored table in key order; none beyond its end.

    Only files that hold rows of the page are opened, and of those only the parts whose places are asked for.
    """
    if index < 0 or batch_size < 1:
        raise ValueError("a page has a number of 0 or more and one row at least")
    lo, hi = index * batch_size, (index + 1) * batch_size
    # As many rows as the page spans files.
    found = page_index(spark, path).where((F.col("start") < hi) & (F.col("start") + F.col("n") > lo)).collect()
    if not found:
        return spark.read.parquet(f"{path}/rows").drop(PLACE).limit(0)
    ends = [(r.first + max(lo - r.start, 0), r.first + min(hi - r.start, r.n) - 1) for r in found]
    asked = F.lit(False)
    for a, b in ends:
        asked = asked | F.col(PLACE).between(a, b)
    rows = spark.read.parquet(*[f"{path}/rows/{r.file}" for r in found]).where(asked)
    return rows.orderBy(PLACE).drop(PLACE)
