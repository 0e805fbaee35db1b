"""Row positions in a total order without sending all rows through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.plans.session import staged

LEVEL_BITS = 16


def hash_text(keys: list[str], seed: int) -> Column:
    """Reproducible pseudo-random text of a row key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def _exclusive_sum(value: str, order: str, within: list[str]) -> Column:
    w = Window.partitionBy(*within).orderBy(order) if within else Window.orderBy(order)
    w = w.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0).cast("bigint"))


def position_by_long(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """0-based position of each row in ascending order of a unique whole-number key.

    Rows are ranked inside blocks of 2^16 key values, which hold 2^16 rows at most as the key is unique. Block
    sizes are summed the same way inside super-blocks of 2^32 values; only the table of super-blocks, one row for
    each 2^32 key values in use, is ordered as a whole.
    """
    low, high = f"shiftright(`{key}`, {LEVEL_BITS})", f"shiftright(`{key}`, {2 * LEVEL_BITS})"
    keyed = df.withColumn("_b", F.expr(low)).withColumn("_s", F.expr(high))
    blocks = keyed.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_n"))
    supers = blocks.groupBy("_s").agg(F.sum("_n").alias("_n"))
    supers = supers.select("_s", _exclusive_sum("_n", "_s", []).alias("_s0"))
    starts = blocks.withColumn("_b0", _exclusive_sum("_n", "_b", ["_s"])).join(supers, "_s")
    starts = starts.select("_b", (F.col("_b0") + F.col("_s0")).alias("_start"))
    local = F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1
    return (
        keyed.withColumn("_local", local)
        .join(starts, "_b")
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_b", "_s", "_local", "_start")
    )


def position_by_hash(df: DataFrame, keys: list[str], seed: int, name: str = "position") -> DataFrame:
    """0-based position of each row in a reproducible random order; `keys` must identify a row.

    The first four hex digits of the hash cut the rows into 65,536 even blocks, whatever the keys look like. The table
    of block sizes has that many rows at most, so ordering it as a whole is cheap at any scale.
    """
    keyed = df.withColumn("_h", hash_text(keys, seed)).withColumn("_b", F.substring("_h", 1, 4))
    blocks = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = blocks.select("_b", _exclusive_sum("_n", "_b", []).alias("_start"))
    local = F.row_number().over(Window.partitionBy("_b").orderBy("_h", *keys)) - 1
    return (
        keyed.withColumn("_local", local)
        .join(starts, "_b")
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_b", "_h", "_local", "_start")
    )


def position_by_sort(df: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """0-based position of each row in any total order.

    Spark's range sort spreads the rows evenly; the sorted rows are written once, with the number of the partition
    and the place in it, so both the partition sizes and the rows come from the same table.
    """
    marked = staged(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    marked = marked.withColumn("_p", F.shiftright("_m", 33))
    sizes = marked.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_p", _exclusive_sum("_n", "_p", []).alias("_start"))
    return (
        marked.join(starts, "_p")
        .withColumn(name, F.col("_start") + F.col("_m") - F.shiftleft(F.col("_p"), 33))
        .drop("_m", "_p", "_start")
    )
