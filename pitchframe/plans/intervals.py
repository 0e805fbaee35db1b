"""Join of points with the intervals that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points per cell, and cells per outer step when an interval is spread over its cells.
CELL = 1024
STEP = 1024


def cell_of(point: str | Column, width: int = CELL) -> Column:
    return F.floor(F.col(point) / F.lit(width)) if isinstance(point, str) else F.floor(point / F.lit(width))


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    point: str,
    lo: str,
    hi: str,
    width: int = CELL,
    keep_cell: bool = False,
) -> DataFrame:
    """Inner join on equal `keys` and `lo <= point <= hi`, both ends inclusive.

    Each interval is spread over the fixed-width cells it touches, so the join is an equality on (keys, cell): one hot
    key is split into its cells, Spark may broadcast the intervals when they are small and shuffles both sides when
    they are not, and skewed cells can be split by the adaptive skew join. keep_cell=True leaves the cell number in
    `_cell`: an aggregate on keys and `_cell` then needs no second shuffle.
    """
    spread = (
        intervals.filter(F.col(lo) <= F.col(hi))
        .withColumn(
            "_step", F.explode(F.sequence(cell_of(lo, width * STEP), cell_of(hi, width * STEP)))
        )
        .withColumn(
            "_cell",
            F.explode(
                F.sequence(
                    F.greatest(cell_of(lo, width), F.col("_step") * STEP),
                    F.least(cell_of(hi, width), F.col("_step") * STEP + (STEP - 1)),
                )
            ),
        )
        .drop("_step")
    )
    held = (
        points.withColumn("_cell", cell_of(point, width))
        .join(spread, [*keys, "_cell"])
        .filter(F.col(point).between(F.col(lo), F.col(hi)))
    )
    return held if keep_cell else held.drop("_cell")
