"""Reproducible train / validation / test split with exact sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.plans.ranking import position_by_hash


def train_val_test_split(
    df: DataFrame, keys: list[str], train: float = 0.7, val: float = 0.2, test: float = 0.1, seed: int = 42
) -> DataFrame:
    """Add `split`: floor(N*train) rows train, floor(N*val) rows val, the rest test. `keys` must identify a row."""
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError(f"ratios must sum to 1, not {train + val + test}")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = position_by_hash(df, keys, seed, "_pos").withColumn("_n", total)
    first = F.floor(F.col("_n") * train)
    second = first + F.floor(F.col("_n") * val)
    split = F.when(F.col("_pos") < first, "train").when(F.col("_pos") < second, "val").otherwise("test")
    return placed.withColumn("split", split).drop("_pos", "_n")


def split_sizes(split: DataFrame) -> DataFrame:
    """Rows of each split and their share."""
    total = split.agg(F.count(F.lit(1))).scalar()
    sizes = split.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    return sizes.withColumn("share", F.col("n_rows") / total)
