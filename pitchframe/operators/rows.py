"""Row-level access to the tables: counts, pages, samples, profiles, and tracking rows with their player."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import IntegralType, StructType

from pitchframe.plans.ranking import hash_text, position_by_long, position_by_sort
from pitchframe.schemas import ATTACK


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def row_and_batch_count(df: DataFrame, batch_size: int = 32) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_batches", F.ceil(F.col("n_rows") / batch_size))


def _placed(df: DataFrame, key: str) -> DataFrame:
    """`df` with its row numbers in key order as _pos; they do not depend on how a file was split."""
    whole = isinstance(df.schema[key].dataType, IntegralType)
    return position_by_long(df, key, "_pos") if whole else position_by_sort(df, [key], "_pos")


def batch_id(df: DataFrame, key: str = "rid", batch_size: int = 32, name: str = "batch_id") -> DataFrame:
    """Page number of each row in the order of a unique key, a whole number or the place a row was read from."""
    placed = _placed(df, key)
    return placed.withColumn(name, F.floor(F.col("_pos") / batch_size)).drop("_pos")


def page(df: DataFrame, index: int, key: str = "rid", batch_size: int = 32) -> DataFrame:
    """Rows index*batch_size .. of the table in key order; a deep page costs no more than the first."""
    return batch_id(df, key, batch_size, "_page").filter(F.col("_page") == index).drop("_page").orderBy(key)


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """`n` distinct rows in a reproducible random choice; asking for more rows than there are is an error.

    The place a row was read from holds the number of the split, so such a key counts by its row number.
    """
    if df.select(*keys).limit(n).count() < n:
        raise ValueError(f"sample of {n} rows is larger than the table")
    if len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, StructType):
        return sample_rows(_placed(df, keys[0]), n, ["_pos"], seed).drop("_pos")
    return df.withColumn("_h", hash_text(keys, seed)).orderBy("_h", *keys).limit(n).drop("_h")


def sample_attack(attacks: DataFrame, seed: int = 42) -> DataFrame:
    return sample_rows(attacks, 1, ATTACK, seed)


def head(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def table_profile(name: str, df: DataFrame) -> DataFrame:
    """Column, type, place and row count of a table."""
    fields = F.array(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("ordinal"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("column_type"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select(F.lit(name).alias("table_name"), "n_rows", F.explode(fields).alias("f")).select(
        "table_name", "f.ordinal", "f.column_name", "f.column_type", "n_rows"
    )


def play_names(play: DataFrame) -> DataFrame:
    """One name for each (game, side, number) that acted: the first in text order."""
    return (
        play.filter(F.col("player_name").isNotNull())
        .groupBy("game_id", "ha", F.col("shirt_no").alias("no"))
        .agg(F.min("player_name").alias("player_name"))
    )


def enrich_tracking(tracking: DataFrame, play: DataFrame, players: DataFrame) -> DataFrame:
    """Tracking rows with the player's name and every players row of that key and name.

    One output row for each matching players row, and one with NULLs when there is none, so a key with many
    players rows widens the result instead of filling one list.
    """
    keys = ["game_id", "ha", "no"]
    info = players.withColumnRenamed("shirt_no", "no").drop("rid")
    # Both small sides meet first, so the tracking rows are joined once.
    named = play_names(play).join(info, [*keys, "player_name"], "left")
    return tracking.join(named, keys, "left")
