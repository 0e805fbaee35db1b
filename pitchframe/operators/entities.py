"""Entities of an attack: who is in it, which slot they take, which player they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.schemas import ATTACK, BALL_HA, BALL_NO, ENTITY, MAX_PLAYERS, SLOTS


def is_ball() -> Column:
    return (F.col("ha") == BALL_HA) & (F.col("no") == BALL_NO)


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the one that was read last. Column by column, so that a hash aggregate can do it."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    last = [F.max_by(c, order).alias(c) for c in rest]
    return df.groupBy(*keys).agg(*last, F.max(order).alias(order)).select(*df.columns)


def entity_frame_counts(slab: DataFrame) -> DataFrame:
    """Rows of each entity of an attack; rows without a side or a number belong to nobody."""
    return (
        slab.filter(F.col("ha").isNotNull() & F.col("no").isNotNull())
        .groupBy(*ATTACK, *ENTITY)
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def drop_substituted(entities: DataFrame, in_attacks: DataFrame) -> DataFrame:
    """Leave out players that a substitution event of the attack's frame range names; the ball always stays."""
    named = in_attacks.select(*ATTACK, "ha", F.col("shirt_no").alias("no")).filter(~is_ball()).distinct()
    return entities.join(named, [*ATTACK, *ENTITY], "left_anti")


def select_entities(entities: DataFrame, max_players: int = MAX_PLAYERS) -> DataFrame:
    """The ball and at most `max_players` players, those with most rows first (then side and number).

    Adds `truncated` (more players than fit) and `count_rank`. Looking one rank past the limit shows whether the
    attack was cut, so no group is kept beyond that rank even before the shuffle.
    """
    by_count = Window.partitionBy(*ATTACK).orderBy(F.desc("n_rows"), "ha", "no")
    players = (
        entities.filter(~is_ball())
        .withColumn("count_rank", F.row_number().over(by_count))
        .filter(F.col("count_rank") <= max_players + 1)
    )
    whole = Window.partitionBy(*ATTACK)
    players = players.withColumn("truncated", F.max("count_rank").over(whole) > max_players)
    players = players.filter(F.col("count_rank") <= max_players)
    ball = entities.filter(is_ball()).withColumn("count_rank", F.lit(0)).withColumn("truncated", F.lit(False))
    return players.unionByName(ball)


def entity_index(selected: DataFrame) -> DataFrame:
    """Slot of each chosen entity: the ball first, then players by side and number, or by rank when cut."""
    rank = F.when(F.col("truncated"), F.col("count_rank")).otherwise(0)
    order = Window.partitionBy(*ATTACK).orderBy(F.desc("is_ball"), rank, "ha", "no")
    return selected.withColumn("is_ball", is_ball()).select(
        *ATTACK,
        (F.row_number().over(order) - 1).cast("bigint").alias("entity_idx"),
        *ENTITY,
        "is_ball",
        "n_rows",
    )


def pad_slots(indexed: DataFrame, slots: int = SLOTS, attacks: DataFrame | None = None) -> DataFrame:
    """All `slots` slots of every attack; the ones nobody takes are NULL. `attacks` may list attacks without entities."""
    listed = indexed.select(*ATTACK).distinct() if attacks is None else attacks
    grid = (
        listed.withColumn("entity_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint"))))
    )
    return grid.join(indexed, [*ATTACK, "entity_idx"], "left")


def player_map(players: DataFrame, order: str = "rid") -> DataFrame:
    """(game, side, number) -> player id, the last row winning; rows with an unreadable key are left out."""
    usable = players.filter(
        F.col("game_id").isNotNull() & F.col("ha").isNotNull() & F.col("shirt_no").isNotNull()
    ).select("game_id", "ha", F.col("shirt_no").alias("no"), "player_id", order)
    return last_wins(usable, ["game_id", *ENTITY], order).drop(order)


def entity_ids(indexed: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add `player_id` and its text form `entity_id`: 'ball', the player, or NULL when nobody is known."""
    return indexed.join(mapping, ["game_id", *ENTITY], "left").withColumn(
        "entity_id", F.when(F.col("is_ball"), F.lit("ball")).otherwise(F.col("player_id").cast("string"))
    )


def player_rows_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("entity_id").isNotNull() & (F.col("entity_id") != "ball"))


def player_code(entity: Column | str = "entity_id") -> Column:
    """Number of a player for model input: 0..999999 as it is, the ball -1, everything else 0."""
    c = F.col(entity) if isinstance(entity, str) else entity
    number = F.when(c.rlike(r"^[0-9]{1,18}\z"), c).try_cast("bigint")
    return (
        F.when(c == "ball", F.lit(-1).cast("bigint"))
        .when(number.between(0, 999999), number)
        .otherwise(F.lit(0).cast("bigint"))
    )
