"""Attack scenes: which there are, their frame ranges, and the tracking rows inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.plans.intervals import interval_join
from pitchframe.schemas import ATTACK, SUBSTITUTION_MARKER


def attack_rows(play: DataFrame) -> DataFrame:
    return play.filter(F.col("attack_no") > 0)


def substitution_events(play: DataFrame, marker: str = SUBSTITUTION_MARKER) -> DataFrame:
    return play.filter(F.col("action_name").contains(marker)).select(
        "game_id", "frame", "player_name", "shirt_no", "ha", "team_id"
    )


def play_of_attack(play: DataFrame, game_id: int, attack_no: int) -> DataFrame:
    return play.filter((F.col("game_id") == game_id) & (F.col("attack_no") == attack_no)).orderBy("frame", "rid")


def frame_slice(tracking: DataFrame, game_id: int, lo: int, hi: int) -> DataFrame:
    """Tracking rows of a game from frame `lo` to `hi`, both included."""
    return tracking.filter((F.col("game_id") == game_id) & F.col("frame").between(lo, hi)).orderBy("frame", "rid")


def attack_count(play: DataFrame) -> DataFrame:
    return attack_rows(play).agg(F.count_distinct(F.struct("attack_no", "game_id")).alias("attack_count"))


def attacks(play: DataFrame) -> DataFrame:
    return attack_rows(play).select(*ATTACK).distinct()


def attack_list(play: DataFrame) -> DataFrame:
    return attacks(play).orderBy(*ATTACK)


def attack_ranges(play: DataFrame) -> DataFrame:
    return (
        attack_rows(play)
        .groupBy(*ATTACK)
        .agg(F.min("frame").alias("min_frame"), F.max("frame").alias("max_frame"))
    )


def attack_slab(tracking: DataFrame, ranges: DataFrame, keep_cell: bool = False) -> DataFrame:
    """Every tracking row of an attack's game inside its frame range; a row may belong to several attacks."""
    held = interval_join(tracking, ranges, ["game_id"], "frame", "min_frame", "max_frame", keep_cell=keep_cell)
    return held.drop("min_frame", "max_frame")


def substitutions_in_attacks(play: DataFrame, ranges: DataFrame, marker: str = SUBSTITUTION_MARKER) -> DataFrame:
    events = substitution_events(play, marker)
    return interval_join(events, ranges, ["game_id"], "frame", "min_frame", "max_frame").drop("min_frame", "max_frame")


def first_substitution(in_attacks: DataFrame) -> DataFrame:
    """First substitution of each player of an attack: by frame, then team and name."""
    return (
        in_attacks.groupBy(*ATTACK, "ha", "shirt_no")
        .agg(F.min(F.struct("frame", "team_id", "player_name")).alias("s"))
        .select(
            *ATTACK,
            "ha",
            "shirt_no",
            F.col("s.frame").alias("substitution_frame"),
            F.col("s.team_id").alias("team_id"),
            F.col("s.player_name").alias("player_name"),
        )
    )
