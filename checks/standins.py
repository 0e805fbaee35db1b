"""Stand-ins for tracking, play, players, roster, questions, ... made from the given tables as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _slot() -> Column:
    return F.col("user_id") % 24


def _base(spark: SparkSession, sf: str) -> DataFrame:
    slot = _slot()
    return table(spark, sf, "events").select(
        F.col("event_id").alias("rid"),
        F.dayofmonth("ts").cast("bigint").alias("game_id"),
        (F.hour("ts") * 60 + F.minute("ts")).cast("bigint").alias("frame"),
        F.when(slot == 0, 0).when(slot <= 12, 1).otherwise(2).cast("int").alias("ha"),
        F.when(slot == 0, 0).when(slot <= 12, slot).otherwise(slot - 12).cast("int").alias("no"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        "value",
        "event_type",
        F.hour("ts").alias("hour"),
    )


def tracking(spark: SparkSession, sf: str) -> DataFrame:
    return _base(spark, sf).select(
        "rid",
        "game_id",
        "frame",
        "ha",
        "no",
        (F.col("value") % 105 - 52.5).alias("x"),
        (F.col("k") * 0.68 - 34).alias("y"),
    )


def _names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the 23 shirts; the filter on the key bounds this side at any scale."""
    shirts = table(spark, sf, "customer").filter(F.col("c_custkey").between(13, 35))
    return shirts.select(F.col("c_custkey").alias("shirt"), F.col("c_name").alias("player_name"))


def play(spark: SparkSession, sf: str) -> DataFrame:
    attack = F.when(F.col("event_type") == "click", F.floor(F.col("hour") / 3) + 1).otherwise(0)
    change = (F.col("event_type") == "signup") & (F.col("k") < 5)
    rows = _base(spark, sf).select(
        "rid",
        "game_id",
        "frame",
        attack.cast("bigint").alias("attack_no"),
        F.when(change, "選手交代").otherwise(F.col("event_type")).alias("action_name"),
        "ha",
        F.col("no").alias("shirt_no"),
        F.col("ha").cast("bigint").alias("team_id"),
        (F.col("ha") * 12 + F.col("no")).cast("bigint").alias("shirt"),
    )
    return rows.join(_names(spark, sf), "shirt", "left").drop("shirt")


def players(spark: SparkSession, sf: str) -> DataFrame:
    keys = tracking(spark, sf).select("game_id", "ha", "no").distinct()
    usable = keys.filter((F.col("ha") > 0) & ~((F.col("ha") == 2) & (F.col("no") == 11)))
    rows = usable.withColumn("shirt", (F.col("ha") * 12 + F.col("no")).cast("bigint"))
    return rows.join(_names(spark, sf), "shirt", "left").select(
        F.col("shirt").alias("rid"),
        "game_id",
        "ha",
        F.col("no").alias("shirt_no"),
        F.col("shirt").alias("player_id"),
        "player_name",
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    vec = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), vec.alias("vec"))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("label"), F.col("vec_id").alias("rid")
    )


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    return table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))


def roster_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A roster file before shaping, with other header names and untidy text."""
    return _customers(spark, sf).select(
        F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("Player_ID"),
        F.concat("c_name", F.lit(" ")).alias("NAME"),
        F.col("n_name").alias("Team_Name"),
        F.concat("c_mktsegment", F.lit("-"), "c_custkey", F.lit(" | ")).alias("aka"),
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question for each customer; every seventh has one letter of the name dropped."""
    at = (F.col("c_custkey") % F.length("c_name") + 1).cast("int")
    cut = F.concat(
        F.substring(F.col("c_name"), F.lit(1), at - 1), F.substring(F.col("c_name"), at + 1, F.length("c_name"))
    )
    name = F.when(F.col("c_custkey") % 7 == 0, cut).otherwise(F.col("c_name"))
    return _customers(spark, sf).select(
        F.col("c_custkey").alias("question_id"),
        F.concat("n_name", F.lit("の"), name, F.lit("選手について")).alias("question"),
    )


def supervision_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A user turn with the assistant turn that follows it, under the conversation id padded to five digits."""
    turns = table(spark, sf, "conversations")
    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.concat("text", F.lit(" ")).alias("prompt"))
    answers = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target")
    )
    pairs = asked.join(answers, ["conv_id", "turn"], "left")
    return pairs.select(F.lpad(F.col("conv_id").cast("string"), 5, "0").alias("id"), "turn", "prompt", "target")


def manifest_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One patch file for each attack range of a side: its first shirts as a comma list with a blank."""
    shirts = F.array_sort(F.collect_set(F.col("ha") * 12 + F.col("no")))
    return (
        tracking(spark, sf)
        .groupBy("game_id", "ha")
        .agg(F.concat(F.lit(","), F.array_join(F.transform(shirts, lambda s: s.cast("string")), ",")).alias("player_ids"))
        .select(
            F.concat_ws("/", F.lit("patch"), "game_id", "ha").alias("path"),
            "player_ids",
            F.when(F.col("ha") > 0, F.col("ha")).alias("team_id"),
        )
    )
