"""Sliding frame windows over an attack, and one feature vector for each entity in a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.functions.arrays import zero_fill
from pitchframe.schemas import ATTACK

WINDOW = [*ATTACK, "window_id"]


def window_count(frames: Column, win: int, stride: int) -> Column:
    more = F.ceil((frames - win) / stride) + 1
    return F.when(frames <= 0, F.lit(0)).when(frames <= win, F.lit(1)).otherwise(more).cast("bigint")


def sliding_windows(counts: DataFrame, win: int = 150, stride: int = 75) -> DataFrame:
    """(attack, frame_count) -> windows [start_frame, end_frame), the first that reaches the end being the last."""
    n = window_count(F.col("frame_count"), win, stride)
    start = F.col("window_id") * stride
    return (
        counts.filter(F.col("frame_count") > 0)
        .withColumn("window_id", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
        .withColumns({"start_frame": start, "end_frame": F.least(start + win, F.col("frame_count"))})
        .drop("frame_count")
    )


def in_windows(slab: DataFrame, win: int = 150, stride: int = 75) -> DataFrame:
    """Each slab row once for each window that holds it, with its place `window_pos`; no join is needed."""
    last = F.least(F.floor(F.col("frame_idx") / stride), window_count(F.col("frame_count"), win, stride) - 1)
    first = F.greatest(F.ceil((F.col("frame_idx") - (win - 1)) / stride), F.lit(0).cast("bigint"))
    return (
        slab.withColumns({"_first": first, "_last": last})
        .filter(F.col("_first") <= F.col("_last"))
        .withColumn("window_id", F.explode(F.sequence("_first", "_last")))
        .withColumn("window_pos", F.col("frame_idx") - F.col("window_id") * stride)
        .drop("_first", "_last")
    )


def pad_window(slab: DataFrame, win: int = 150, stride: int = 75) -> DataFrame:
    """Arrays xs and ys of exactly `win` numbers for each entity seen in a window; zero where nothing was seen."""
    seen = (
        in_windows(slab, win, stride)
        .groupBy(*WINDOW, "entity_idx")
        .agg(F.map_from_entries(F.collect_list(F.struct("window_pos", F.struct("x", "y")))).alias("_m"))
    )
    steps = F.sequence(F.lit(0).cast("bigint"), F.lit(win - 1).cast("bigint"))

    def series(axis: str) -> Column:
        return F.transform(steps, lambda i: zero_fill(F.try_element_at("_m", i)[axis]))

    return seen.select(*WINDOW, "entity_idx", series("x").alias("xs"), series("y").alias("ys"))


FEATURES = [
    "observed_share",
    "avg_x",
    "avg_y",
    "std_x",
    "std_y",
    "min_x",
    "max_x",
    "min_y",
    "max_y",
    "avg_step",
    "max_step",
    "std_step",
    "path_length",
    "net_displacement",
    "avg_ball_distance",
    "avg_abs_x",
]


def window_features(
    slab: DataFrame,
    entities: DataFrame,
    lengths: DataFrame,
    win: int = 150,
    stride: int = 75,
    min_observed: int = 0,
) -> DataFrame:
    """Sixteen movement statistics (FEATURES) of each entity in each window, over the frames it was seen in.

    `lengths` is (attack, frame_count). min_observed=0 keeps entities a window never saw, as all-zero vectors. Give a thinned or scaled slab to get the
    same treatment as a model patch.
    """
    seen = slab.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    away = F.hypot(F.col("x") - F.col("ball_x"), F.col("y") - F.col("ball_y"))
    rows = in_windows(seen.withColumn("_ball", away).drop("ball_x", "ball_y", "is_ball"), win, stride)
    # One entity in one window has `win` rows at most.
    along = Window.partitionBy(*WINDOW, "entity_idx").orderBy("frame_idx")
    rows = rows.withColumn(
        "_step", F.hypot(F.col("x") - F.lag("x").over(along), F.col("y") - F.lag("y").over(along))
    )
    at = F.struct("x", "y")
    stats = rows.groupBy(*WINDOW, "entity_idx").agg(
        F.count(F.lit(1)).alias("n_observed"),
        F.avg("x").alias("avg_x"),
        F.avg("y").alias("avg_y"),
        F.stddev_pop("x").alias("std_x"),
        F.stddev_pop("y").alias("std_y"),
        F.min("x").alias("min_x"),
        F.max("x").alias("max_x"),
        F.min("y").alias("min_y"),
        F.max("y").alias("max_y"),
        F.avg("_step").alias("avg_step"),
        F.max("_step").alias("max_step"),
        F.stddev_pop("_step").alias("std_step"),
        F.sum("_step").alias("path_length"),
        F.min_by(at, "frame_idx").alias("_from"),
        F.max_by(at, "frame_idx").alias("_to"),
        F.avg("_ball").alias("avg_ball_distance"),
        F.avg(F.abs("x")).alias("avg_abs_x"),
    )
    net = F.hypot(F.col("_to.x") - F.col("_from.x"), F.col("_to.y") - F.col("_from.y"))
    stats = stats.withColumns({"net_displacement": net, "observed_share": F.col("n_observed") / win})
    slots = sliding_windows(lengths, win, stride).join(
        entities.select(*ATTACK, "entity_idx", "is_ball", "entity_id"), ATTACK
    )
    return (
        slots.join(stats, [*WINDOW, "entity_idx"], "left")
        .withColumn("n_observed", F.coalesce("n_observed", F.lit(0).cast("bigint")))
        .filter(F.col("n_observed") >= min_observed)
        .select(
            *WINDOW,
            "entity_idx",
            "is_ball",
            "entity_id",
            "n_observed",
            F.array(*[F.coalesce(F.col(f), F.lit(0.0)) for f in FEATURES]).alias("vec"),
        )
    )
