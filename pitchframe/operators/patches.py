"""Fixed-size model patches: thinning, cutting, scaling and array form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.functions.arrays import fit_width, zero_fill
from pitchframe.operators.entities import pad_slots, player_code
from pitchframe.schemas import ATTACK, SLOTS, SOURCE_FPS


def thin_frames(slab: DataFrame, fps: int = 5, source_fps: int = SOURCE_FPS) -> DataFrame:
    """Keep every (source_fps // fps)-th frame from the first; attacks shorter than one step stay as they are."""
    step = source_fps // fps
    short = F.col("frame_count") < step
    idx = F.when(short, F.col("frame_idx")).otherwise(F.floor(F.col("frame_idx") / step))
    count = F.when(short, F.col("frame_count")).otherwise(F.ceil(F.col("frame_count") / step))
    kept = slab.filter(short | (F.col("frame_idx") % step == 0))
    return kept.withColumns({"frame_idx": idx, "frame_count": count})


def keep_last_frames(slab: DataFrame, window: int = 150) -> DataFrame:
    """The last `window` frames, renumbered from 0. Frame indexes are dense, so this is arithmetic, not ranking."""
    skip = F.greatest(F.col("frame_count") - window, F.lit(0))
    return slab.filter(F.col("frame_idx") >= skip).withColumns(
        {"frame_idx": F.col("frame_idx") - skip, "frame_count": F.least(F.col("frame_count"), F.lit(window))}
    )


def zero_fill_coords(slab: DataFrame) -> DataFrame:
    return slab.withColumns({"x": zero_fill("x"), "y": zero_fill("y")})


def _largest(axis: str) -> Column:
    return F.max(F.when(F.col(axis) != 0, F.abs(F.col(axis))))


def patch_scale(rows: DataFrame) -> DataFrame:
    """1.1 x the largest non-zero |x| and |y| of an attack; NULL for both unless both axes have a non-zero value."""
    return (
        rows.groupBy(*ATTACK)
        .agg(_largest("x").alias("_x"), _largest("y").alias("_y"))
        .select(
            *ATTACK,
            F.when(F.col("_y").isNotNull(), F.col("_x") * 1.1).alias("x_scale"),
            F.when(F.col("_x").isNotNull(), F.col("_y") * 1.1).alias("y_scale"),
        )
    )


def _scaled(name: str, x: Column, y: Column) -> Column:
    """A coordinate over its axis scale; zero stays zero, and nothing changes without both scales."""
    value, scale = F.col(name), x if name.endswith("x") else y
    return F.when(x.isNotNull() & y.isNotNull() & (value != 0), value / scale).otherwise(value)


def _coords(rows: DataFrame) -> list[str]:
    return [c for c in ("x", "y", "ball_x", "ball_y") if c in rows.columns]


def normalise_coords(rows: DataFrame) -> DataFrame:
    """Divide x and y, and the ball's if there, by the attack's scale.

    `rows` is a cut patch, so a group has slots x window rows at most; whole attacks go through normalise_attacks.
    """
    whole = Window.partitionBy(*ATTACK)
    both = rows.withColumns({f"_{a}": _largest(a).over(whole) * 1.1 for a in "xy"})
    return both.withColumns({c: _scaled(c, F.col("_x"), F.col("_y")) for c in _coords(rows)}).drop("_x", "_y")


def normalise_attacks(slab: DataFrame) -> DataFrame:
    """The same for attacks of any length: the scale is aggregated first and joined."""
    both = slab.join(patch_scale(slab), ATTACK)
    names = {c: _scaled(c, F.col("x_scale"), F.col("y_scale")) for c in _coords(slab)}
    return both.withColumns(names).drop("x_scale", "y_scale")


def patch_rows(slab: DataFrame, window: int = 150, fps: int = 5) -> DataFrame:
    """Thin, cut, zero-fill and scale in one go."""
    return normalise_coords(zero_fill_coords(keep_last_frames(thin_frames(slab, fps), window)))


def patches(
    rows: DataFrame, entities: DataFrame, window: int = 150, slots: int = SLOTS, attacks: DataFrame | None = None
) -> DataFrame:
    """One row for each slot of an attack: xs and ys of `window` numbers, zero where nothing was seen."""
    seen = rows.groupBy(*ATTACK, "entity_idx").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("frame_idx"), F.struct("x", "y")))).alias("_m")
    )
    steps = F.sequence(F.lit(0).cast("bigint"), F.lit(window - 1).cast("bigint"))

    def series(axis: str) -> Column:
        filled = F.transform(steps, lambda i: F.coalesce(F.try_element_at("_m", i)[axis], F.lit(0.0)))
        return F.when(F.col("_m").isNull(), F.array_repeat(F.lit(0.0), window)).otherwise(filled)

    return (
        pad_slots(entities, slots, attacks)
        .join(seen, [*ATTACK, "entity_idx"], "left")
        .select(
            *ATTACK,
            "entity_idx",
            series("x").alias("xs"),
            series("y").alias("ys"),
            F.coalesce(player_code(), F.lit(0).cast("bigint")).alias("player_code"),
        )
    )


def pad_crop_patch(patch: DataFrame, window: int = 150) -> DataFrame:
    """Stored patches of any length: the first `window` frames, zero-padded at the end."""
    return patch.withColumns({"xs": fit_width("xs", window), "ys": fit_width("ys", window)})
