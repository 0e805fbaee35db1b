"""The (entity x frame) layout of all attacks as one long table."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.operators import attacks as A
from pitchframe.operators import entities as E
from pitchframe.plans.intervals import cell_of
from pitchframe.plans.session import staged
from pitchframe.schemas import ATTACK, ENTITY, MAX_PLAYERS, SLOTS, SUBSTITUTION_MARKER


def cells(slab: DataFrame, order: str = "rid") -> DataFrame:
    """One row for each (attack, frame, entity): the position read last, and how many rows there were."""
    # `_cell` follows from the frame; as a key it lets the aggregate use the partitioning of the interval join.
    keys = ["game_id", *(["_cell"] if "_cell" in slab.columns else []), "attack_no", "frame", *ENTITY]
    last = [F.max_by(axis, order).alias(axis) for axis in ("x", "y")]
    found = slab.groupBy(*keys).agg(*last, F.count(F.lit(1)).alias("n_rows"))
    return found.select(*ATTACK, "frame", *ENTITY, "x", "y", "n_rows")


def frame_index(rows: DataFrame) -> DataFrame:
    """(attack, frame) -> 0-based place among the frames observed in the attack, and their number `frame_count`.

    Frames are ranked inside cells of 1,024 frame numbers; only the cell sizes are summed along the attack, so a very
    long attack does not end up in one task. Columns of a frame other than these are kept.
    """
    frames = rows.withColumn("_c", cell_of("frame"))
    local = Window.partitionBy(*ATTACK, "_c").orderBy("frame")
    ranked = frames.withColumn("_i", F.row_number().over(local) - 1)
    sizes = frames.groupBy(*ATTACK, "_c").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*ATTACK)
    before = whole.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *ATTACK,
        "_c",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(whole).alias("frame_count"),
    )
    placed = ranked.join(starts, [*ATTACK, "_c"]).withColumn("frame_idx", F.col("_start") + F.col("_i"))
    rest = [c for c in rows.columns if c not in (*ATTACK, "frame")]
    return placed.select(*ATTACK, "frame", "frame_idx", "frame_count", *rest)


def observed_frames(found: DataFrame) -> DataFrame:
    """Distinct frames of each attack with the place of the ball, NULL if it was not seen."""
    ball = [F.max(F.when(E.is_ball(), F.col(a))).alias(f"ball_{a}") for a in "xy"]
    return found.groupBy(*ATTACK, "frame").agg(*ball)


class Scenes:
    """All attacks of a data set: who was where, frame by frame. Every part is a DataFrame, made when first asked for.

    incomplete="pad" keeps attacks with fewer than 23 entities, "reject" leaves them out as the status shows.
    Cells, chosen entities and frames each feed several readers, so they are written once to the shared folder;
    stage=False recomputes them instead.
    """

    def __init__(
        self,
        tracking: DataFrame,
        play: DataFrame,
        players: DataFrame,
        *,
        max_players: int = MAX_PLAYERS,
        incomplete: str = "pad",
        marker: str = SUBSTITUTION_MARKER,
        order: str = "rid",
        stage: bool = True,
    ):
        if incomplete not in ("pad", "reject"):
            raise ValueError("incomplete must be 'pad' or 'reject'")
        self._tracking = tracking.select("game_id", "frame", *ENTITY, "x", "y", order)
        self._play, self._players = play, players
        self._max_players, self._incomplete, self._marker, self._order = max_players, incomplete, marker, order
        self._keep = staged if stage else lambda df: df

    @cached_property
    def ranges(self) -> DataFrame:
        """attack -> min_frame, max_frame"""
        return A.attack_ranges(self._play)

    @cached_property
    def cells(self) -> DataFrame:
        """attack, frame, ha, no -> x, y, n_rows"""
        return self._keep(cells(A.attack_slab(self._tracking, self.ranges, keep_cell=True), self._order))

    @property
    def _known(self) -> DataFrame:
        return self.cells.filter(F.col("ha").isNotNull() & F.col("no").isNotNull())

    @cached_property
    def chosen(self) -> DataFrame:
        """attack, entity_idx -> ha, no, is_ball, n_rows, of every attack"""
        counts = self._known.groupBy(*ATTACK, *ENTITY).agg(F.sum("n_rows").alias("n_rows"))
        left = E.drop_substituted(counts, A.substitutions_in_attacks(self._play, self.ranges, self._marker))
        return self._keep(E.entity_index(E.select_entities(left, self._max_players)))

    @property
    def _usable(self) -> DataFrame:
        if self._incomplete == "pad":
            return self.chosen
        full = self.chosen.groupBy(*ATTACK).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == SLOTS)
        return self.chosen.join(full, ATTACK, "left_semi")

    @cached_property
    def entities(self) -> DataFrame:
        """attack, entity_idx -> ha, no, is_ball, n_rows, player_id, entity_id"""
        return E.entity_ids(self._usable, E.player_map(self._players, self._order))

    @cached_property
    def frames(self) -> DataFrame:
        """attack, frame -> frame_idx, frame_count, ball_x, ball_y"""
        return self._keep(frame_index(observed_frames(self.cells)))

    @cached_property
    def lengths(self) -> DataFrame:
        """attack -> frame_count"""
        return self.frames.groupBy(*ATTACK).agg(F.max("frame_count").alias("frame_count"))

    @cached_property
    def placed(self) -> DataFrame:
        """The slab with `frame`, the frame number.

        Each frame carries the slots of its attack, 23 at most, so the cells are shuffled once, to their frame.
        """
        entry = F.struct(F.struct("ha", "no"), F.col("entity_idx"))
        slots = self._usable.groupBy(*ATTACK).agg(F.map_from_entries(F.collect_list(entry)).alias("_slots"))
        framed = self.frames.join(slots, ATTACK)
        return (
            self._known.join(framed, [*ATTACK, "frame"])
            .withColumn("entity_idx", F.try_element_at("_slots", F.struct("ha", "no")))
            .filter(F.col("entity_idx").isNotNull())
            .withColumn("is_ball", E.is_ball())
            .drop("_slots", *ENTITY, "n_rows")
        )

    @cached_property
    def slab(self) -> DataFrame:
        """attack, entity_idx, is_ball, frame_idx, frame_count, x, y, ball_x, ball_y; observed cells only"""
        return self.placed.select(
            *ATTACK, "entity_idx", "is_ball", "frame_idx", "frame_count", "x", "y", "ball_x", "ball_y"
        )

    @cached_property
    def status(self) -> DataFrame:
        """attack -> status, reason"""
        return self._keep(attack_status(self.ranges, self.cells, self.chosen, self._incomplete))


def attack_status(ranges: DataFrame, found: DataFrame, chosen: DataFrame, incomplete: str = "pad") -> DataFrame:
    """What became of each attack, and why."""
    seen = found.groupBy(*ATTACK).agg(
        F.max(F.col("ha").isNotNull() & F.col("no").isNotNull()).alias("_known"), F.lit(True).alias("_seen")
    )
    sizes = chosen.groupBy(*ATTACK).agg(F.count(F.lit(1)).alias("_n"))
    reason = (
        F.when(F.col("min_frame").isNull(), "no_frames")
        .when(F.col("_seen").isNull(), "no_tracking")
        .when(~F.col("_known"), "no_entities")
        .when(F.lit(incomplete == "reject") & (F.coalesce(F.col("_n"), F.lit(0)) < SLOTS), "incomplete_entities")
        .otherwise("")
    )
    return (
        ranges.join(seen, ATTACK, "left")
        .join(sizes, ATTACK, "left")
        .select(*ATTACK, reason.alias("reason"))
        .select(*ATTACK, F.when(F.col("reason") == "", "ok").otherwise("error").alias("status"), "reason")
    )


def status_summary(status: DataFrame) -> DataFrame:
    return status.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n_attacks"))


def dense_slab(scenes: Scenes, slots: int = SLOTS) -> DataFrame:
    """All slots x frames of every usable attack, positions nobody was seen at being NULL.

    The slots of a frame are gathered where the slab already is, by frame, and spread out after the join.
    """
    usable = scenes.status.filter(F.col("status") == "ok").select(*ATTACK)
    frames = scenes.frames.join(usable, ATTACK, "left_semi").select(*ATTACK, "frame", "frame_idx", "frame_count")
    entry = F.struct(F.col("entity_idx"), F.struct("x", "y"))
    seen = scenes.placed.groupBy(*ATTACK, "frame").agg(F.map_from_entries(F.collect_list(entry)).alias("_at"))
    slot = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint")))
    at = F.try_element_at("_at", F.col("entity_idx"))
    return (
        frames.join(seen, [*ATTACK, "frame"], "left")
        .withColumn("entity_idx", slot)
        .select(*ATTACK, "entity_idx", "frame_idx", "frame_count", at["x"].alias("x"), at["y"].alias("y"))
    )


def attack_meta(scenes: Scenes, slots: int = SLOTS) -> DataFrame:
    """One row for each usable attack; `entities` holds the id of each slot.

    The frame numbers stay in the long table `frames`: as a list they would grow with the attack.
    """
    usable = scenes.status.filter(F.col("status") == "ok").select(*ATTACK)
    taken = scenes.entities.groupBy(*ATTACK).agg(
        F.map_from_entries(F.collect_list(F.struct("entity_idx", "entity_id"))).alias("_ids")
    )
    ids = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint")), lambda i: F.try_element_at("_ids", i)
    )
    empty = F.array_repeat(F.lit(None).cast("string"), slots)
    return (
        scenes.ranges.join(usable, ATTACK, "left_semi")
        .join(scenes.lengths, ATTACK)
        .join(taken, ATTACK, "left")
        .select(
            *ATTACK,
            "min_frame",
            "max_frame",
            "frame_count",
            F.lit(slots).cast("bigint").alias("tensor_shape_0"),
            F.col("frame_count").alias("tensor_shape_1"),
            F.lit(2).cast("bigint").alias("tensor_shape_2"),
            F.lit(slots).cast("bigint").alias("entities_count"),
            F.when(F.col("_ids").isNull(), empty).otherwise(ids).alias("entities"),
        )
    )


def valid_shape_only(slab: DataFrame, meta: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Rows of attacks whose entity dimension is the expected one."""
    return slab.join(meta.filter(F.col("tensor_shape_0") == slots), ATTACK, "left_semi")
