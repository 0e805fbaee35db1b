"""The jobs a user runs: export attacks, batches, training patches, player vectors, style reports, answer rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.functions.arrays import fit_width, l2_normalise
from pitchframe.functions.text import prompt_text
from pitchframe.operators import attacks as A
from pitchframe.operators import evaluation as EV
from pitchframe.operators import lookup as LK
from pitchframe.operators import patches as P
from pitchframe.operators import rows as R
from pitchframe.operators import slab as SL
from pitchframe.operators import splits as SP
from pitchframe.operators import vectors as V
from pitchframe.operators import windows as W
from pitchframe.operators.encoder import conv_features
from pitchframe.plans.session import staged
from pitchframe.schemas import ATTACK, SOURCE_FPS
from pitchframe.sources import store as ST
from pitchframe.sources import tables as T


def export_attacks(
    spark: SparkSession, tracking: str, play: str, players: str, out: str, fmt: str = "parquet", **options
) -> DataFrame:
    """CSV families -> stored attacks; gives back how many attacks went through, and why others did not."""
    scenes = SL.Scenes(*T.read_tracking_star(spark, tracking, play, players), **options)
    ST.write_attacks(scenes, out, fmt)
    return SL.status_summary(ST.read_part(spark, out, "status", fmt))


def stored_slab(tensor: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(slab, entities, lengths) from stored tensor and meta rows of attacks with the expected shape.

    The slab has every slot that was seen; `entities` those whose id is known.
    """
    meta = meta.filter(F.col("tensor_shape_0") == P.SLOTS)
    entities = meta.select(*ATTACK, F.posexplode("entities").alias("entity_idx", "entity_id"))
    entities = entities.filter(F.col("entity_id").isNotNull()).withColumns(
        {"entity_idx": F.col("entity_idx").cast("bigint"), "is_ball": F.col("entity_id") == "ball"}
    )
    lengths = meta.select(*ATTACK, F.col("tensor_shape_1").alias("frame_count"))
    seen = tensor.filter(F.col("x").isNotNull() | F.col("y").isNotNull())
    seen = seen.select(*ATTACK, "entity_idx", "frame_idx", "x", "y")
    slots = entities.select(*ATTACK, "entity_idx", "is_ball")
    ball = seen.join(slots.filter("is_ball").drop("is_ball"), [*ATTACK, "entity_idx"])
    ball = ball.select(*ATTACK, "frame_idx", F.col("x").alias("ball_x"), F.col("y").alias("ball_y"))
    slab = seen.join(lengths, ATTACK).join(slots, [*ATTACK, "entity_idx"], "left").join(ball, [*ATTACK, "frame_idx"], "left")
    return slab.withColumn("is_ball", F.coalesce("is_ball", F.lit(False))), entities, lengths

ENCODERS = {"kernels": conv_features, "statistics": W.window_features}


def build_player_vectors(
    tensor: DataFrame,
    meta: DataFrame,
    out: str,
    win: int = 150,
    stride: int = 75,
    fps: int = 5,
    normalise: bool = True,
    width: int = 256,
    min_observed: int = 0,
    encoder: str = "kernels",
) -> V.Projection:
    """Stored attacks -> one vector for each player, kept as CSV and with its projection under `out`.

    `encoder` is "kernels" (512 numbers a window before the projection) or "statistics" (16).
    The slab is thinned to `fps` and scaled as model patches are; fps=25 and normalise=False take it as stored.
    """
    slab, entities, lengths = stored_slab(tensor, meta)
    if fps != SOURCE_FPS:
        slab = P.thin_frames(slab, fps)
        lengths = P.thin_frames(lengths.withColumn("frame_idx", F.lit(0).cast("bigint")), fps).drop("frame_idx")
    if normalise:
        slab = P.normalise_attacks(slab)
    features = ENCODERS[encoder](slab, entities, lengths, win, stride, min_observed)
    means = staged(V.player_mean_vectors(features).select("id", "vec"))
    R.require_rows(means, "no player vectors: check the data and the entities in meta")
    projection = V.pca_project(means, width)
    V.save_projection(projection, f"{out}/projection")
    T.write_embeddings_csv(V.player_order(projection.vectors), f"{out}/player_vectors")
    return projection


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """Vectors at the fixed width and unit length."""
    fitted = vectors.select("id", fit_width("vec").alias("vec"))
    return fitted.select("id", l2_normalise("vec").alias("vec"))


def style_report(
    spark: SparkSession,
    spaces: dict[str, str],
    labels: str,
    out: str,
    label_col: str = "label",
    metric: str = "cosine",
    k: int = 10,
) -> DataFrame:
    """Vector CSVs by name, and a label CSV -> purity, silhouette and NMI of each, also as one JSON object under `out`."""
    vectors = {name: staged(unit_vectors(T.read_embeddings_csv(spark, path))) for name, path in spaces.items()}
    report = staged(EV.compare_spaces(vectors, T.read_labels(spark, labels, label_col), metric, k))
    EV.write_metrics_json(report, out)
    return report


def answer_rows(questions: DataFrame, roster: DataFrame, vectors: DataFrame, template: bool = False) -> DataFrame:
    """Questions with the player they ask for, the player's unit vector and the prompt.

    Questions nobody could be found for, or whose player has no vector, keep NULLs.
    """
    found = LK.resolve_player(questions, roster)
    known = LK.lookup_vector(found.select("player_id").filter("player_id IS NOT NULL").distinct(), unit_vectors(vectors), "player_id")
    prompt = prompt_text("question") if template else F.col("question")
    return found.join(known, "player_id", "left").withColumn("prompt", prompt)


def tracking_batch(
    tracking: DataFrame, play: DataFrame, players: DataFrame, index: int | None = None, size: int = 32, seed: int = 42
) -> DataFrame:
    """One page of the tracking rows, or `size` random ones, with the players they belong to."""
    rows = R.sample_rows(tracking, size, ["rid"], seed) if index is None else R.page(tracking, index, "rid", size)
    return R.enrich_tracking(rows, play, players)


def attack_batch(
    tracking: DataFrame, play: DataFrame, game_id: int | None = None, attack_no: int | None = None, seed: int = 42
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frame range, tracking rows, play rows) of one attack; a random one unless both keys are given."""
    if game_id is None or attack_no is None:
        game_id, attack_no = R.sample_attack(A.attacks(play), seed).first()
    span = A.attack_ranges(play.filter((F.col("game_id") == game_id) & (F.col("attack_no") == attack_no)))
    bounds = span.first()
    if bounds is None:
        raise ValueError(f"no attack {game_id}/{attack_no}")
    rows = A.frame_slice(tracking, game_id, bounds["min_frame"], bounds["max_frame"])
    return span, rows, A.play_of_attack(play, game_id, attack_no)


def training_patches(
    tensor: DataFrame,
    meta: DataFrame,
    window: int = 150,
    fps: int = 5,
    ratios: tuple[float, float, float] = (0.7, 0.2, 0.1),
    seed: int = 42,
    max_attacks: int | None = None,
) -> DataFrame:
    """Stored attacks -> one row for each slot: xs, ys, player_code, team_id (0, as it is not stored) and the split."""
    listed = ST.list_attacks(meta, tensor, max_attacks).select(*ATTACK)
    split = SP.train_val_test_split(listed, ATTACK, *ratios, seed=seed)
    slab, entities, _ = stored_slab(tensor, meta)
    rows = P.patch_rows(slab, window, fps)
    out = P.patches(rows, entities, window, attacks=listed).withColumn("team_id", F.lit(0).cast("bigint"))
    return out.join(split, ATTACK)
