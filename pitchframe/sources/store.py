"""The stored form of all attacks: tensor, meta, frames and status as tables that are published together."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.functions.text import attack_stem, parse_list_text
from pitchframe.operators.slab import Scenes, attack_meta, dense_slab
from pitchframe.schemas import ATTACK
from pitchframe.sources.feather import register_feather

FORMATS = ("parquet", "feather")
MODES = ("overwrite", "append", "errorifexists", "ignore")
PARTS = ("tensor", "meta", "frames", "status")
# Order inside the stored files.
ORDER = {
    "tensor": [*ATTACK, "entity_idx", "frame_idx"],
    "meta": ATTACK,
    "frames": [*ATTACK, "frame_idx"],
    "status": ATTACK,
}
# A file holds this many attacks of a game, or this many frames of a very long attack.
ATTACKS_PER_FILE = 64
FRAMES_PER_FILE = 1 << 16
# An export is a folder of its own; a commit, one small file for each export, names the folders that count from then on.
COMMIT = "seq bigint, states array<string>"
# The folder of exports written before there were commits: their tables stand under the path itself.
UNCOMMITTED = "."


def _check(fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(COMMIT).json(f"{path}/commits")
    except AnalysisException:
        return None


def committed_states(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Number of the last commit (0: none), and the folders it names."""
    commits = _commits(spark, path)
    last = commits.agg(F.max(F.struct("seq", "states"))).first()[0] if commits is not None else None
    return (last["seq"], last["states"]) if last else (0, [UNCOMMITTED])


def write_attacks(scenes: Scenes, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write all attacks as four tables, by game where the format knows partitions.

    A game goes to one file for each block of attacks, a very long attack to several, however the games differ in size.
    The tables are written to a new folder and published together by one small file, which Spark renames into place last:
    readers see all four tables of an export or none, and an export that dies leaves what was readable as it was. Of two
    exports that end at the same time one stays. Superseded folders stay for their readers; see `drop_old_states`.
    """
    _check(fmt)
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark = scenes.slab.sparkSession
    seq, old = committed_states(spark, path)
    if mode != "overwrite" and not seq and not _readable(spark, path, fmt):
        old = []
    if old and mode == "ignore":
        return
    if old and mode == "errorifexists":
        raise FileExistsError(f"attacks are stored under {path}")
    state = f"state-{uuid.uuid4().hex}"
    tables = {
        "tensor": dense_slab(scenes).drop("frame_count"),
        "meta": attack_meta(scenes),
        "frames": scenes.frames,
        "status": scenes.status,
    }
    for part in PARTS:
        _write_part(tables[part], f"{path}/{state}/{part}", part, fmt)
    _commit(spark, path, seq + 1, [*old, state] if mode == "append" else [state])


def _commit(spark: SparkSession, path: str, seq: int, states: list[str]) -> None:
    spark.createDataFrame([(seq, states)], COMMIT).coalesce(1).write.mode("append").json(f"{path}/commits")


def _write_part(df: DataFrame, path: str, part: str, fmt: str) -> None:
    blocks = [F.floor(F.col("attack_no") / ATTACKS_PER_FILE)]
    if "frame_idx" in df.columns:
        blocks.append(F.floor(F.col("frame_idx") / FRAMES_PER_FILE))
    spread = df.repartition("game_id", *blocks).sortWithinPartitions(*ORDER[part])
    if fmt == "parquet":
        spread.write.partitionBy("game_id").parquet(path)
    else:
        register_feather(df.sparkSession)
        flat = spread.withColumn("entities", F.to_json("entities")) if part == "meta" else spread
        flat.write.format("feather").mode("overwrite").save(path)


def drop_old_states(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders that earlier commits name and the last does not; gives back their names.

    For when nobody reads them any more. Folders of exports that run or have died are in no commit and stay.
    """
    commits = _commits(spark, path)
    if commits is None:
        return []
    _, kept = committed_states(spark, path)
    named = commits.select(F.explode("states").alias("s")).distinct().where(~F.col("s").isin([*kept, UNCOMMITTED]))
    hadoop, gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, []
    for row in named.collect():
        folder = hadoop(f"{path}/{row['s']}")
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True):
            gone.append(row["s"])
    return gone


def _readable(spark: SparkSession, path: str, fmt: str) -> bool:
    try:
        _read_state(spark, f"{path}/{UNCOMMITTED}/meta", fmt, None)
    except FileNotFoundError:
        return False
    return True


def _read_state(spark: SparkSession, path: str, fmt: str, attack_no: int | None) -> DataFrame:
    try:
        if fmt == "parquet":
            return spark.read.parquet(path)
        register_feather(spark)
        equals = {} if attack_no is None else {"attack_no": attack_no}
        return spark.read.format("feather").option("equals", json.dumps(equals)).load(path).drop("stem")
    except Exception as e:
        if isinstance(e, AnalysisException) or "FileNotFoundError" in str(e):
            raise FileNotFoundError(f"no stored table at {path}") from e
        raise


def read_part(
    spark: SparkSession, path: str, part: str, fmt: str = "parquet", attack_no: int | None = None, states: list[str] | None = None
) -> DataFrame:
    """A stored part as last committed, or of the given `states`, so that several parts come from one commit.

    With `attack_no` the Feather source leaves out rows of other attacks while it reads.
    """
    _check(fmt)
    found = []
    for state in committed_states(spark, path)[1] if states is None else states:
        try:
            found.append(_read_state(spark, f"{path}/{state}/{part}", fmt, attack_no))
        except FileNotFoundError:
            # An export without attacks has no files.
            continue
    if not found:
        raise FileNotFoundError(f"no stored {part} under {path}")
    df = found[0]
    for more in found[1:]:
        df = df.unionByName(more)
    if fmt == "feather" and part == "meta":
        df = df.withColumn("entities", F.from_json("entities", "array<string>"))
    return df.withColumn("game_id", F.col("game_id").cast("bigint"))


@dataclass
class Attack:
    """One stored attack. Every part is a DataFrame."""

    tensor: DataFrame  # entity_idx, frame_idx, x, y
    entities: DataFrame  # entity_idx, entity_id
    frames: DataFrame  # frame_idx, frame
    info: DataFrame  # one row: attack_no, game_id, min_frame, max_frame, frame_count


def of_attack(df: DataFrame, game_id: int, attack_no: int) -> DataFrame:
    return df.filter((F.col("game_id") == game_id) & (F.col("attack_no") == attack_no)).drop(*ATTACK)


def attack_info(meta: DataFrame, game_id: int, attack_no: int) -> DataFrame:
    one = meta.filter((F.col("game_id") == game_id) & (F.col("attack_no") == attack_no))
    return one.select("attack_no", "game_id", "min_frame", "max_frame", "frame_count")


def load_attack(spark: SparkSession, path: str, game_id: int, attack_no: int, fmt: str = "parquet") -> Attack:
    """The parts of one attack; the game's partition and the sorted files keep the scan small."""
    _, states = committed_states(spark, path)
    parts = {p: read_part(spark, path, p, fmt, attack_no, states) for p in ("tensor", "meta", "frames")}
    info = attack_info(parts["meta"], game_id, attack_no)
    if info.isEmpty():
        raise FileNotFoundError(f"no stored attack {game_id}/{attack_no} under {path}")
    ids = of_attack(parts["meta"], game_id, attack_no).select(F.posexplode("entities").alias("entity_idx", "entity_id"))
    return Attack(
        of_attack(parts["tensor"], game_id, attack_no).orderBy("entity_idx", "frame_idx"),
        ids,
        of_attack(parts["frames"], game_id, attack_no).select("frame_idx", "frame").orderBy("frame_idx"),
        info,
    )


def list_attacks(meta: DataFrame, tensor: DataFrame, max_files: int | None = None) -> DataFrame:
    """Attacks with both meta and tensor, by stem."""
    both = meta.select(*ATTACK).join(tensor.select(*ATTACK).distinct(), ATTACK, "left_semi")
    listed = both.withColumn("stem", attack_stem("game_id", "attack_no")).orderBy("stem")
    return listed.limit(max_files) if max_files else listed


def shape_stem_meta(meta: DataFrame) -> DataFrame:
    """Meta rows of a file-per-attack tree: lists stored as text become arrays."""
    return meta.withColumns(
        {
            "entities": parse_list_text("entities"),
            "frames": F.transform(parse_list_text("frames"), lambda f: f.try_cast("bigint")),
        }
    )


def shape_stem_tensor(tensor: DataFrame) -> DataFrame:
    """Tensor rows of a file-per-attack tree: the attack is in the file name, NaN means not seen."""
    pattern = r"^attack_(-?\d+)_(\d+)$"
    null = F.lit(None).cast("double")
    return tensor.select(
        F.regexp_extract("stem", pattern, 1).cast("bigint").alias("game_id"),
        F.regexp_extract("stem", pattern, 2).cast("bigint").alias("attack_no"),
        *[F.col(c).cast("bigint").alias(c) for c in ("entity_idx", "frame_idx")],
        *[F.nanvl(F.col(c).cast("double"), null).alias(c) for c in ("x", "y")],
    )


def read_stem_tree(spark: SparkSession, path: str, fmt: str = "feather") -> tuple[DataFrame, DataFrame]:
    """(tensor, meta) of a tree with one tensor file and one meta file for each attack."""
    _check(fmt)
    if fmt == "feather":
        register_feather(spark)
        tensor, meta = (spark.read.format("feather").load(f"{path}/{p}") for p in ("tensor", "meta"))
        return shape_stem_tensor(tensor), shape_stem_meta(meta.drop("stem"))
    tensor = spark.read.parquet(f"{path}/tensor")
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.parquet$", "")
    return shape_stem_tensor(tensor.select("*", stem.alias("stem"))), shape_stem_meta(spark.read.parquet(f"{path}/meta"))
