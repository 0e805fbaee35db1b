"""Reading the CSV families and bringing them into canonical form."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.functions.text import casefold, clean, split_aliases, strip
from pitchframe.operators.entities import last_wins
from pitchframe.operators.rows import require_rows
from pitchframe.schemas import (
    PLAY_NAMES,
    PLAY_TYPES,
    PLAYERS_NAMES,
    PLAYERS_TYPES,
    SLOTS,
    TRACKING_NAMES,
    TRACKING_TYPES,
)


def read_csv(spark: SparkSession, path: str, prose: bool = False) -> DataFrame:
    """A CSV family with header, all columns text, plus `rid`: the place a row was read from.

    A doubled quote inside quotes is a quote. `prose` families may break lines inside quotes, so their files are not
    split; the others stay splittable. A file whose header differs from the first one's stops the read.

    rid orders by file, then block, then line; it does not depend on which task read the block.
    """
    try:
        df = spark.read.csv(path, header=True, mode="FAILFAST", multiLine=prose, quote='"', escape='"', enforceSchema=False)
    except AnalysisException as e:
        raise FileNotFoundError(f"cannot read {path}: {e.getCondition()}") from e
    at = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return df.select("*", at.alias("rid"))


def require_sources(spark: SparkSession, paths: dict[str, str], fmt: str = "csv") -> dict[str, DataFrame]:
    """Open every named source; one that cannot be read stops the load and is named."""
    out = {}
    for name, path in paths.items():
        try:
            out[name] = read_csv(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)
        except (AnalysisException, FileNotFoundError) as e:
            raise FileNotFoundError(f"source '{name}' cannot be read: {path}") from e
    return out


def normalise_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Delivered -> canonical names, for those that are there."""
    return df.withColumnsRenamed(names)


def _typed(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind in ("bigint", "int"):
        # "10.0" is a whole number too.
        return c.cast("decimal(38,6)").cast(kind).alias(name)
    return c.cast(kind).alias(name)


def _shape(df: DataFrame, names: dict[str, str], types: dict[str, str]) -> DataFrame:
    df = normalise_columns(df, names)
    lacking = [c for c in types if c not in df.columns]
    if lacking:
        raise ValueError(f"columns missing: {lacking}")
    return df.select(*(["rid"] if "rid" in df.columns else []), *[_typed(c, t) for c, t in types.items()])


def shape_tracking(df: DataFrame) -> DataFrame:
    """Tracking rows; a coordinate that is no number (NaN) was not seen and becomes NULL."""
    shaped = _shape(df, TRACKING_NAMES, TRACKING_TYPES)
    return shaped.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "y")})


def shape_play(df: DataFrame) -> DataFrame:
    return _shape(df, PLAY_NAMES, PLAY_TYPES)


def shape_players(df: DataFrame) -> DataFrame:
    """Players; key texts that are no numbers become NULL, so the player map leaves the row out."""
    df = normalise_columns(df, PLAYERS_NAMES)
    keys = {
        c: F.col(c).cast("string").try_cast("decimal(38,6)").cast("string") for c in ("game_id", "ha", "shirt_no")
    }
    return _shape(df.withColumns(keys), PLAYERS_NAMES, PLAYERS_TYPES)


def read_tracking_star(
    spark: SparkSession, tracking: str, play: str, players: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three CSV families, each path a file, a folder or a glob such as */tracking.csv."""
    raw = require_sources(spark, {"tracking": tracking, "play": play, "players": players})
    return shape_tracking(raw["tracking"]), shape_play(raw["play"]), shape_players(raw["players"])


def shape_embeddings(df: DataFrame, id_col: str = "id", strict: bool = False) -> DataFrame:
    """Wide id, p0, p1, ... -> (id, vec). Blank cells are skipped, which shortens the vector; strict=True rejects them."""
    skip = {id_col, "rid"}
    numbers = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in df.columns if c not in skip]
    vec = F.transform(F.array(*numbers), lambda v: v.cast("double"))
    if strict:
        blank = F.exists(vec, lambda v: v.isNull())
        vec = F.when(blank, F.raise_error(F.concat(F.lit("blank cell in vector "), F.col(id_col)))).otherwise(vec)
    return df.select(F.col(id_col).cast("string").alias("id"), F.array_compact(vec).alias("vec"))


def read_embeddings_csv(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Vectors from CSV; of several rows with one id the last wins."""
    rows = last_wins(read_csv(spark, path), ["id"], "rid").drop("rid")
    return shape_embeddings(rows, strict=strict)


def embeddings_wide(df: DataFrame, width: int, prefix: str = "p") -> DataFrame:
    return df.select("id", *[F.get("vec", F.lit(i)).alias(f"{prefix}{i}") for i in range(width)])


def write_embeddings_csv(df: DataFrame, path: str, prefix: str = "p") -> None:
    width = df.agg(F.max(F.size("vec"))).first()[0]
    if not width:
        raise ValueError("no vectors to write")
    embeddings_wide(df, width, prefix).write.mode("overwrite").csv(path, header=True)


# Header names a roster may use, the first present one being taken.
ROSTER_HEADERS = {
    "id": ("id", "player_id", "pid"),
    "name": ("name", "player_name"),
    "team": ("team", "team_name"),
    "alt_names": ("alt_names", "aliases", "aka"),
}


def shape_roster(df: DataFrame) -> DataFrame:
    """(id, name, team, alts) with case-folded name_lc, team_lc, alts_lc. Headers in any case; id and name needed."""
    present = {c.lower(): c for c in df.columns}
    source = {k: next((present[h] for h in names if h in present), None) for k, names in ROSTER_HEADERS.items()}
    if not source["id"] or not source["name"]:
        raise ValueError("a roster needs at least an id and a name column")

    def text(key: str) -> Column:
        return F.col(f"`{source[key]}`").cast("string") if source[key] else F.lit("")

    shaped = df.select(
        clean(text("id")).alias("id"),
        clean(text("name")).alias("name"),
        clean(text("team")).alias("team"),
        split_aliases(text("alt_names")).alias("alts"),
    )
    return shaped.withColumns(
        {
            "name_lc": casefold("name"),
            "team_lc": casefold("team"),
            "alts_lc": F.transform("alts", casefold),
        }
    )


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    return shape_roster(read_csv(spark, path, prose=True))


def shape_labels(df: DataFrame, label_col: str = "label", order: str = "rid") -> DataFrame:
    """(id, label) as text, the last row of an id winning. A blank label is a label, the empty text."""
    rows = df.select(F.col("id").cast("string").alias("id"), F.coalesce(F.col(label_col).cast("string"), F.lit("")).alias("label"), order)
    return last_wins(rows, ["id"], order).select("id", "label")


def read_labels(spark: SparkSession, path: str, label_col: str = "label") -> DataFrame:
    return shape_labels(read_csv(spark, path, prose=True), label_col)


def shape_supervision(df: DataFrame) -> DataFrame:
    """(id, prompt, target), prompt and target stripped; rows with an empty one of the three are left out."""
    rows = df.select(F.col("id").cast("string").alias("id"), clean("prompt").alias("prompt"), clean("target").alias("target"))
    return rows.filter((F.col("id") != "") & (F.col("prompt") != "") & (F.col("target") != ""))


def read_supervision(spark: SparkSession, path: str) -> DataFrame:
    return require_rows(shape_supervision(read_csv(spark, path, prose=True)), "no usable rows: need id, prompt and target")


def shape_manifest(df: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(path, player_ids, team_id): ids from the comma list without blanks, the first 23, zero-padded to 23."""
    listed = F.split(F.coalesce(F.col("player_ids").cast("string"), F.lit("")), ",")
    ids = F.transform(F.filter(listed, lambda p: p != ""), lambda p: strip(p).cast("bigint"))
    padded = F.slice(F.concat(ids, F.array_repeat(F.lit(0).cast("bigint"), slots)), 1, slots)
    team = F.col("team_id").cast("decimal(38,6)").cast("bigint") if "team_id" in df.columns else F.lit(None).cast("bigint")
    return df.select("path", padded.alias("player_ids"), F.coalesce(team, F.lit(0).cast("bigint")).alias("team_id"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return shape_manifest(read_csv(spark, path))
