"""One query for each operator, on stand-ins made from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import standins as S
from pitchframe.functions import arrays as AR
from pitchframe.functions import text as TX
from pitchframe.operators import attacks as A
from pitchframe.operators import encoder as EN
from pitchframe.operators import entities as E
from pitchframe.operators import evaluation as EV
from pitchframe.operators import layout as LA
from pitchframe.operators import lookup as LK
from pitchframe.operators import neighbours as NB
from pitchframe.operators import patches as P
from pitchframe.operators import rows as R
from pitchframe.operators import slab as SL
from pitchframe.operators import splits as SP
from pitchframe.operators import trajectories as TR
from pitchframe.operators import vector_index as VI
from pitchframe.operators import vectors as V
from pitchframe.operators import windows as W
from pitchframe.plans.session import shared_folder, staged, tune
from pitchframe.schemas import ATTACK, PLAY_NAMES, PLAYERS_NAMES, TRACKING_NAMES
from pitchframe.sources import pages as PG
from pitchframe.sources import store as ST
from pitchframe.sources import tables as T
from pitchframe.sources.feather import register_feather

QUERIES = {}

# Sizes that fit the stand-ins: the player cut, the frame cut and the last window all bite.
MAX_PLAYERS = 12
FPS, PATCH = 12, 10
WIN, STRIDE = 16, 8
GAME, ATTACK_NO = 3, 4


def query(fn):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(tune(spark), sf)

    QUERIES[fn.__name__] = run
    return fn


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def long_vec(df: DataFrame, *keys: str, vec: str = "vec") -> DataFrame:
    """Vectors as (keys, pos, value) rows."""
    out = df.select(*keys, F.posexplode(vec).alias("pos", "value"))
    return out.select(*keys, F.col("pos").cast("bigint").alias("pos"), r6("value").alias("value"))


def both_axes(df: DataFrame, *keys: str) -> DataFrame:
    """Paths xs and ys as (keys, pos, x, y) rows."""
    out = df.select(*keys, F.posexplode(F.arrays_zip("xs", "ys")).alias("pos", "at"))
    return out.select(*keys, F.col("pos").cast("bigint").alias("pos"), r6("at.xs").alias("x"), r6("at.ys").alias("y"))


def scenes(spark: SparkSession, sf: str, **options) -> SL.Scenes:
    options = {"max_players": MAX_PLAYERS, **options}
    return SL.Scenes(S.tracking(spark, sf), S.play(spark, sf), S.players(spark, sf), **options)


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/checks-{uuid.uuid4().hex}"


# ---- sources and sinks


def _delivered(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Canonical columns back to delivered names, all text."""
    back = {v: k for k, v in names.items()}
    return df.select("rid", *[F.col(c).cast("string").alias(back[c]) for c in df.columns if c in back])


@query
def read_tracking_star(spark, sf):
    tracking = T.shape_tracking(_delivered(S.tracking(spark, sf), TRACKING_NAMES))
    play = T.shape_play(_delivered(S.play(spark, sf), PLAY_NAMES))
    players = T.shape_players(_delivered(S.players(spark, sf), PLAYERS_NAMES))
    parts = [
        tracking.select(F.lit("tracking").alias("t"), "rid", "game_id", "frame", *big("ha"), *big("no"), r6("x").alias("x")),
        play.select(F.lit("play").alias("t"), "rid", "game_id", "frame", *big("ha"), F.col("shirt_no").cast("bigint").alias("no"), F.lit(None).cast("double").alias("x")),
        players.select(F.lit("players").alias("t"), "rid", "game_id", F.col("player_id").alias("frame"), *big("ha"), F.col("shirt_no").cast("bigint").alias("no"), F.lit(None).cast("double").alias("x")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def require_sources(spark, sf):
    opened = T.require_sources(spark, {n: f"{sf}/{n}.parquet" for n in ("events", "customer", "embeddings")}, "parquet")
    out = None
    for name, df in opened.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("source"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query
def table_profile(spark, sf):
    return R.table_profile("tracking", S.tracking(spark, sf)).unionByName(R.table_profile("play", S.play(spark, sf)))


@query
def normalise_columns(spark, sf):
    renamed = _delivered(S.players(spark, sf), PLAYERS_NAMES).drop("選手名")
    return T.normalise_columns(renamed, PLAYERS_NAMES).select("rid", "game_id", "ha", "shirt_no", "player_id")


@query
def write_attacks(spark, sf):
    path = fresh_path(spark)
    ST.write_attacks(scenes(spark, sf), path)
    tensor = ST.read_part(spark, path, "tensor")
    return tensor.select(*ATTACK, "entity_idx", "frame_idx", r6("x").alias("x"), r6("y").alias("y"))


@query
def build_all_attacks(spark, sf):
    return scenes(spark, sf, incomplete="reject", max_players=22).status


@query
def attack_status_summary(spark, sf):
    return SL.status_summary(scenes(spark, sf, incomplete="reject", max_players=22).status)


@query
def load_attack(spark, sf):
    path = fresh_path(spark)
    ST.write_attacks(scenes(spark, sf), path)
    key = R.sample_attack(ST.read_part(spark, path, "meta")).first()
    one = ST.load_attack(spark, path, key["game_id"], key["attack_no"])
    ids = one.entities.select(F.col("entity_idx").cast("bigint").alias("entity_idx"), "entity_id")
    rows = one.tensor.join(ids, "entity_idx").join(one.frames, "frame_idx")
    return rows.select("entity_idx", "entity_id", "frame_idx", "frame", r6("x").alias("x"), r6("y").alias("y"))


@query
def list_attacks(spark, sf):
    found = scenes(spark, sf)
    return ST.list_attacks(SL.attack_meta(found), SL.dense_slab(found), 100).select(*ATTACK, "stem")


@query
def feather_source(spark, sf):
    path = fresh_path(spark)
    ST.write_attacks(scenes(spark, sf), path, "feather")
    meta = ST.read_part(spark, path, "meta", "feather")
    rows = meta.select(*ATTACK, F.posexplode("entities").alias("entity_idx", "entity_id"))
    tensor = ST.read_part(spark, path, "tensor", "feather")
    sums = tensor.groupBy(*ATTACK, "entity_idx").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("x").alias("n_seen"), r6(F.sum("x")).alias("sum_x")
    )
    return rows.withColumn("entity_idx", F.col("entity_idx").cast("bigint")).join(sums, [*ATTACK, "entity_idx"])


@query
def feather_sink(spark, sf):
    path = fresh_path(spark)
    register_feather(spark)
    S.tracking(spark, sf).write.format("feather").mode("append").save(path)
    rows = spark.read.format("feather").load(path)
    return rows.select("rid", "game_id", "frame", *big("ha"), *big("no"), r6("x").alias("x"), r6("y").alias("y"))


def _wide(spark, sf):
    """Vectors as text columns, those near zero left blank."""
    vectors = S.vectors(spark, sf)
    width = vectors.agg(F.max(F.size("vec"))).first()[0] or 0
    cells = [
        F.when(F.abs(F.get("vec", F.lit(i))) >= 0.005, F.get("vec", F.lit(i)).cast("string")).otherwise("").alias(f"p{i}")
        for i in range(width)
    ]
    return vectors.select("id", *cells)


@query
def read_embeddings_csv(spark, sf):
    return long_vec(T.shape_embeddings(_wide(spark, sf)), "id")


@query
def write_embeddings_csv(spark, sf):
    path = fresh_path(spark)
    T.write_embeddings_csv(S.vectors(spark, sf), path)
    return long_vec(T.read_embeddings_csv(spark, path), "id")


@query
def read_roster(spark, sf):
    rows = T.shape_roster(S.roster_rows(spark, sf))
    return rows.select("id", "name", "team", F.array_join("alts_lc", ";").alias("alts"), "name_lc", "team_lc")


@query
def read_labels(spark, sf):
    rows = S.table(spark, sf, "labels").select(
        (F.col("doc_id") % 100).cast("string").alias("id"), F.col("quality").alias("mark"), F.col("doc_id").alias("rid")
    )
    return T.shape_labels(rows, "mark")


@query
def read_supervision(spark, sf):
    return T.shape_supervision(S.supervision_rows(spark, sf))


@query
def read_manifest(spark, sf):
    rows = T.shape_manifest(S.manifest_rows(spark, sf))
    ids = F.transform("player_ids", lambda p: p.cast("string"))
    return rows.select("path", F.array_join(ids, " ").alias("player_ids"), "team_id")


@query
def write_metrics_json(spark, sf):
    path = fresh_path(spark)
    EV.write_metrics_json(_purity_report(spark, sf), path)
    back = spark.read.schema("style map<string, double>, baseline_p map<string, double>").json(path)
    spaces = [
        back.select(F.lit(s).alias("space"), F.explode(s).alias("metric", "value")) for s in ("style", "baseline_p")
    ]
    return rounded(spaces[0].unionByName(spaces[1]), "value")


@query
def save_projection(spark, sf):
    path = fresh_path(spark)
    V.save_projection(V.pca_project(S.vectors(spark, sf), 8), path)
    ids = spark.read.parquet(f"{path}/ids")
    return ids.join(spark.read.parquet(f"{path}/vectors"), "id").select("id", F.size("vec").cast("bigint").alias("width"))


# ---- projections, filters, predicates


@query
def attack_rows(spark, sf):
    return A.attack_rows(S.play(spark, sf)).select("rid", "game_id", "attack_no", "frame")


@query
def substitution_events(spark, sf):
    rows = A.substitution_events(S.play(spark, sf))
    return rows.select("game_id", "frame", "player_name", *big("shirt_no"), *big("ha"), "team_id")


@query
def play_of_attack(spark, sf):
    return A.play_of_attack(S.play(spark, sf), GAME, ATTACK_NO).select("rid", "game_id", "attack_no", "frame")


@query
def frame_slice(spark, sf):
    rows = A.frame_slice(S.tracking(spark, sf), GAME, 300, 700)
    return rows.select("rid", "frame", *big("ha"), *big("no"), r6("x").alias("x"))


@query
def player_rows_only(spark, sf):
    rows = E.player_rows_only(scenes(spark, sf).entities)
    return rows.select(*ATTACK, "entity_idx", "entity_id")


@query
def valid_shape_only(spark, sf):
    found = scenes(spark, sf)
    rows = SL.valid_shape_only(found.slab, SL.attack_meta(found))
    return rows.groupBy(*ATTACK).agg(F.count(F.lit(1)).alias("n_rows"))


@query
def project_columns(spark, sf):
    return S.play(spark, sf).select("frame", "player_name")


# ---- joins


@query
def attack_slab(spark, sf):
    rows = A.attack_slab(S.tracking(spark, sf), A.attack_ranges(S.play(spark, sf)))
    return rows.select(*ATTACK, "rid", "frame", *big("ha"), *big("no"), r6("x").alias("x"), r6("y").alias("y"))


@query
def entity_ids(spark, sf):
    return scenes(spark, sf).entities.select(*ATTACK, "entity_idx", *big("ha"), *big("no"), "entity_id")


@query
def drop_substituted(spark, sf):
    play = S.play(spark, sf)
    ranges = A.attack_ranges(play)
    counts = E.entity_frame_counts(A.attack_slab(S.tracking(spark, sf), ranges))
    left = E.drop_substituted(counts, A.substitutions_in_attacks(play, ranges))
    return left.select(*ATTACK, *big("ha"), *big("no"), "n_rows")


@query
def enrich_tracking(spark, sf):
    rows = R.enrich_tracking(S.tracking(spark, sf), S.play(spark, sf), S.players(spark, sf))
    return rows.select("rid", "game_id", *big("ha"), *big("no"), "player_name", "player_id")


@query
def labelled_vectors(spark, sf):
    rows = EV.labelled_vectors(S.vectors(spark, sf), _some_labels(spark, sf))
    return long_vec(rows, "id", "label")


def _some_labels(spark, sf):
    """Labels of the documents on one side, vectors on the other: neither covers the other."""
    docs = S.table(spark, sf, "labels")
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("string").alias("label"))


@query
def lookup_vector(spark, sf):
    rows = LK.lookup_vector(S.supervision_rows(spark, sf), S.vectors(spark, sf))
    return long_vec(rows, "id", "turn", "vector_id")


@query
def resolve_player_exact(spark, sf):
    roster = T.shape_roster(S.roster_rows(spark, sf))
    rows = LK.resolve_player(S.questions(spark, sf), roster, fuzzy=False)
    return rows.select("question_id", "player_id", *big("stage"))


@query
def resolve_player(spark, sf):
    roster = T.shape_roster(S.roster_rows(spark, sf))
    return LK.resolve_player(S.questions(spark, sf), roster).select("question_id", "player_id", *big("stage"))


def _labelled(spark, sf, space="style"):
    return EV.labelled_vectors(_spaces(spark, sf)[space], S.labels(spark, sf))


def _spaces(spark, sf):
    """The given vectors, and a second space that weighs their numbers by position."""
    vectors = S.vectors(spark, sf)
    return {"style": vectors, "baseline_p": vectors.withColumn("vec", F.transform("vec", lambda x, i: x * (i % 3 + 1)))}


@query
def knn_pairs(spark, sf):
    pairs = NB.knn_pairs(_labelled(spark, sf), 10)
    return pairs.select("id", "rank", "neighbour", r6("distance").alias("distance"))


@query
def knn_pairs_euclidean(spark, sf):
    pairs = NB.knn_pairs(_labelled(spark, sf), 10, "euclidean", chunk_rows=256)
    return pairs.select("id", "rank", "neighbour", r6("distance").alias("distance"))


@query
def knn_index(spark, sf):
    pairs = VI.knn_index(_labelled(spark, sf), 10)
    return pairs.select("id", "rank", "neighbour", r6("distance").alias("distance"))


@query
def knn_recall(spark, sf):
    """Whether the approximate form finds nine tenths of the true neighbours."""
    rows = _labelled(spark, sf)
    found, exact = VI.knn_index(rows, 10, recall=0.95), NB.knn_pairs(rows, 10)
    return VI.recall_of(found, exact).select("pairs", (F.col("recall") >= 0.9).alias("reached"))


def _keyed(spark, sf):
    return S.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))


@query
def batch_similarity(spark, sf):
    rows = TR.batch_similarity(_keyed(spark, sf), "vec_id")
    out = rows.select("batch_id", "vec_id", F.posexplode("sims").alias("pos", "sim"))
    return out.select("batch_id", "vec_id", *big("pos"), r6("sim").alias("sim"))


@query
def supervision_with_vectors(spark, sf):
    rows = LK.supervision_with_vectors(T.shape_supervision(S.supervision_rows(spark, sf)), S.vectors(spark, sf))
    weighted = F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("id", "prompt", "target", F.size("vec").cast("bigint").alias("width"), r6(weighted).alias("weighted"))


# ---- aggregations


@query
def row_and_batch_count(spark, sf):
    return R.row_and_batch_count(S.tracking(spark, sf), 32).select(*big("n_rows", "n_batches"))


@query
def attack_count(spark, sf):
    return A.attack_count(S.play(spark, sf))


@query
def attack_list(spark, sf):
    return A.attack_list(S.play(spark, sf))


@query
def attack_ranges(spark, sf):
    return A.attack_ranges(S.play(spark, sf))


@query
def entity_frame_counts(spark, sf):
    slab = A.attack_slab(S.tracking(spark, sf), A.attack_ranges(S.play(spark, sf)))
    return E.entity_frame_counts(slab).select(*ATTACK, *big("ha", "no"), "n_rows")


@query
def attack_meta(spark, sf):
    meta = SL.attack_meta(scenes(spark, sf))
    ids = F.array_join("entities", ",", "None")
    return meta.withColumn("entities", ids)


@query
def attack_frames(spark, sf):
    return scenes(spark, sf).frames.withColumns({"ball_x": r6("ball_x"), "ball_y": r6("ball_y")})


def _patch_rows(spark, sf):
    found = scenes(spark, sf)
    return P.zero_fill_coords(P.keep_last_frames(P.thin_frames(found.slab, FPS), PATCH)), found.entities


@query
def patch_scale(spark, sf):
    return rounded(P.patch_scale(_patch_rows(spark, sf)[0]), "x_scale", "y_scale")


@query
def player_mean_vectors(spark, sf):
    found = scenes(spark, sf)
    return long_vec(V.player_mean_vectors(W.window_features(found.slab, found.entities, found.lengths, WIN, STRIDE)), "id")


def _targets(spark, sf):
    rows, entities = _patch_rows(spark, sf)
    return TR.frame_deltas(P.patches(P.normalise_coords(rows), entities, PATCH))


@query
def masked_mse(spark, sf):
    guess = F.transform(F.sequence(F.lit(1), F.lit(18)), lambda i: i * 0.001)
    return rounded(TR.masked_mse(_targets(spark, sf).withColumn("pred", guess), "pred", "deltas"), "masked_mse")


@query
def info_nce(spark, sf):
    return rounded(TR.info_nce(_keyed(spark, sf), "vec_id"), "info_nce")


@query
def neighbor_purity(spark, sf):
    return rounded(NB.neighbour_purity(NB.knn_pairs(_labelled(spark, sf), 10)), "neighbor_purity")


def _clustered(spark, sf):
    """The label of each vector beside a cluster cut from its first two numbers."""
    return _labelled(spark, sf).withColumn(
        "cluster", (F.col("vec")[0] > 0).cast("int") * 2 + (F.col("vec")[1] > 0).cast("int")
    )


@query
def nmi(spark, sf):
    return rounded(EV.nmi(_clustered(spark, sf)), "nmi")


@query
def split_sizes(spark, sf):
    split = SP.train_val_test_split(A.attacks(S.play(spark, sf)), ATTACK)
    return rounded(SP.split_sizes(split), "share")


# ---- windows


@query
def frame_index(spark, sf):
    slab = A.attack_slab(S.tracking(spark, sf), A.attack_ranges(S.play(spark, sf)))
    return SL.frame_index(slab.select(*ATTACK, "frame").distinct()).select(*ATTACK, "frame", "frame_idx")


@query
def first_substitution(spark, sf):
    play = S.play(spark, sf)
    rows = A.first_substitution(A.substitutions_in_attacks(play, A.attack_ranges(play)))
    return rows.select(*ATTACK, *big("ha", "shirt_no"), "substitution_frame", "team_id", "player_name")


@query
def select_entities(spark, sf):
    slab = A.attack_slab(S.tracking(spark, sf), A.attack_ranges(S.play(spark, sf)))
    rows = E.select_entities(E.entity_frame_counts(slab), MAX_PLAYERS)
    return rows.select(*ATTACK, *big("ha", "no"), "n_rows", *big("count_rank"), F.col("truncated").cast("bigint").alias("truncated"))


@query
def entity_index(spark, sf):
    rows = E.pad_slots(scenes(spark, sf).entities)
    return rows.select(*ATTACK, "entity_idx", *big("ha", "no"))


@query
def frame_deltas(spark, sf):
    rows = _targets(spark, sf).withColumn("valid", F.col("valid").cast("bigint"))
    return long_vec(rows, *ATTACK, "entity_idx", "valid", vec="deltas")


@query
def keep_last_frames(spark, sf):
    rows = P.keep_last_frames(P.thin_frames(scenes(spark, sf).slab, FPS), PATCH)
    return rows.select(*ATTACK, "entity_idx", *big("frame_idx", "frame_count"), r6("x").alias("x"), r6("y").alias("y"))


@query
def sliding_windows(spark, sf):
    return W.sliding_windows(scenes(spark, sf).lengths, WIN, STRIDE)


@query
def batch_id(spark, sf):
    return R.batch_id(S.tracking(spark, sf), "rid", 32).select("rid", *big("batch_id"))


@query
def last_wins(spark, sf):
    rows = E.last_wins(S.tracking(spark, sf).select("game_id", "frame", "ha", "no", "x", "rid"), ["game_id", "frame", "ha", "no"], "rid")
    return rows.select("game_id", "frame", *big("ha", "no"), r6("x").alias("x"), "rid")


@query
def player_order(spark, sf):
    found = scenes(spark, sf)
    return V.player_order(E.player_rows_only(found.entities).select(F.col("entity_id").alias("id")).distinct())


# ---- sorts, limits, samples


@query
def page(spark, sf):
    return R.page(S.tracking(spark, sf), 7, "rid", 32).select("rid", "game_id", "frame")


@query
def stored_page(spark, sf):
    path = fresh_path(spark)
    PG.write_pages(S.tracking(spark, sf), path, "rid")
    return PG.read_page(spark, path, 7, 32).select("rid", "game_id", "frame")


@query
def sample_rows(spark, sf):
    return R.sample_rows(S.tracking(spark, sf), 32, ["rid"]).select("rid", "game_id", "frame")


@query
def sample_attack(spark, sf):
    return R.sample_attack(A.attacks(S.play(spark, sf)))


@query
def train_val_test_split(spark, sf):
    return SP.train_val_test_split(A.attacks(S.play(spark, sf)), ATTACK).select(*ATTACK, "split")


@query
def head(spark, sf):
    return R.head(S.tracking(spark, sf), 10, "game_id", "frame", "rid").select("rid", "game_id", "frame")


# ---- set operations


@query
def name_pool(spark, sf):
    return LK.name_pool(T.shape_roster(S.roster_rows(spark, sf))).select("id", "label", *big("kind"))


@query
def common_ids(spark, sf):
    return EV.common_ids(S.vectors(spark, sf), _some_labels(spark, sf))


@query
def unlabelled_ids(spark, sf):
    return EV.unlabelled_ids(S.vectors(spark, sf), _some_labels(spark, sf))


@query
def missing_vectors(spark, sf):
    asked = S.table(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("id"))
    return LK.missing_vectors(asked, S.vectors(spark, sf))


@query
def distinct_labels(spark, sf):
    return EV.distinct_labels(S.labels(spark, sf))


# ---- scalar functions


@query
def attack_stem(spark, sf):
    return A.attacks(S.play(spark, sf)).select(*ATTACK, TX.attack_stem("game_id", "attack_no").alias("stem"))


@query
def zero_fill(spark, sf):
    gaps = F.when(F.col("x") > 0, F.col("x")).when(F.col("x") < -20, F.lit(float("nan")))
    return S.tracking(spark, sf).select("rid", r6(AR.zero_fill(gaps)).alias("x"))


@query
def thin_frames(spark, sf):
    rows = P.thin_frames(scenes(spark, sf).slab, 5)
    return rows.select(*ATTACK, "entity_idx", *big("frame_idx", "frame_count"), r6("x").alias("x"), r6("y").alias("y"))


@query
def pad_crop_patch(spark, sf):
    patch = P.pad_crop_patch(_targets(spark, sf), 14)
    return both_axes(patch, *ATTACK, "entity_idx")


@query
def pad_window(spark, sf):
    return both_axes(W.pad_window(scenes(spark, sf).slab, WIN, STRIDE), *W.WINDOW, "entity_idx")


@query
def normalise_coords(spark, sf):
    rows = P.normalise_coords(_patch_rows(spark, sf)[0])
    return rows.select(*ATTACK, "entity_idx", *big("frame_idx"), r6("x").alias("x"), r6("y").alias("y"))


@query
def patches(spark, sf):
    found = scenes(spark, sf)
    out = P.patches(P.patch_rows(found.slab, PATCH, FPS), found.entities, PATCH)
    return both_axes(out, *ATTACK, "entity_idx", "player_code")


@query
def player_code(spark, sf):
    rows = E.pad_slots(scenes(spark, sf).entities)
    code = F.coalesce(E.player_code(), F.lit(0)).cast("bigint")
    return rows.select(*ATTACK, "entity_idx", code.alias("player_code"))


@query
def parse_list_text(spark, sf):
    meta = SL.attack_meta(scenes(spark, sf))
    quoted = F.transform(
        "entities", lambda e: F.when(e == "ball", "'ball'").otherwise(F.coalesce(e, F.lit("None")))
    )
    text = meta.select(*ATTACK, F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")).alias("t"))
    items = text.select(*ATTACK, F.posexplode(TX.parse_list_text("t")).alias("pos", "item"))
    return items.select(*ATTACK, *big("pos"), "item")


@query
def strip_casefold(spark, sf):
    padded = F.concat(F.lit("　 "), "c_name", F.lit("\t "))
    return S.table(spark, sf, "customer").select("c_custkey", TX.casefold(TX.strip(padded)).alias("name"))


@query
def split_aliases(spark, sf):
    text = F.concat(F.lit(" | "), "c_mktsegment", F.lit(" ||"), "c_name")
    parts = S.table(spark, sf, "customer").select("c_custkey", F.posexplode(TX.split_aliases(text)).alias("pos", "alias"))
    return parts.select("c_custkey", *big("pos"), "alias")


@query
def parse_question(spark, sf):
    rows = S.questions(spark, sf)
    return rows.select("question_id", TX.asked_team("question").alias("team"), TX.asked_name("question").alias("name"))


@query
def prompt_text(spark, sf):
    rows = S.questions(spark, sf)
    shaped = F.when(F.col("question_id") % 3 == 0, F.regexp_replace("question", "^.*の", "")).when(
        F.col("question_id") % 3 == 1, F.lit("教えて")
    ).otherwise(F.col("question"))
    return rows.select("question_id", TX.prompt_text(shaped).alias("prompt"))


@query
def int_key(spark, sf):
    key = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    mixed = F.when(F.col("c_custkey") % 5 == 0, F.concat(key, F.lit("x"))).otherwise(key)
    return S.table(spark, sf, "customer").select("c_custkey", TX.int_key(mixed).alias("int_key"))


@query
def strip_zeros(spark, sf):
    key = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    mixed = F.when(F.col("c_custkey") % 5 == 0, F.concat(key, F.lit("x"))).otherwise(key)
    return S.table(spark, sf, "customer").select("c_custkey", TX.strip_zeros(mixed).alias("stripped"))


@query
def clean_row_text(spark, sf):
    rows = S.supervision_rows(spark, sf)
    return rows.select("id", "turn", TX.clean("prompt").alias("prompt"), TX.clean("target").alias("target"))


# ---- vectors


@query
def l2_normalise(spark, sf):
    return long_vec(S.vectors(spark, sf).withColumn("vec", AR.l2_normalise("vec")), "id")


@query
def fit_width(spark, sf):
    return long_vec(S.vectors(spark, sf).withColumn("vec", AR.fit_width("vec", 80)), "id")


@query
def window_features(spark, sf):
    found = scenes(spark, sf)
    rows = W.window_features(found.slab, found.entities, found.lengths, WIN, STRIDE)
    return long_vec(rows, *W.WINDOW, "entity_idx", "entity_id", "n_observed")


@query
def conv_features(spark, sf):
    """Few kernels, so that SQL can follow."""
    found = scenes(spark, sf)
    rows = EN.conv_features(found.slab, found.entities, found.lengths, WIN, STRIDE, count=8)
    return long_vec(rows, *W.WINDOW, "entity_idx", "entity_id", "n_observed")


@query
def wide_player_vectors(spark, sf):
    """Length and unit norm of the 256 numbers of each player, from 512 of each window."""
    found = scenes(spark, sf)
    means = V.player_mean_vectors(EN.conv_features(found.slab, found.entities, found.lengths, WIN, STRIDE))
    fitted = means.select("id", AR.l2_normalise(AR.fit_width("vec")).alias("vec"))
    return fitted.select("id", F.size("vec").cast("bigint").alias("width"), r6(AR.norm("vec")).alias("norm"))


@query
def attack_vectors(spark, sf):
    found = scenes(spark, sf)
    return long_vec(V.attack_vectors(W.window_features(found.slab, found.entities, found.lengths, WIN, STRIDE)), *W.WINDOW)


@query
def pca_project(spark, sf):
    return long_vec(V.pca_project(S.vectors(spark, sf), 16).vectors, "id")


@query
def silhouette(spark, sf):
    return rounded(EV.silhouette(_labelled(spark, sf)), "silhouette")


@query
def silhouette_euclidean(spark, sf):
    return rounded(EV.silhouette(_labelled(spark, sf), "euclidean"), "silhouette")


@query
def kmeans_labels(spark, sf):
    rows = EV.kmeans_labels(_labelled(spark, sf))
    return rows.select("id", "label", *big("cluster"))


def _purity_report(spark, sf):
    out = None
    for space in ("style", "baseline_p"):
        both = staged(_labelled(spark, sf, space))
        parts = {"neighbor_purity": NB.neighbour_purity(NB.knn_pairs(both, 10)), "silhouette": EV.silhouette(both)}
        for name, value in parts.items():
            one = value.select(F.lit(space).alias("space"), F.lit(name).alias("metric"), F.col(name).alias("value"))
            out = one if out is None else out.unionByName(one)
    return out


@query
def space_report(spark, sf):
    return rounded(EV.compare_spaces(_spaces(spark, sf), S.labels(spark, sf)), "value")


@query
def layout_2d(spark, sf):
    return rounded(LA.layout_2d(S.vectors(spark, sf)), "x", "y")


def _head_rows(spark, sf):
    """Steps of each slot beside the movement vector of the slot's last window, one unique key for each row."""
    found = scenes(spark, sf)
    target = TR.frame_deltas(P.patches(P.patch_rows(found.slab, PATCH, FPS), found.entities, PATCH))
    vecs = W.window_features(found.slab, found.entities, found.lengths, WIN, STRIDE)
    last = vecs.groupBy(*ATTACK, "entity_idx").agg(F.max_by("vec", "window_id").alias("vec"))
    key = (F.col("game_id") * 1000 + F.col("attack_no")) * 100 + F.col("entity_idx")
    rows = target.join(last, [*ATTACK, "entity_idx"]).withColumn("key", key)
    return staged(rows.withColumn("vec", AR.l2_normalise("vec")).select("key", "vec", "deltas", "valid"))


@query
def delta_head(spark, sf):
    rows = _head_rows(spark, sf)
    out = TR.predict_deltas(rows, TR.fit_delta_head(rows))
    return rounded(TR.masked_mse(out, "pred", "deltas"), "masked_mse")


@query
def evaluate_splits(spark, sf):
    rows = SP.train_val_test_split(_head_rows(spark, sf), ["key"]).withColumn("pred", F.array_repeat(F.lit(0.0), 18))
    return rounded(TR.evaluate_splits(rows, "key"), "loss_delta", "loss_infonce", "loss")


# ---- whole chain


@query
def attack_scene_summary(spark, sf):
    """Flagship: every attack with its frames, entities and path, from ranges to the indexed slab in one plan."""
    found = scenes(spark, sf)
    sums = found.slab.groupBy(*ATTACK).agg(
        F.count(F.lit(1)).alias("n_cells"), r6(F.sum("x")).alias("sum_x"), r6(F.sum("y")).alias("sum_y")
    )
    meta = SL.attack_meta(found).drop("tensor_shape_0", "tensor_shape_1", "tensor_shape_2", "entities_count")
    return meta.withColumn("entities", F.array_join("entities", ",", "None")).join(sums, ATTACK, "left")
