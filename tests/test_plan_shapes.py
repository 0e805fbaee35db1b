"""What the plans must look like: no pairing of everything, narrow scans, no second shuffle, early limits."""

import re

import pytest

import __spark_entry__ as entry_module
from pitchframe.operators import attacks as A
from pitchframe.operators import entities as E
from pitchframe.operators import slab as SL
from tests.test_queries import FOLDER, needs_tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark):
    """Joins as they run when no side is small."""
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = spark.conf.get(keys[0])
    for k in keys:
        spark.conf.set(k, "-1")
    yield spark
    spark.conf.set(keys[0], before)
    spark.conf.unset(keys[1])


LIGHT = [
    "attack_slab", "attack_ranges", "entity_frame_counts", "enrich_tracking", "drop_substituted", "batch_id", "page",
    "train_val_test_split", "knn_pairs", "neighbor_purity", "silhouette", "silhouette_euclidean", "info_nce", "nmi",
    "lookup_vector", "window_features", "attack_meta", "patches", "distinct_labels", "resolve_player_exact",
]


@needs_tables
@pytest.mark.parametrize("name", LIGHT)
def test_no_pairing_of_everything(shuffled, name):
    shown = plan(entry_module.queries()[name](shuffled, FOLDER))
    assert "Cartesian" not in shown and "NestedLoop" not in shown


def stored(spark, path, ddl):
    spark.createDataFrame([], ddl).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_cells_need_one_shuffle_of_the_tracking(shuffled, tmp_path):
    t = stored(shuffled, f"{tmp_path}/t", "rid long, game_id long, frame long, ha int, no int, x double, y double, speed double")
    r = stored(shuffled, f"{tmp_path}/r", "game_id long, attack_no long, min_frame long, max_frame long")
    shown = plan(SL.cells(A.attack_slab(t, r, keep_cell=True)))
    assert shown.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" in shown
    assert "SortAggregate" not in shown and "speed" not in shown


def test_counts_are_merged_before_the_shuffle(spark, tmp_path):
    t = stored(spark, f"{tmp_path}/t", "game_id long, attack_no long, ha int, no int, n_rows long")
    shown = plan(E.select_entities(t))
    assert re.search(r"WindowGroupLimit .*Partial", shown)
    assert "partial_count" in plan(E.entity_frame_counts(t))


def test_filters_reach_the_scan(spark, tmp_path):
    t = stored(spark, f"{tmp_path}/t", "rid long, game_id long, frame long, ha int, no int, x double, y double")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    shown = plan(A.frame_slice(t, 3, 10, 20).select("x"))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.search(r"PushedFilters: \[(.*?)\]", shown).group(1)
    assert "EqualTo(game_id,3)" in pushed and "GreaterThanOrEqual(frame,10)" in pushed
    assert re.search(r"ReadSchema: struct<rid:bigint,game_id:bigint,frame:bigint,x:double>", shown)
