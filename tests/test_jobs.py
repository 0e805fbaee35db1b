import json
from pathlib import Path

import numpy as np
import pytest

from pitchframe import jobs
from pitchframe.sources import store as ST
from pitchframe.sources import tables as T
from tests.test_attacks import play, players, tracking
from tests.test_sources import write


@pytest.fixture
def season(tmp_path):
    """Two games, two attacks each, the ball and two sides of four, all on their own courses."""
    rng = np.random.default_rng(0)
    for game in (1, 2):
        lines, names = ["GameID,Frame,HA,No,X,Y"], []
        shirts = [(0, 0)] + [(ha, no) for ha in (1, 2) for no in (1, 2, 3, 4)]
        for ha, no in shirts:
            x, y = rng.normal(size=2) * 20
            for f in range(100, 400):
                x, y = x + rng.normal() * (no + 1) / 4, y + rng.normal() / (no + 1)
                lines.append(f"{game},{f},{ha},{no},{x:.2f},{y:.2f}")
            if ha:
                names.append(f"{game},{ha},{no},{ha * 100 + no},P{ha}{no}")
        write(tmp_path / str(game) / "tracking.csv", "\n".join(lines) + "\n")
        write(tmp_path / str(game) / "players.csv", "試合ID,ホームアウェイF,背番号,選手ID,選手名\n" + "\n".join(names) + "\n")
        rows = [f"{game},{a},{f},P11,1,1,5,パス" for a, f in ((1, 110), (1, 260), (2, 250), (2, 380))]
        head = "試合ID,攻撃履歴No,フレーム番号,選手名,選手背番号,ホームアウェイF,チームID,アクション名\n"
        write(tmp_path / str(game) / "play.csv", head + "\n".join([*rows, f"{game},0,300,P24,4,2,6,選手交代"]) + "\n")
    return tmp_path


@pytest.mark.parametrize("fmt", ["parquet", "feather"])
def test_from_csv_to_report(spark, rows, season, fmt):
    out = str(season / "stored")
    summary = jobs.export_attacks(spark, *[f"{season}/*/{n}.csv" for n in ("tracking", "play", "players")], out, fmt)
    assert rows(summary) == [("ok", "", 4)]
    tensor, meta = (ST.read_part(spark, out, p, fmt) for p in ("tensor", "meta"))
    assert tensor.count() == 23 * 2 * (151 + 131)
    # The substituted player is missing from the second attack of each game only.
    ids = {(r.game_id, r.attack_no): r.entities for r in meta.collect()}
    assert "204" in ids[1, 1] and "204" not in ids[1, 2]

    patches = jobs.training_patches(tensor, meta, window=20, ratios=(0.5, 0.25, 0.25)).collect()
    assert len(patches) == 4 * 23 and {len(r.xs) for r in patches} == {20}
    assert sorted(r.split for r in patches if r.entity_idx == 0) == ["test", "train", "train", "val"]
    assert {r.player_code for r in patches if r.entity_idx == 0} == {-1} and max(abs(x) for r in patches for x in r.xs) <= 1 / 1.1 + 1e-9
    assert len(jobs.training_patches(tensor, meta, max_attacks=1).select("game_id", "attack_no").distinct().collect()) == 1

    whole = jobs.build_player_vectors(tensor, meta, f"{season}/v", win=50, stride=25, fps=25, normalise=False, width=4)
    jobs.build_player_vectors(tensor, meta, f"{season}/w", win=20, stride=10, width=4)
    assert whole.vectors.count() == 8
    back = T.read_embeddings_csv(spark, f"{season}/v/player_vectors")
    assert {r.id for r in back.collect()} == {f"{h}0{n}" for h in (1, 2) for n in (1, 2, 3, 4)}
    assert all(abs(np.linalg.norm(r.vec) - 1) < 1e-9 for r in back.collect())

    write(season / "labels.csv", "id,style\n" + "".join(f"{h}0{n},{'fast' if n > 2 else 'slow'}\n" for h in (1, 2) for n in (1, 2, 3, 4)))
    spaces = {"style": f"{season}/v/player_vectors", "baseline_p": f"{season}/w/player_vectors"}
    report = jobs.style_report(spark, spaces, f"{season}/labels.csv", f"{season}/m", "style", k=3)
    assert report.count() == 6
    text = json.loads("".join(p.read_text() for p in Path(season / "m").glob("part-*")))
    assert {k: set(v) for k, v in text.items()} == {s: {"neighbor_purity", "silhouette", "nmi"} for s in spaces}


def test_answers(spark):
    roster = spark.createDataFrame([("007", "家長 昭博", "川崎", ""), ("8", "田中", "川崎", "Ao")], "id string, name string, team string, aka string")
    vectors = spark.createDataFrame([("7", [3.0, 4.0])], "id string, vec array<double>")
    asked = spark.createDataFrame([("川崎の家長 昭博選手について",), ("Ao選手",), ("誰",)], "question string")
    got = {r.question: r for r in jobs.answer_rows(asked, T.shape_roster(roster), vectors, template=True).collect()}
    a, b, c = (got[q.question] for q in asked.collect())
    assert (a.player_id, a.vector_id, a.vec[:2]) == ("007", "7", [0.6, 0.8]) and a.prompt.startswith("選手名: 家長 昭博、チーム: 川崎\n")
    assert (b.player_id, b.vec) == ("8", None) and c.player_id is None and c.prompt.startswith("この選手の")


def test_batches(spark, rows):
    t, p, r = tracking(spark), play(spark), players(spark)
    span, seen, acts = jobs.attack_batch(t, p, 1, 2)
    assert rows(span) == [(1, 2, 104, 120)] and {x.frame for x in seen.collect()} == {104, 111} and acts.count() == 2
    assert rows(jobs.attack_batch(t, p, seed=1)[0]) == rows(jobs.attack_batch(t, p, seed=1)[0])
    with pytest.raises(ValueError):
        jobs.attack_batch(t, p, 1, 77)
    assert jobs.tracking_batch(t, p, r, 0, 4).select("rid").distinct().count() == 4
    assert jobs.tracking_batch(t, p, r, size=5).select("rid").distinct().count() == 5


def test_batches_of_a_read_table_do_not_depend_on_splits(spark, tmp_path):
    for game in (1, 2):
        lines = [f"{game},{100 + f},1,{f % 5},{f}.5,{'NaN' if f == 3 else f}" for f in range(60)]
        write(tmp_path / str(game) / "tracking.csv", "GameID,Frame,HA,No,X,Y\n" + "\n".join(lines) + "\n")
    was, told = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    p, r = play(spark), players(spark)
    try:
        for size in ("150b", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            t = T.shape_tracking(T.read_csv(spark, f"{tmp_path}/*/tracking.csv"))
            parts = t.rdd.getNumPartitions()
            pages = [[(x.game_id, x.frame) for x in jobs.tracking_batch(t, p, r, i, 50).orderBy("rid").collect()] for i in range(3)]
            chosen = {(x.game_id, x.frame) for x in jobs.tracking_batch(t, p, r, size=7).collect()}
            told.append((pages, chosen))
            assert t.where("y IS NULL").count() == 2 and t.where("isnan(y)").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert told[0] == told[1] and len(told[0][1]) == 7 and parts < 20
    assert [x for page in told[0][0] for x in page] == [(g, 100 + f) for g in (1, 2) for f in range(60)]


def test_stored_slab_keeps_players_without_an_id(spark, season):
    """One shirt is missing from players.csv: its slot keeps its path, with player code 0."""
    for game in (1, 2):
        at = season / str(game) / "players.csv"
        at.write_text("".join(line for line in at.read_text().splitlines(keepends=True) if ",102," not in line))
    out = str(season / "stored")
    jobs.export_attacks(spark, *[f"{season}/*/{n}.csv" for n in ("tracking", "play", "players")], out)
    tensor, meta = (ST.read_part(spark, out, p) for p in ("tensor", "meta"))
    seen = {tuple(r) for r in tensor.where("x IS NOT NULL").select("game_id", "attack_no", "entity_idx").distinct().collect()}
    patches = jobs.training_patches(tensor, meta, window=20).collect()
    assert {(r.game_id, r.attack_no, r.entity_idx) for r in patches if any(r.xs)} == seen
    unknown = {(r.game_id, r.attack_no, i) for r in meta.collect() for i, e in enumerate(r.entities) if e is None} & seen
    assert len(unknown) == 4 and all(r.player_code == 0 for r in patches if (r.game_id, r.attack_no, r.entity_idx) in unknown)
