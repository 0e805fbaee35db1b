import pandas as pd
import pyarrow.feather as feather
import pytest

from pitchframe.operators import rows as R
from pitchframe.operators import slab as SL
from pitchframe.schemas import ATTACK
from pitchframe.sources import store as ST
from pitchframe.sources import tables as T
from tests.test_attacks import play, players, scenes, tracking


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf8")


@pytest.fixture
def star(tmp_path):
    for game in (1, 2):
        write(
            tmp_path / str(game) / "tracking.csv",
            "GameID,Frame,HA,SysTarget,No,X,Y,Speed\n" + "".join(f"{game},{f},1,0,7.0,{f}.5,,1\n" for f in (10, 11, 12)),
        )
        write(
            tmp_path / str(game) / "play.csv",
            "試合ID,攻撃履歴No,フレーム番号,選手名,選手背番号,ホームアウェイF,チームID,アクション名\n"
            f"{game},1,10,山田,7,1,100,パス\n{game},1,12,,,,,\n{game},0,12,田中,8,1,100,選手交代\n",
        )
        write(tmp_path / str(game) / "players.csv", f"試合ID,ホームアウェイF,背番号,選手ID,選手名\n{game},1,7,70,山田\n{game},1,7,71,山田\n{game},1,x,72,誰か\n")
    return tmp_path


def test_csv_star(spark, rows, star):
    t, p, r = T.read_tracking_star(spark, *[f"{star}/*/{n}.csv" for n in ("tracking", "play", "players")])
    assert t.count() == 6 and p.count() == 6 and r.count() == 6
    assert t.drop("rid").dtypes == [("game_id", "bigint"), ("frame", "bigint"), ("ha", "int"), ("no", "int"), ("x", "double"), ("y", "double")]
    s = SL.Scenes(t, p, r)
    assert rows(s.ranges) == [(1, 1, 10, 12), (2, 1, 10, 12)]
    # The last of two rows of one shirt is the one that counts.
    assert rows(s.entities, "game_id", "entity_id") == [(1, "71"), (2, "71")]
    assert s.slab.count() == 6


def test_missing_source_is_named(spark, star):
    with pytest.raises(FileNotFoundError, match="play"):
        T.read_tracking_star(spark, f"{star}/*/tracking.csv", f"{star}/*/nothing.csv", f"{star}/*/players.csv")
    with pytest.raises(ValueError, match="columns missing"):
        T.shape_tracking(T.read_csv(spark, f"{star}/*/players.csv"))


def test_read_order_over_files(spark, tmp_path):
    """Labels: within a file the later line wins, over files the later name."""
    write(tmp_path / "l" / "a.csv", "id,style\n1,x\n1,y\n2,z\n")
    write(tmp_path / "l" / "b.csv", "id,style\n2,w\n3,v\n")
    got = T.read_labels(spark, f"{tmp_path}/l", "style").collect()
    assert sorted(tuple(r) for r in got) == [("1", "y"), ("2", "w"), ("3", "v")]


def test_embeddings_csv(spark, rows, tmp_path):
    write(tmp_path / "e.csv", "id,p0,p1,p2\n7,1.5,,3\n8,1,2,3\n8,4,5,6\n")
    got = {r.id: r.vec for r in T.read_embeddings_csv(spark, f"{tmp_path}/e.csv").collect()}
    assert got == {"7": [1.5, 3.0], "8": [4.0, 5.0, 6.0]}
    with pytest.raises(Exception, match="blank cell"):
        T.read_embeddings_csv(spark, f"{tmp_path}/e.csv", strict=True).collect()
    df = spark.createDataFrame([("a", [0.1, 0.2]), ("b", [1e-9])], "id string, vec array<double>")
    T.write_embeddings_csv(df, f"{tmp_path}/out", "s")
    back = {r.id: r.vec for r in T.read_embeddings_csv(spark, f"{tmp_path}/out").collect()}
    assert back == {"a": [0.1, 0.2], "b": [1e-9]}


def test_roster(spark, tmp_path):
    write(tmp_path / "r.csv", "PID,Player_Name,AKA\n 7 , 家長 昭博 ,Aki| |AK \n")
    r = T.read_roster(spark, f"{tmp_path}/r.csv").first()
    assert (r.id, r.name, r.team, r.alts, r.alts_lc) == ("7", "家長 昭博", "", ["Aki", "AK"], ["aki", "ak"])
    write(tmp_path / "bad.csv", "id,team\n1,x\n")
    with pytest.raises(ValueError):
        T.read_roster(spark, f"{tmp_path}/bad.csv")


def test_supervision_and_manifest(spark, tmp_path):
    write(tmp_path / "s.csv", "id,prompt,target\n6,p,\n")
    with pytest.raises(ValueError):
        T.read_supervision(spark, f"{tmp_path}/s.csv")
    ids = ",".join(str(i) for i in range(1, 26))
    write(tmp_path / "m.csv", f'path,player_ids,team_id\na,"3,,5",\nb,"{ids}",2\n')
    a, b = T.read_manifest(spark, f"{tmp_path}/m.csv").orderBy("path").collect()
    assert a.player_ids == [3, 5] + [0] * 21 and a.team_id == 0
    assert b.player_ids == list(range(1, 24)) and b.team_id == 2


def test_short_line_stops_the_read(spark, tmp_path):
    write(tmp_path / "x.csv", "id,label\n1,a\n2\n")
    with pytest.raises(Exception):
        T.read_csv(spark, f"{tmp_path}/x.csv").select("id", "label").collect()


@pytest.mark.parametrize("fmt", ["parquet", "feather"])
def test_store_round_trip(spark, rows, tmp_path, fmt):
    s, path = scenes(spark), str(tmp_path / fmt)
    ST.write_attacks(s, path, fmt)
    ST.write_attacks(s, path, fmt)
    cols = [*ATTACK, "entity_idx", "frame_idx", "x", "y"]
    assert rows(ST.read_part(spark, path, "tensor", fmt), *cols) == rows(SL.dense_slab(s), *cols)
    one = ST.load_attack(spark, path, 1, 1, fmt)
    assert one.tensor.count() == 69 and rows(one.frames) == [(0, 100), (1, 102), (2, 104)]
    assert [r.entity_id for r in one.entities.orderBy("entity_idx").collect()][:4] == ["ball", "70", "91", None]
    assert rows(one.info) == [(1, 1, 100, 110, 3)]
    with pytest.raises(FileNotFoundError):
        ST.load_attack(spark, path, 5, 5, fmt)
    with pytest.raises(FileNotFoundError):
        ST.read_part(spark, path + "x", "meta", fmt)
    listed = ST.list_attacks(ST.read_part(spark, path, "meta", fmt), ST.read_part(spark, path, "tensor", fmt))
    assert [r.stem for r in listed.collect()] == ["attack_1_0001", "attack_1_0002"]


def test_file_per_attack_tree(spark, tmp_path):
    """Trees with one Feather file for each attack and lists stored as text."""
    for part in ("tensor", "meta"):
        (tmp_path / part).mkdir()
    for no in (1, 2):
        t = pd.DataFrame({"entity_idx": [0, 1], "frame_idx": [0, 0], "x": [1.5, float("nan")], "y": [2.0, float("nan")]})
        m = pd.DataFrame({"attack_no": [no], "game_id": [2022], "min_frame": [5], "entities": ["['ball', 4609, None]"], "frames": ["[5, 6]"]})
        feather.write_feather(t.astype({"x": "float32", "y": "float32"}), tmp_path / "tensor" / f"attack_2022_{no:04d}.feather")
        feather.write_feather(m, tmp_path / "meta" / f"attack_2022_{no:04d}.feather")
    tensor, meta = ST.read_stem_tree(spark, str(tmp_path))
    assert sorted(tuple(r) for r in tensor.filter("entity_idx = 0").collect()) == [(2022, 1, 0, 0, 1.5, 2.0), (2022, 2, 0, 0, 1.5, 2.0)]
    assert tensor.filter("x is null").count() == 2
    assert meta.filter("attack_no = 2").first().entities == ["ball", "4609", None]
    assert meta.first().frames == [5, 6]


def test_pages_samples_counts(spark, rows):
    t = tracking(spark)
    assert rows(R.row_and_batch_count(t, 6)) == [(20, 4)]
    pages = [r for i in range(4) for r in rows(R.page(t, i, batch_size=6), "rid")]
    assert pages == rows(t, "rid") and R.page(t, 9, batch_size=6).count() == 0
    got = rows(R.sample_rows(t, 5, ["rid"]), "rid")
    assert len(set(got)) == 5 and got == rows(R.sample_rows(t.repartition(7), 5, ["rid"]), "rid")
    with pytest.raises(ValueError):
        R.sample_rows(t, 21, ["rid"])
    assert R.sample_attack(spark.createDataFrame([(1, 2)], "game_id int, attack_no int")).count() == 1
    assert rows(R.head(t, 2, "frame", "rid"), "rid") == [(1,), (2,)]


def test_enriched_tracking(spark, rows):
    """All players rows of the key and name; none for an unknown name."""
    more = players(spark).unionByName(spark.createDataFrame([(9, 1, 1, 7, 77, "a")], players(spark).schema))
    got = R.enrich_tracking(tracking(spark, frames=(99,)), play(spark), more)
    assert rows(got, "ha", "no", "player_name", "player_id") == [
        (0, 0, None, None), (1, 7, "a", 70), (1, 7, "a", 77), (1, 10, None, None), (2, 9, "b", 90),
    ]


def test_profile(spark, rows):
    got = rows(R.table_profile("t", tracking(spark)), "ordinal", "column_name", "column_type", "n_rows")
    assert got[1] == (1, "game_id", "bigint", 20) and len(got) == 7


def test_csv_quotes_breaks_and_headers(spark, tmp_path):
    from pitchframe.sources.tables import read_labels, read_supervision

    (tmp_path / "s.csv").write_text('id,prompt,target\n7,"say ""hi"", now","two\nlines"\n')
    got = read_supervision(spark, str(tmp_path / "s.csv")).collect()
    assert [(r.id, r.prompt, r.target) for r in got] == [("7", 'say "hi", now', "two\nlines")]
    (tmp_path / "l.csv").write_text("id,label\n1,a\n2,\n")
    assert sorted(tuple(r) for r in read_labels(spark, str(tmp_path / "l.csv")).collect()) == [("1", "a"), ("2", "")]


@pytest.mark.parametrize("fmt,dies_at", [("parquet", 0), ("parquet", 3), ("parquet", 4), ("feather", 1)])
def test_dead_export_leaves_the_old_state(spark, rows, tmp_path, monkeypatch, fmt, dies_at):
    """An export that dies before, between or after its tables, but before its commit, changes nothing that is read."""
    s, path = scenes(spark), str(tmp_path / "s")
    ST.write_attacks(s, path, fmt)
    before = {p: rows(ST.read_part(spark, path, p, fmt)) for p in ST.PARTS}
    done = []

    def dying(step):
        def run(*args):
            if len(done) == dies_at:
                raise RuntimeError("lost")
            done.append(args)
            step(*args)

        return run

    monkeypatch.setattr(ST, "_write_part", dying(ST._write_part))
    monkeypatch.setattr(ST, "_commit", dying(ST._commit))
    with pytest.raises(RuntimeError, match="lost"):
        ST.write_attacks(s, path, fmt)
    monkeypatch.undo()
    assert len(done) == dies_at and {p: rows(ST.read_part(spark, path, p, fmt)) for p in ST.PARTS} == before
    ST.write_attacks(s, path, fmt)
    assert {p: rows(ST.read_part(spark, path, p, fmt)) for p in ST.PARTS} == before


def test_commits_add_up_and_old_states_go(spark, rows, tmp_path):
    s, path = scenes(spark), str(tmp_path / "s")
    with pytest.raises(ValueError):
        ST.write_attacks(s, path, mode="truncate")
    ST.write_attacks(s, path, mode="errorifexists")
    once = rows(ST.read_part(spark, path, "status"))
    with pytest.raises(FileExistsError):
        ST.write_attacks(s, path, mode="errorifexists")
    ST.write_attacks(s, path, mode="ignore")
    ST.write_attacks(s, path, mode="append")
    assert rows(ST.read_part(spark, path, "status")) == sorted(once * 2)
    first, second = ST.committed_states(spark, path)[1]
    assert ST.drop_old_states(spark, path) == []
    ST.write_attacks(s, path)
    assert set(ST.drop_old_states(spark, path)) == {first, second} and not (tmp_path / "s" / first).exists()
    assert rows(ST.read_part(spark, path, "status")) == once and ST.drop_old_states(spark, path) == []


@pytest.mark.parametrize("fmt", ["parquet", "feather"])
def test_exports_without_commits_stay_readable(spark, rows, tmp_path, fmt):
    s, path = scenes(spark), str(tmp_path / "s")
    for part, df in {"meta": SL.attack_meta(s), "status": s.status, "frames": s.frames, "tensor": SL.dense_slab(s).drop("frame_count")}.items():
        ST._write_part(df, f"{path}/{part}", part, fmt)
    old = rows(ST.read_part(spark, path, "frames", fmt))
    assert len(old) == s.frames.count() and ST.load_attack(spark, path, 1, 1, fmt).tensor.count() == 69
    ST.write_attacks(s, path, fmt, "append")
    assert rows(ST.read_part(spark, path, "frames", fmt)) == sorted(old * 2)
    ST.write_attacks(s, path, fmt)
    assert rows(ST.read_part(spark, path, "frames", fmt)) == old
