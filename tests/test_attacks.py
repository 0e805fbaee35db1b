from pitchframe.operators import attacks as A
from pitchframe.operators import entities as E
from pitchframe.operators import slab as SL
from pitchframe.schemas import ATTACK

PLAY = "rid long, game_id long, attack_no long, frame long, ha int, shirt_no int, team_id long, player_name string, action_name string"
TRACK = "rid long, game_id long, frame long, ha int, no int, x double, y double"
PLAYERS = "rid long, game_id long, ha int, shirt_no int, player_id long, player_name string"


def play(spark, extra=()):
    rows = [
        (1, 1, 1, 100, 1, 7, 1, "a", "pass"),
        (2, 1, 1, 110, 1, 7, 1, "a", "shot"),
        (3, 1, 2, 104, 2, 9, 2, "b", "pass"),
        (4, 1, 2, 120, 2, 9, 2, "b", "pass"),
        (5, 1, 0, 999, 1, 7, 1, "a", "pass"),
        (6, 1, None, 5, 1, 7, 1, "a", "pass"),
        *extra,
    ]
    return spark.createDataFrame(rows, PLAY)


def tracking(spark, frames=(99, 100, 102, 104, 111), entities=((0, 0), (1, 7), (1, 10), (2, 9))):
    rows, rid = [], 0
    for f in frames:
        for ha, no in entities:
            rid += 1
            rows.append((rid, 1, f, ha, no, float(f), float(no)))
    return spark.createDataFrame(rows, TRACK)


def players(spark):
    rows = [(1, 1, 1, 7, 70, "a"), (2, 1, 2, 9, 90, "b"), (3, 1, 2, 9, 91, "b2"), (4, None, 1, 1, 1, "x")]
    return spark.createDataFrame(rows, PLAYERS)


def test_ranges_and_slab(spark, rows):
    ranges = A.attack_ranges(play(spark))
    assert rows(ranges, *ATTACK, "min_frame", "max_frame") == [(1, 1, 100, 110), (1, 2, 104, 120)]
    slab = A.attack_slab(tracking(spark, entities=[(1, 7)]), ranges)
    assert rows(slab, "attack_no", "frame") == [(1, 100), (1, 102), (1, 104), (2, 104), (2, 111)]
    assert A.attack_count(play(spark)).first()[0] == 2
    idx = SL.frame_index(slab.select(*ATTACK, "frame").distinct())
    assert rows(idx, "attack_no", "frame", "frame_idx", "frame_count") == [
        (1, 100, 0, 3), (1, 102, 1, 3), (1, 104, 2, 3), (2, 104, 0, 2), (2, 111, 1, 2),
    ]


def test_long_attack_is_ranked_over_cells(spark):
    """Frames far apart fall into many cells; the index still counts observed frames in order."""
    frames = sorted({(i * 7919) % 500_000 for i in range(3000)} | {-5, -2000})
    df = spark.createDataFrame([(1, 1, f) for f in frames], "game_id long, attack_no long, frame long")
    got = {r.frame: (r.frame_idx, r.frame_count) for r in SL.frame_index(df).collect()}
    assert got == {f: (i, len(frames)) for i, f in enumerate(frames)}


def test_interval_over_many_cells(spark):
    from pitchframe.plans.intervals import interval_join

    points = spark.createDataFrame([(1, p) for p in range(-50, 50)], "k int, p long")
    spans = spark.createDataFrame([(1, -33, 21, "a"), (1, 7, 7, "b"), (1, 9, 3, "c"), (2, 0, 9, "d"), (1, None, 4, "e")], "k int, lo long, hi long, n string")
    got = interval_join(points, spans, ["k"], "p", "lo", "hi", width=2).groupBy("n").count()
    assert {r.n: r["count"] for r in got.collect()} == {"a": 55, "b": 1}


def scenes(spark, **options):
    change = [(7, 1, 0, 105, 1, 10, 1, "c", "選手交代")]
    return SL.Scenes(tracking(spark), play(spark, change), players(spark), **options)


def test_scene_entities(spark, rows):
    s = scenes(spark)
    got = rows(s.entities.filter("attack_no = 1"), "entity_idx", "ha", "no", "entity_id")
    assert got == [(0, 0, 0, "ball"), (1, 1, 7, "70"), (2, 2, 9, "91")]
    padded = E.pad_slots(s.entities).filter("attack_no = 1")
    assert padded.count() == 23 and padded.filter("ha is null").count() == 20
    assert rows(s.status) == [(1, 1, "ok", ""), (1, 2, "ok", "")]
    dense = SL.dense_slab(s).filter("attack_no = 1")
    assert dense.count() == 23 * 3 and dense.filter("x is not null").count() == 9
    assert rows(SL.attack_meta(s), "attack_no", "min_frame", "max_frame", "frame_count", "entities")[0][:4] == (1, 100, 110, 3)


def test_incomplete_attacks_can_be_rejected(spark, rows):
    s = scenes(spark, incomplete="reject", stage=False)
    assert rows(SL.status_summary(s.status)) == [("error", "incomplete_entities", 2)]
    assert s.slab.count() == 0 and SL.attack_meta(s).count() == 0


def test_attack_without_tracking(spark, rows):
    lone = play(spark, [(9, 2, 1, 10, 1, 7, 1, "a", "pass")])
    s = SL.Scenes(tracking(spark), lone, players(spark))
    assert (2, 1, "error", "no_tracking") in rows(s.status)


def test_substituted_in_attack_only(spark, rows):
    change = [(7, 1, 0, 112, 1, 10, 1, "c", "選手交代"), (8, 1, 0, 112, 0, 0, 1, "c", "選手交代")]
    s = SL.Scenes(tracking(spark), play(spark, change), players(spark))
    assert (1, 10) in rows(s.entities.filter("attack_no = 1"), "ha", "no")
    assert rows(s.entities.filter("attack_no = 2"), "ha", "no") == [(0, 0), (1, 7), (2, 9)]


def test_first_substitution(spark, rows):
    change = [(7, 1, 0, 106, 1, 10, 1, "z", "選手交代"), (8, 1, 0, 105, 1, 10, 2, "y", "選手交代")]
    p = play(spark, change)
    got = A.first_substitution(A.substitutions_in_attacks(p, A.attack_ranges(p)))
    assert rows(got.filter("attack_no = 1")) == [(1, 1, 1, 10, 105, 2, "y")]


def test_players_cut_to_the_most_seen(spark, rows):
    counts = [(1, 1, 1 + (i >= 12), i, 24 - i) for i in range(24)] + [(1, 1, 0, 0, 1)]
    df = spark.createDataFrame(counts, "game_id long, attack_no long, ha int, no int, n_rows long")
    chosen = E.select_entities(df)
    assert chosen.count() == 23 and chosen.filter("n_rows < 3 and ha > 0").count() == 0
    slots = rows(E.entity_index(chosen), "entity_idx", "n_rows")
    assert slots == [(0, 1)] + [(i + 1, 24 - i) for i in range(22)]


def test_slots_without_cut_or_ball(spark, rows):
    df = spark.createDataFrame([(1, 1, 2, 1, 9), (1, 1, 1, 5, 1), (1, 1, 1, 3, 4)], "game_id long, attack_no long, ha int, no int, n_rows long")
    assert rows(E.entity_index(E.select_entities(df)), "entity_idx", "ha", "no") == [(0, 1, 3), (1, 1, 5), (2, 2, 1)]


def test_last_row_of_a_cell_wins(spark, rows):
    slab = spark.createDataFrame(
        [(1, 1, 5, 1, 7, 1.0, 2.0, 10), (1, 1, 5, 1, 7, None, 3.0, 11), (1, 1, 5, 1, 7, 9.0, 9.0, 2)],
        "game_id long, attack_no long, frame long, ha int, no int, x double, y double, rid long",
    )
    assert rows(SL.cells(slab), "x", "y", "n_rows") == [(None, 3.0, 3)]


def test_player_code(spark, rows):
    df = spark.createDataFrame([("4609",), ("ball",), (None,), ("1000000",), ("x1",), ("9" * 25,)], "entity_id string")
    assert [r[0] for r in df.select(E.player_code()).collect()] == [4609, -1, 0, 0, 0, 0]


def test_one_attack_holding_most_rows(spark, rows):
    """Copies of one cell collapse before the shuffle; the slab keeps one row for each cell."""
    hot = spark.range(30_000).selectExpr(
        "id AS rid", "1L AS game_id", "100 + id % 11 AS frame", "1 AS ha", "CAST(7 + id % 3 AS INT) AS no",
        "CAST(id AS double) AS x", "0.0D AS y",
    )
    s = SL.Scenes(hot, play(spark), players(spark))
    assert s.slab.filter("attack_no = 1").count() == 33
    assert rows(s.entities.filter("attack_no = 1"), "no", "n_rows") == [(7, 10000), (8, 10000), (9, 10000)]
