import difflib
import random

import pytest
from pyspark.sql import functions as F

from pitchframe.functions import text as TX
from pitchframe.operators import lookup as LK
from pitchframe.sources import tables as T


def one(spark, expr, *values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return [r[0] for r in df.select(expr).collect()]


def test_strip_and_casefold_like_python(spark):
    texts = [" a ", "　山川 一郎　", "\x1c\x1fx\x85", " Straße\t", "ΣΑΣ", "ıİI", "", "a b", "µK", "​x", "ŉ", "a\n"]
    assert one(spark, TX.strip("c"), *texts) == [t.strip() for t in texts]
    assert one(spark, TX.casefold("c"), *texts) == [t.casefold() for t in texts]


def test_aliases(spark):
    assert one(spark, TX.split_aliases("c"), " a | b||　c ", "", None) == [["a", "b", "c"], [], []]


def test_question(spark, rows):
    q = ["港町ブルーの山川 一郎選手について教えて", "田中選手について", "教えて", "A B選手", "\n田中選手"]
    assert one(spark, TX.asked_team("c"), *q) == ["港町ブルー", None, None, None, None]
    assert one(spark, TX.asked_name("c"), *q) == ["山川 一郎", "田中", None, "B", "田中"]
    prompts = one(spark, TX.prompt_text("c"), *q[:3])
    assert prompts[0].startswith("選手名: 山川 一郎、チーム: 港町ブルー\nこの選手の")
    assert prompts[1].startswith("選手名: 田中\n") and prompts[2].startswith("この選手の") and prompts[2].endswith("\n質問: 教えて")


def test_list_text(spark):
    got = one(spark, TX.parse_list_text("c"), "[4609, 'ball', None]", "[]", "oops", '["o\'n", 5]', None)
    assert got == [["4609", "ball", None], [], None, ["o'n", "5"], None]


def test_stem(spark):
    assert spark.range(1).select(TX.attack_stem(F.lit(2022091601), F.lit(1))).first()[0] == "attack_2022091601_0001"


def vectors(spark, *ids):
    return spark.createDataFrame([(i, [3.0, 4.0]) for i in ids], "id string, vec array<double>")


def test_lookup(spark, rows):
    asked = spark.createDataFrame([("007",), ("000",), ("00x",), ("9",), ("7",)], "id string")
    known = vectors(spark, "7", "0", "x")
    assert rows(LK.lookup_vector(asked, known), "id", "vector_id") == [("000", "0"), ("007", "7"), ("00x", "x"), ("7", "7")]
    assert rows(LK.missing_vectors(asked, known)) == [("9",)]
    both = vectors(spark, "007", "7")
    assert rows(LK.lookup_vector(asked.filter("id = '007'"), both), "vector_id") == [("007",)]


def test_supervision(spark, rows):
    raw = spark.createDataFrame([("5", "p ", " t"), ("6", "p", ""), ("7", "", "t"), ("", "p", "t")], "id string, prompt string, target string")
    shaped = T.shape_supervision(raw)
    assert rows(shaped) == [("5", "p", "t")]
    out = LK.supervision_with_vectors(shaped, vectors(spark, "5")).first()
    assert len(out.vec) == 256 and out.vec[:3] == [0.6, 0.8, 0.0]


PLAYERS = [
    ("1", "Torsen", "Harbor", "Miki"),
    ("2", "Torsenius", "Harbor", ""),
    ("10", "Aldana", "Harbor", "Aldo"),
    ("3", "Aldana", "Valley", "Jonny"),
    ("4", "Quillfeather", "Valley", "PQ"),
    ("5", "Bramwell", "Valley", ""),
    ("6", "Lindax", "North", ""),
    ("7", "Linday", "North", ""),
]
ANSWERS = [
    ("Torsen選手", "1", 1),  # equal, though another name holds it
    ("TORSEN選手", "1", 1),
    ("miki選手", "1", 1),  # an alias
    ("Aldana選手", "3", 1),  # two are equal: the shorter id
    ("HarborのAldana選手", "10", 1),
    ("harのAldana選手", "10", 1),  # part of a team's name
    ("NowhereのAldana選手", "3", 1),  # no such team: everybody
    ("feather選手", "4", 2),
    ("senius選手", "2", 2),
    ("orsen選手", "1", 3),  # two hold it, so the more similar one
    ("Quilfeather選手", "4", 3),  # 22/23
    ("Bramwoll選手", "5", 3),  # 14/16
    ("Jonni選手", "3", 3),  # an alias, 8/10
    ("Lindaz選手", "7", 3),  # equally similar: the last label
    ("ValleyのTorsen選手", None, None),
    ("Zzyzx選手", None, None),
]


def test_answers_worked_by_hand(spark, rows):
    roster = spark.createDataFrame(PLAYERS, "id string, name string, team string, alt_names string")
    asked = spark.createDataFrame([(q,) for q, _, _ in ANSWERS], "question string")
    out = LK.resolve_player(asked, T.shape_roster(roster))
    assert rows(out, "question", "player_id", "stage") == sorted(ANSWERS, key=lambda r: r[0])


def facts(team, name, roster):
    """Ids whose labels equal the name, ids whose labels hold it, and the best ratio of each id, within the team asked."""
    labels = {i: [n, *a] for i, n, t, a in roster if team and team.lower() in t.lower()} or {i: [n, *a] for i, n, _, a in roster}
    equal = {i for i, of in labels.items() if any(x.lower() == name.lower() for x in of)}
    holds = {i for i, of in labels.items() if any(name.lower() in x.lower() for x in of)}
    return equal, holds, {i: max(difflib.SequenceMatcher(None, x, name).ratio() for x in of) for i, of in labels.items()}


@pytest.mark.parametrize("letters, seed", [("abc", 1), ("abcdefgh山川一郎", 2), ("ab", 3)])
def test_each_stage_has_its_reason(spark, letters, seed):
    rng = random.Random(seed)
    word = lambda lo, hi: "".join(rng.choice(letters) for _ in range(rng.randint(lo, hi)))
    teams = [word(2, 4) for _ in range(5)]
    roster = [
        (str(i), word(3, 9).title(), rng.choice(teams), [word(2, 6) for _ in range(rng.randint(0, 2))]) for i in range(60)
    ]
    asked = []
    for i in range(80):
        base = rng.choice(roster)
        name = rng.choice([base[1], *base[3]])
        cut = rng.randint(0, len(name) - 1)
        name = rng.choice([name, name[:cut] + name[cut + 1 :], name[1:], name + rng.choice(letters), word(3, 8)]) or "q"
        team = rng.choice([None, rng.choice(teams), rng.choice(teams)[:1], "zz"])
        asked.append((i, team, name))
    df = spark.createDataFrame([(i, (t + "の" if t else "") + n + "選手") for i, t, n in asked], "k int, question string")
    raw = spark.createDataFrame([(i, n, t, "|".join(a)) for i, n, t, a in roster], "id string, name string, team string, alt_names string")
    out = {r.k: (r.player_id, r.stage) for r in LK.resolve_player(df, T.shape_roster(raw)).collect()}
    assert len(out) == len(asked)
    for i, team, name in asked:
        player, stage = out[i]
        equal, holds, ratio = facts(team, name, roster)
        likest = max(ratio.values())
        assert (stage == 1) == bool(equal)
        assert (stage == 2) == (not equal and len(holds) == 1)
        assert (stage == 3) == (not equal and len(holds) != 1 and likest >= 0.75)
        assert {1: player in equal, 2: player in holds, 3: ratio.get(player) == likest, None: player is None}[stage]


def test_no_name_no_player(spark, rows):
    raw = spark.createDataFrame([("1", "ann", "", "")], "id string, name string, team string, alt_names string")
    df = spark.createDataFrame([("教えて",), ("ann選手",)], "question string")
    assert rows(LK.resolve_player(df, T.shape_roster(raw))) == [("ann選手", "1", 1), ("教えて", None, None)]


def test_short_names_with_one_letter_less_meet_few_labels(spark):
    """Numbered names share most of their pieces with each other, but pairs stay those of one letter."""
    labels = spark.range(3000).selectExpr("'*' AS scope", "concat('Customer#', lpad(id, 9, '0')) AS label")
    names = spark.createDataFrame([("*", "Customer#00001234"), ("*", "ustomer#000002999"), ("*", "none")], "scope string, name string")
    pairs = LK.similar_pairs(names, labels, 0.95, 3).collect()
    assert 0 < len(pairs) < 60
    best = {r.name: r.label for r in LK.similar_labels(names, labels, 0.95, 3).collect()}
    assert best == {"Customer#00001234": "Customer#000001234", "ustomer#000002999": "Customer#000002999"}
