"""The native ratio against difflib."""

import difflib
import random

import pytest

from pyspark.sql import functions as F

from pitchframe.functions.matching import matching_ratio


@pytest.mark.parametrize("letters,longest,many,seed", [("ab", 9, 200, 1), ("abcdé山😀", 24, 200, 2), ("abcdefgh ", 260, 12, 3), ("aab" + "cdefghijklmnopqrstuvwxyz" * 9, 420, 10, 4)])
def test_equals_difflib(spark, letters, longest, many, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randrange(longest // 2 if many < 50 else 0, longest)))
    rows = [(word(), word()) for _ in range(many)]
    for x, _ in rows[: many // 2]:
        at = rnd.randrange(len(x) + 1)
        rows.append((x, x[:at] + word()[:3] + x[at + 2 :]))
    rows += [("", ""), ("", "a"), ("a", "")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", matching_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.r == difflib.SequenceMatcher(None, r.a, r.b).ratio(), (r.a, r.b)


def test_null(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "a string, b string")
    assert [r[0] for r in df.select(matching_ratio(F.col("a"), F.col("b"))).collect()] == [None, None]
