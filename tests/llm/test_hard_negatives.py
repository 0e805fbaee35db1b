"""Hard negatives against a loop over all pairs, odd rows, and how much the bounds save."""

import math
import random

import numpy as np
import pytest

from pitchframe.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<double>, label int, v string, id string"


def plain(rows, every=50):
    ok = {
        (i, label, tuple(math.floor(256 * x) for x in v))
        for i, v, label, *_ in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for a in ok:
        if a[0] % every:
            continue
        dot = lambda r: sum(x * y for x, y in zip(a[2], r[2]))
        first = lambda rs: sorted((-dot(r), r[0]) for r in rs)
        for s, i in first(r for r in ok if r[1] == a[1] and r != a)[:5]:
            fit = [(t, n) for t, n in first(r for r in ok if r[1] != a[1]) if 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a[0], i, k, n, -s, -t) for k, (t, n) in enumerate(fit[:3], 1)]
    return sorted(out)


def table(n, seed, width=6, labels=3, copies=0.0, spread=1.0):
    rnd, out = random.Random(seed), []
    for i in range(n):
        v = [0.5] * width if rnd.random() < copies else [round(rnd.gauss(0.3, spread), 2) for _ in range(width)]
        out.append((i, v, rnd.randrange(labels), "x", "y"))
    return out


@pytest.mark.parametrize("n,seed,copies,tree,chunk,every", [(400, 1, 0.0, 2048, 8192, 50), (300, 2, 0.4, 5, 40, 10), (200, 3, 0.1, 3, 17, 5)])
def test_equals_all_pairs(spark, monkeypatch, n, seed, copies, tree, chunk, every):
    monkeypatch.setattr(hn, "TREE", tree)
    monkeypatch.setattr(hn, "CHUNK", chunk)
    monkeypatch.setattr(hn, "FIRST", 4)
    rows = table(n, seed, copies=copies)
    got = sorted(map(tuple, hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=every).collect()))
    assert got == plain(rows, every) and len(got) > 20


def test_odd_rows(spark):
    rows = table(60, 4, labels=2)
    rows += [(0, rows[0][1], rows[0][2], "again", "z"), (0, [1.0] * 6, 1, "other", "z"), (0, [1.0] * 6, 0, "other", "z")]
    rows += [(None, [1.0] * 6, 1, "x", "y"), (70, None, 1, "x", "y"), (71, [1.0] * 6, None, "x", "y"), (72, [None] * 6, 1, "x", "y")]
    rows += [(73, [float("nan")] * 6, 1, "x", "y"), (75, [float("inf")] * 6, 1, "x", "y"), (-5, [], 1, "x", "y"), (80, [1.0, 1.0], 0, "x", "y")]
    rows += [(85, [0.0] * 6, 1, "x", "y"), (90, [-3.0] * 6, 0, "x", "y")]
    got = sorted(map(tuple, hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=5).collect()))
    assert got == plain(rows, 5)
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        hn.hard_negatives(spark.createDataFrame([(0, [1e300], 1, "", "")], SCHEMA))


def test_long_vectors_stay_exact(spark):
    rows = [(i, [float(2**20 + i * 37 % 101), float(2**21 - i * i % 53)], i % 2, "", "") for i in range(30)]
    got = sorted(map(tuple, hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=5).collect()))
    assert got == plain(rows, 5)


def test_walk_bounds_hold_and_save_work():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 200, (10, 16))
    rows = np.floor(np.repeat(centres, 300, axis=0) + rng.normal(0, 4, (3000, 16)))
    anchors = np.floor(np.repeat(centres, 20, axis=0) + rng.normal(0, 4, (200, 16)))
    parent, edge = hn.spanning_tree(anchors)
    assert (parent == -1).sum() == 1 and len(parent) == 200
    true = rows @ anchors.T

    def choose(k, low, high, score):
        assert (low <= true[:, k]).all() and (true[:, k] <= high).all()
        best, _ = hn._highest(np.arange(3000), high, 10)
        floor = hn._nth(score(best), np.ones(10), 10)
        rest = np.setdiff1d(np.flatnonzero(high >= floor), best)
        assert (score(rest) == true[rest, k]).all()

    assert hn.walk(rows, anchors, parent, edge, choose) < 0.5 * true.size
