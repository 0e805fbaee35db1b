"""k-means with all restarts in one pass, against plain numpy runs."""

import numpy as np
import pytest

from pitchframe.operators import clusters as C


def frame(spark, x):
    return spark.createDataFrame([(str(i), [float(v) for v in r]) for i, r in enumerate(x)], "id string, vec array<double>")


def plain(x, starts, rounds):
    """Each restart alone, then the cheapest, its clusters numbered by their first row."""
    runs = []
    for c in starts:
        for _ in range(rounds):
            near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
            c = np.array([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
        away = ((x[:, None] - c) ** 2).sum(2)
        runs.append((round(away.min(1).sum(), 6), away.argmin(1)))
    near = min(runs, key=lambda r: r[0])[1]
    names = {k: n for n, k in enumerate(dict.fromkeys(near.tolist()))}
    return [names[k] for k in near]


@pytest.mark.parametrize("k,restarts,seed", [(3, 4, 1), (7, 2, 5)])
def test_equals_plain_runs(spark, monkeypatch, k, restarts, seed):
    rng = np.random.default_rng(seed)
    x, seen = rng.normal(size=(90, 4)), []
    real = C.first_centres
    monkeypatch.setattr(C, "first_centres", lambda *a: seen.append(real(*a)) or seen[-1])
    out = C.kmeans(frame(spark, x).repartition(3), k, restarts, seed).collect()
    got = {r.id: r.cluster for r in out}
    assert [got[str(i)] for i in range(90)] == plain(x, seen[0], C.ROUNDS)


def test_repeated_rows_leave_fewer_clusters(spark):
    out = C.kmeans(frame(spark, [[1, 1]] * 5 + [[2, 2]] * 3), 4, 3, 7).collect()
    assert {(r.vec[0], r.cluster) for r in out} == {(1.0, 0), (2.0, 1)}
    assert C.kmeans(frame(spark, [[1, 1]]).limit(0), 2, 1, 1).count() == 0


def test_far_apart_groups_are_found(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(20, 3)) * 0.01 + c for c in np.concatenate([np.eye(3), 5 * np.eye(3)])])
    out = C.kmeans(frame(spark, x), 6, 10, 42).collect()
    assert all(len({r.cluster for r in out if int(r.id) // 20 == g}) == 1 for g in range(6)) and len({r.cluster for r in out}) == 6


def test_too_many_centres(spark, monkeypatch):
    monkeypatch.setattr(C, "CENTRE_BYTES", 100)
    with pytest.raises(ValueError, match="restarts"):
        C.kmeans(frame(spark, [[1, 1], [2, 2]]), 2, 10, 1)
