"""Fixed kernels over paths against plain loops."""

import numpy as np
import pytest

from pitchframe.operators import encoder as EN


@pytest.mark.parametrize("win,count", [(1, 3), (2, 4), (3, 5), (16, 9), (150, 24)])
def test_equals_plain_loops(win, count):
    paths = np.random.default_rng(win).normal(size=(7, 2, win))
    got = EN.convolve(paths, count)
    assert got.shape == (7, 2 * count)
    for d, numbers, weights, biases in EN.kernels(count, win):
        for k, w, b in zip(numbers, weights, biases):
            for n, p in enumerate(paths):
                answers = [sum(w[c, j] * p[c, i + j * d] for c in range(2) for j in range(3)) + b for i in range(win - 2 * d)]
                want = (max(answers), sum(a > 0 for a in answers) / len(answers)) if answers else (0, 0)
                assert np.allclose((got[n, k], got[n, count + k]), want)


def test_kernels_see_movement_not_place():
    path = np.random.default_rng(1).normal(size=(1, 2, 40))
    assert np.allclose(EN.convolve(path, 30), EN.convolve(path + 5.0, 30))
    assert not np.allclose(EN.convolve(path, 30), EN.convolve(path * 3, 30))
    assert sorted(k for _, g, _, _ in EN.kernels(30, 40) for k in g) == list(range(30))


def test_unseen_entities_are_zero(spark):
    schema = "game_id bigint, attack_no bigint, entity_idx int, frame_idx bigint, frame_count bigint, x double, y double"
    slab = spark.createDataFrame([(1, 1, 0, i, 5, float(i), 0.5) for i in range(5)] + [(1, 1, 1, 0, 5, None, 1.0)], schema)
    entities = spark.createDataFrame([(1, 1, 0, False, "7"), (1, 1, 1, False, "8")], "game_id bigint, attack_no bigint, entity_idx int, is_ball boolean, entity_id string")
    lengths = spark.createDataFrame([(1, 1, 5)], "game_id bigint, attack_no bigint, frame_count bigint")
    got = {r.entity_id: r for r in EN.conv_features(slab, entities, lengths, 8, 4, count=6).collect()}
    path = np.array([[[0, 1, 2, 3, 4, 0, 0, 0], [0.5] * 5 + [0] * 3]], dtype=float)
    assert got["7"].n_observed == 5 and np.allclose(got["7"].vec, EN.convolve(path, 6)[0])
    assert got["8"].n_observed == 0 and got["8"].vec == [0.0] * 12
    assert EN.conv_features(slab, entities, lengths, 8, 4, 1, 6).count() == 1
