import math

import numpy as np
import pytest

from pitchframe.operators import patches as P
from pitchframe.operators import splits as SP
from pitchframe.operators import trajectories as TR
from pitchframe.operators import windows as W

SLAB = "game_id long, attack_no long, entity_idx long, is_ball boolean, frame_idx long, frame_count long, x double, y double, ball_x double, ball_y double"


def slab(spark, frames, entities=1, value=lambda e, f: (float(f), 1.0)):
    rows = [(1, 1, e, e == 0, f, frames, *value(e, f), *value(0, f)) for e in range(entities) for f in range(frames)]
    return spark.createDataFrame(rows, SLAB)


@pytest.mark.parametrize(
    "n, kept",
    [(4, [0, 1, 2, 3]), (5, [0]), (1000, list(range(250, 1000, 5)))],
)
def test_thin_and_cut(spark, n, kept):
    out = P.keep_last_frames(P.thin_frames(slab(spark, n), 5), 150).orderBy("frame_idx").collect()
    assert [int(r.x) for r in out] == kept
    assert [r.frame_idx for r in out] == list(range(len(kept)))
    assert {r.frame_count for r in out} == {len(kept)}


def test_scale(spark, rows):
    values = {0: (10.0, 2.0), 1: (-20.0, 0.0), 2: (0.0, 0.0)}
    df = slab(spark, 3, value=lambda e, f: values[f])
    out = P.normalise_coords(df).orderBy("frame_idx").collect()
    assert [round(r.x, 6) for r in out] == [0.454545, -0.909091, 0.0]
    assert round(out[0].y, 6) == round(1 / 1.1, 6)
    flat = slab(spark, 3, value=lambda e, f: (values[f][0], 0.0))
    assert [r.x for r in P.normalise_coords(flat).orderBy("frame_idx").collect()] == [10.0, -20.0, 0.0]
    assert rows(P.patch_scale(flat), "x_scale", "y_scale") == [(None, None)]


@pytest.mark.parametrize(
    "n, expected",
    [
        (0, []),
        (150, [(0, 150)]),
        (151, [(0, 150), (75, 151)]),
        (226, [(0, 150), (75, 225), (150, 226)]),
        (300, [(0, 150), (75, 225), (150, 300)]),
    ],
)
def test_windows(spark, rows, n, expected):
    df = spark.createDataFrame([(1, 1, n)], "game_id long, attack_no long, frame_count long")
    assert rows(W.sliding_windows(df), "start_frame", "end_frame") == expected


@pytest.mark.parametrize("n", [1, 7, 8, 9, 16, 17, 24, 25, 40, 41])
@pytest.mark.parametrize("stride", [3, 8, 20])
def test_windows_cover_what_they_hold(spark, n, stride):
    """in_windows places each frame in exactly the windows sliding_windows lists."""
    df = slab(spark, n)
    counts = spark.createDataFrame([(1, 1, n)], "game_id long, attack_no long, frame_count long")
    spans = [(r.window_id, r.start_frame, r.end_frame) for r in W.sliding_windows(counts, 16, stride).collect()]
    want = sorted((w, f, f - s) for w, s, e in spans for f in range(s, e))
    got = sorted((r.window_id, r.frame_idx, r.window_pos) for r in W.in_windows(df, 16, stride).collect())
    assert got == want


def test_features(spark):
    """A player moving 3-4-5 beside a ball at rest; a second player never seen."""
    df = slab(spark, 4, 2, lambda e, f: (3.0 * f, 4.0 * f) if e else (0.0, 0.0))
    ents = spark.createDataFrame(
        [(1, 1, 0, True, "ball"), (1, 1, 1, False, "7"), (1, 1, 2, False, "8")],
        "game_id long, attack_no long, entity_idx long, is_ball boolean, entity_id string",
    )
    lengths = spark.createDataFrame([(1, 1, 4)], "game_id long, attack_no long, frame_count long")
    got = {r.entity_id: dict(zip(W.FEATURES, r.vec)) for r in W.window_features(df, ents, lengths, 8, 4).collect()}
    assert set(got) == {"ball", "7", "8"} and set(got["8"].values()) == {0.0}
    f = got["7"]
    assert f["observed_share"] == 0.5 and f["avg_x"] == 4.5 and f["max_y"] == 12.0
    assert f["avg_step"] == f["max_step"] == 5.0 and f["std_step"] == 0.0 and f["path_length"] == 15.0
    assert f["net_displacement"] == 15.0 and f["avg_ball_distance"] == 7.5
    assert math.isclose(f["std_x"], np.std([0, 3, 6, 9]))
    assert W.window_features(df, ents, lengths, 8, 4, min_observed=1).count() == 2


def test_pad_window_and_patch(spark):
    df = slab(spark, 3, value=lambda e, f: (None if f == 1 else float(f + 1), 1.0))
    assert W.pad_window(df, 5, 5).first().xs == [1.0, 0.0, 3.0, 0.0, 0.0]
    patch = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0])], "xs array<double>, ys array<double>")
    assert tuple(P.pad_crop_patch(patch, 2).first()) == ([1.0, 2.0], [1.0, 0.0])


def test_deltas(spark):
    patch = spark.createDataFrame(
        [([float(i * i) for i in range(10)], [0.0] * 10), ([1.0] * 9, [1.0] * 9), ([5.0] * 8 + [0.0, 0.0], [0.0] * 10)],
        "xs array<double>, ys array<double>",
    )
    full, short, gone = TR.frame_deltas(patch).collect()
    assert full.deltas[0::2] == [float(2 * i + 1) for i in range(9)] and set(full.deltas[1::2]) == {0.0} and full.valid
    assert short.deltas == [0.0] * 18 and short.valid
    assert not gone.valid


def test_masked_mse(spark):
    df = spark.createDataFrame(
        [([0.0, 0.0], [1.0, 1.0], True), ([0.0, 0.0], [1.0, 1.0], False)],
        "pred array<double>, target array<double>, valid boolean",
    )
    assert TR.masked_mse(df, "pred", "target").first()[0] == 1.0
    assert TR.masked_mse(df.filter("not valid"), "pred", "target").first()[0] == 0.0


def test_info_nce(spark):
    def loss(vectors):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "k long, vec array<double>")
        return TR.info_nce(df, "k").first()[0]

    assert math.isclose(loss([[1.0, 0.0], [1.0, 0.0]]), math.log(2))
    assert math.isclose(loss([[1.0, 0.0], [0.0, 1.0]]), math.log1p(math.exp(-1 / 0.07)), rel_tol=1e-6)


def test_batches_are_cut_by_place(spark):
    """Sparse keys: batches still hold `size` rows each."""
    df = spark.createDataFrame([(i * 10**6, [1.0]) for i in range(130)], "k long, vec array<double>")
    sizes = TR.batch_similarity(df, "k", 64).selectExpr("batch_id", "size(sims) AS n").distinct().collect()
    assert sorted((r.batch_id, r.n) for r in sizes) == [(0, 64), (1, 64), (2, 2)]


def test_head_recovers_a_linear_map(spark):
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(200, 4)), rng.normal(size=(5, 18))
    y = x @ w[:-1] + w[-1]
    rows = [(a.tolist(), b.tolist(), True) for a, b in zip(x, y)] + [([9.0] * 4, [99.0] * 18, False)]
    df = spark.createDataFrame(rows, "vec array<double>, deltas array<double>, valid boolean").repartition(5)
    head = TR.fit_delta_head(df)
    assert np.allclose(head, w)
    assert TR.masked_mse(TR.predict_deltas(df, head), "pred", "deltas").first()[0] < 1e-18


def test_no_head_without_a_valid_row(spark):
    """Nothing was fitted, so the error is unknown: it is not that of a perfect fit."""
    rows = [([1.0, float(i)], [1.0] * 18, False) for i in range(3)]
    df = spark.createDataFrame(rows, "vec array<double>, deltas array<double>, valid boolean")
    for part in (df, df.limit(0)):
        head = TR.fit_delta_head(part)
        assert head is None
        assert TR.masked_mse(TR.predict_deltas(part, head), "pred", "deltas").collect() == [(None,)]


def test_split_sizes(spark, rows):
    df = spark.range(10).withColumnRenamed("id", "k")
    split = SP.train_val_test_split(df, ["k"])
    assert rows(SP.split_sizes(split), "split", "n_rows") == [("test", 1), ("train", 7), ("val", 2)]
    assert rows(split) == rows(SP.train_val_test_split(df.repartition(3), ["k"]))
    with pytest.raises(ValueError):
        SP.train_val_test_split(df, ["k"], 0.7, 0.7, 0.1)
