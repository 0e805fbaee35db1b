import json
import math
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector

from pitchframe.functions import arrays as AR
from pitchframe.operators import evaluation as EV
from pitchframe.operators import layout as LA
from pitchframe.operators import neighbours as NB
from pitchframe.operators import vectors as V


def frame(spark, vectors, labels=None):
    rows = [(str(i), [float(x) for x in v], labels[i] if labels else None) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id string, vec array<double>, label string")


def brute(vectors, k, metric):
    """k nearest others by full comparison, ties to the shorter, then smaller id."""
    x = np.asarray(vectors, dtype=float)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.where(n > 0, x / np.where(n > 0, n, 1), 0)
    out = {}
    for i in range(len(x)):
        d = 1 - (u * u[i]).sum(1) if metric == "cosine" else np.sqrt(((x - x[i]) ** 2).sum(1))
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (round(d[j], 12) + 0.0, len(str(j)), str(j)))
        out[str(i)] = [str(j) for j in order[:k]]
    return out


def found(df, **options):
    out = {}
    for r in NB.knn_pairs(df, **options).orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append(r.neighbour)
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("options", [{}, {"chunk_rows": 30}])
def test_neighbours_equal_brute_force(spark, metric, options):
    """Clusters, exact copies, zero vectors and scaled copies."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 5)) * 4
    x = np.concatenate([centres[rng.integers(0, 6, 150)] + rng.normal(size=(150, 5)) * 0.1, np.zeros((4, 5))])
    x = np.concatenate([x, np.repeat(x[3:4], 40, axis=0), x[5:9] * 2.0]).round(3)
    df = frame(spark, x, [str(i % 3) for i in range(len(x))])
    assert found(df, k=4, metric=metric, **options) == brute(x, 4, metric)


def test_k_is_capped(spark):
    assert found(frame(spark, [[1, 0], [0, 1], [1, 1]]), k=10) == {"0": ["2", "1"], "1": ["2", "0"], "2": ["0", "1"]}


def test_purity(spark):
    df = frame(spark, [[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99]], ["A", "A", "B", "B"])
    assert NB.neighbour_purity(NB.knn_pairs(df, 1)).first()[0] == 1.0


def test_l2_and_width(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    a, b = [r[0] for r in df.select(AR.l2_normalise(AR.fit_width("v"))).collect()]
    assert a[:3] == [0.6, 0.8, 0.0] and len(a) == 256 and set(b) == {0.0}


def test_mean_vectors(spark):
    df = spark.createDataFrame([("7", [3.0, 4.0]), ("7", [0.0, 2.0]), ("ball", [1.0, 1.0]), (None, [1.0, 1.0])], "entity_id string, vec array<double>")
    out = V.player_mean_vectors(df).collect()
    assert [(r.id, r.n_vectors) for r in out] == [("7", 2)] and np.allclose(out[0].vec, [0.3, 0.9])


def test_attack_vectors(spark):
    df = spark.createDataFrame([(1, 1, 0, [3.0, 0.0]), (1, 1, 0, [0.0, 4.0])], "game_id long, attack_no long, window_id long, vec array<double>")
    assert np.allclose(V.attack_vectors(df).first().vec, [0.6, 0.8])


def test_pca_equals_svd(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 6)) @ np.diag([5, 4, 3, 2, 1, 0.5]) + 3
    projection = V.pca_project(frame(spark, x), 4)
    got = np.array([r.vec for r in V.player_order(projection.vectors).collect()])
    centred = x - x.mean(0)
    want = centred @ np.linalg.svd(centred, full_matrices=False)[2][:4].T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
    V.save_projection(projection, str(tmp_path / "p"))
    ids = spark.read.parquet(str(tmp_path / "p" / "ids"))
    assert ids.count() == 40
    assert len(V.pca_project(frame(spark, x[:3]), 256).vectors.first().vec) == 3


def exact_silhouette(x, y, metric):
    n = len(x)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    d = 1 - u @ u.T if metric == "cosine" else np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, 0)
    out = []
    for i in range(n):
        own = (y == y[i]).sum()
        if own == 1:
            out.append(0.0)
            continue
        a = d[i][y == y[i]].sum() / (own - 1)
        b = min(d[i][y == o].mean() for o in set(y) - {y[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("chunk", [2048, 16])
def test_silhouette(spark, metric, chunk):
    rng = np.random.default_rng(2)
    y = np.array(["a"] * 30 + ["b"] * 25 + ["c"] * 20 + ["d"])
    x = rng.normal(size=(76, 3)) + np.array([{"a": [2, 0, 0], "b": [0, 2, 0], "c": [0, 0, 2], "d": [1, 1, 1]}[v] for v in y])
    x[3] = 0
    got = EV.silhouette(frame(spark, x, list(y)), metric, chunk).first()[0]
    assert math.isclose(got, exact_silhouette(x, y, metric), rel_tol=1e-9)


def test_silhouette_agrees_with_the_library(spark):
    rng = np.random.default_rng(3)
    df = frame(spark, rng.normal(size=(60, 4)), [str(i % 3) for i in range(60)])
    data = df.select(array_to_vector("vec").alias("features"), df.label.cast("int").alias("prediction"))
    library = ClusteringEvaluator(distanceMeasure="cosine").evaluate(data)
    assert math.isclose(EV.silhouette(df).first()[0], library, rel_tol=1e-9)


def test_silhouette_needs_two_labels(spark):
    assert EV.silhouette(frame(spark, [[1, 0], [0, 1]], ["a", "a"])).first()[0] is None
    assert EV.silhouette(frame(spark, [[1, 0], [0, 1]], ["a", "b"])).first()[0] is None


def test_nmi(spark):
    def score(pairs):
        return EV.nmi(spark.createDataFrame(pairs, "label string, cluster int")).first()[0]

    assert math.isclose(score([("a", 0), ("a", 0), ("b", 1)]), 1.0)
    assert abs(score([("a", 0), ("a", 1), ("b", 0), ("b", 1)])) < 1e-12
    assert score([("a", 0), ("a", 0)]) == 1.0


def test_clusters_and_report(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(15, 3)) * 0.05 + c for c in ([1, 0, 0], [0, 1, 0], [0, 0, 1])])
    df = frame(spark, x, [str(i // 15) for i in range(45)])
    assert math.isclose(EV.nmi(EV.kmeans_labels(df)).first()[0], 1.0)
    report = EV.compare_spaces({"style": df.select("id", "vec"), "baseline_p": df.select("id", "vec")}, df.select("id", "label"), k=5)
    EV.write_metrics_json(report, str(tmp_path / "m"))
    text = "".join(p.read_text() for p in Path(tmp_path / "m").glob("part-*"))
    back = json.loads(text)
    assert set(back) == {"style", "baseline_p"} and back["style"]["neighbor_purity"] == 1.0 and back["style"]["silhouette"] > 0.9
    with pytest.raises(ValueError):
        EV.space_report(df.select("id", "vec"), df.selectExpr("concat('x', id) AS id", "label"), "s")


def test_layout(spark):
    rng = np.random.default_rng(6)
    out = LA.layout_2d(frame(spark, rng.normal(size=(120, 4)))).collect()
    assert len(out) == 120 and sum(r.show_label for r in out) == 60
    assert {r.id for r in out if r.show_label} == {str(i) for i in range(0, 120, 2)}


def test_labels_and_overlap(spark, rows):
    vecs = frame(spark, [[1, 0], [0, 1], [1, 1]]).select("id", "vec")
    labels = spark.createDataFrame([("1", "b"), ("2", "a"), ("9", "b")], "id string, label string")
    assert rows(EV.labelled_vectors(vecs, labels), "id", "label") == [("1", "b"), ("2", "a")]
    assert rows(EV.common_ids(vecs, labels)) == [("1",), ("2",)]
    assert rows(EV.unlabelled_ids(vecs, labels)) == [("0",)]
    assert rows(EV.distinct_labels(labels)) == [("a", 0), ("b", 1)]


def test_layout_refuses_wide_vectors(spark, monkeypatch):
    monkeypatch.setattr(V, "MAX_PCA_WIDTH", 2)
    with pytest.raises(ValueError, match="width 3"):
        LA.layout_2d(frame(spark, [[1, 0, 0], [0, 1, 0]]))


def test_layout_keeps_more_neighbours_than_components(spark):
    """A rolled-up sheet: the plane keeps over half of each point's neighbours, two components a third."""
    rng = np.random.default_rng(0)
    t, u = rng.uniform(0, 3 * np.pi, 400), rng.uniform(0, 6, 400)
    x = np.column_stack([t * np.cos(t), u, t * np.sin(t), *rng.normal(size=(5, 400)) * 0.1])

    def near(p):
        away = ((p[:, None] - p) ** 2).sum(2)
        np.fill_diagonal(away, np.inf)
        return [set(r[:10]) for r in away.argsort(1)]

    def kept(p):
        return np.mean([len(a & b) / 10 for a, b in zip(near(x), near(p))])

    out = {r.id: (r.x, r.y) for r in LA.layout_2d(frame(spark, x), metric="euclidean").collect()}
    flat = np.linalg.svd(x - x.mean(0), full_matrices=False)
    mine, parts = kept(np.array([out[str(i)] for i in range(400)])), kept((x - x.mean(0)) @ flat[2][:2].T)
    assert mine > 0.5 and mine > parts + 0.1


def test_layout_of_few_vectors(spark):
    assert LA.layout_2d(frame(spark, [[1, 0]]).limit(0)).count() == 0
    assert len(LA.layout_2d(frame(spark, [[1, 0], [0, 1], [0, 1]])).collect()) == 3


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("shape", ["even", "near", "mixed"])
def test_blocks_of_a_large_chunk(metric, shape):
    """Many blocks on both sides; vectors that short numbers cannot tell apart, and of very different lengths."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(11_500, 6))
    if shape == "near":
        x = 1000 + x * 1e-4
    if shape == "mixed":
        x *= 10.0 ** rng.integers(-6, 7, size=(len(x), 1))
    x[100] = x[9000]
    u = x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x
    v = list(np.concatenate([u, np.zeros((len(u), 1))], axis=1) if metric == "cosine" else u)
    b = pd.DataFrame({"id": [str(i) for i in range(len(x))], "v": v, "label": "a"})
    q = b.iloc[np.r_[0:700, 8995:9005]]
    got = NB.best_kernel(5, metric)(q, b)
    for i in [*range(0, 700, 35), 100, 9000]:
        d = 1 - (u * u[i]).sum(1) if metric == "cosine" else np.sqrt(((u - u[i]) ** 2).sum(1))
        order = sorted(range(len(x)), key=lambda j: (round(d[j], 12) + 0.0, len(str(j)), str(j)))
        assert list(got[got["id"] == str(i)]["neighbour"]) == [str(j) for j in order[:5]], i
