"""The index of cells against the exact comparison of all vectors."""

import random

import pytest

from pitchframe.operators import neighbours as NB
from pitchframe.operators import vector_index as VI

KEY = ["id", "rank", "neighbour", "neighbour_label", "distance"]


def lists(df):
    return sorted(tuple(r[c] for c in KEY) for r in df.collect())


def gathered(n, groups, width, seed, spread):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(groups)]
    return [(str(i), str(i % 3), [x + rnd.gauss(0, spread) for x in centres[i % groups]]) for i in range(n)]


@pytest.mark.parametrize("metric", NB.METRICS)
@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_exact_index_equals_all_pairs(spark, metric, spread):
    rows = gathered(260, 6, 5, 1, spread)
    # A third of all vectors equal, zero vectors, and one far away on its own.
    rows += [(f"t{i}", "x", [1.0] * 5) for i in range(130)] + [(f"z{i}", None, [0.0] * 5) for i in range(4)] + [("far", "y", [99.0] * 5)]
    df = spark.createDataFrame(rows, "id string, label string, vec array<double>")
    assert lists(VI.knn_index(df, 7, metric, cell_rows=16)) == lists(NB.knn_pairs(df, 7, metric))


def test_fewer_vectors_than_neighbours_and_none(spark):
    df = spark.createDataFrame(gathered(4, 2, 3, 2, 1.0), "id string, label string, vec array<double>")
    assert lists(VI.knn_index(df, 7, cell_rows=2)) == lists(NB.knn_pairs(df, 7))
    assert VI.knn_index(df.limit(0), 7).count() == 0
    with pytest.raises(ValueError):
        VI.knn_index(df, 7, recall=0.0)


def test_far_cells_are_not_visited(spark):
    """With well gathered vectors a point visits its own cell and few others, so work grows with the rows."""
    df = spark.createDataFrame(gathered(1200, 40, 8, 3, 0.01), "id string, label string, vec array<double>")
    points = df.selectExpr("id", "vec AS v")
    cells, placed = VI.build_cells(points, points, 30)
    visits = VI._visits(placed.selectExpr("id", "v", "cell", "0.5D AS far"), cells, None)
    assert visits.count() < 3 * 1200 and len(cells.centres) == 40


def test_recall_is_reached(spark):
    df = spark.createDataFrame(gathered(1500, 30, 12, 4, 0.5), "id string, label string, vec array<double>")
    exact = NB.knn_pairs(df, 10)
    told = VI.recall_of(VI.knn_index(df, 10, recall=0.95, cell_rows=50), exact).first()
    assert told.pairs == 15_000 and told.recall >= 0.9


def test_copies_of_a_point_do_not_grow_with_the_cells(spark):
    """Evenly spread vectors visit nearly all cells, but those lie in few tiles."""
    df = spark.createDataFrame(gathered(1200, 1200, 16, 5, 1.0), "id string, label string, vec array<double>")
    points = df.selectExpr("id", "vec AS v")
    cells, placed = VI.build_cells(points, points, 10)
    visits = VI._visits(placed.selectExpr("id", "v", "cell", "1e9D AS far"), cells, None)
    assert len(cells.centres) == 120 and set(cells.tile) == set(range(8))
    assert visits.count() == 8 * 1200
    assert lists(VI.knn_index(df, 3, "euclidean", cell_rows=10)) == lists(NB.knn_pairs(df, 3, "euclidean"))
