"""Nearest neighbours through an index of cells, for more vectors than can all meet each other."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.operators.neighbours import FOUND, QUERY_BLOCK, Nearest, base_forms, best_kernel, found_rows, in_order, neighbour_lists, rows_of
from pitchframe.plans.blocks import SIDE, TASK_ROWS, chunk_pairs
from pitchframe.plans.session import staged

# Vectors in a cell on average; a cell with more is cut into chunks, so none is too large for a task.
CELL_ROWS = 1024
# Centres are fitted on a bounded sample and broadcast, so both have a limit.
SAMPLE_ROWS, CENTRE_BYTES, ROUNDS = 65_536, 64 << 20, 5
# Points on which the number of visited cells is chosen if a recall is asked for.
TRIAL_POINTS = 256


class Cells:
    """Centres of the cells, how far each cell reaches, and its tile: cells are put together in few tiles.

    A point is copied to the tiles it has to visit, not to the cells, so the copies do not grow with the cells.
    """

    def __init__(self, centres: np.ndarray, reach: np.ndarray, rows: np.ndarray | None = None):
        self.centres, self.reach = centres, reach
        self.tile = np.zeros(len(centres), dtype=np.int64) if rows is None else self._tiles(rows)

    def _tiles(self, rows: np.ndarray) -> np.ndarray:
        """Runs of about equally many rows, of cells in the order of the coordinate in which the centres differ most."""
        many = max(min(SIDE, len(rows)), math.ceil(rows.sum() / TASK_ROWS))
        order = np.argsort(self.centres[:, np.argmax(self.centres.var(axis=0))], kind="stable")
        middle = np.cumsum(rows[order]) - rows[order] / 2
        tile = np.zeros(len(rows), dtype=np.int64)
        tile[order] = np.minimum(middle * many // max(rows.sum(), 1), many - 1)
        return tile

    def distances(self, points: np.ndarray) -> np.ndarray:
        square = (points * points).sum(1)[:, None] + (self.centres * self.centres).sum(1) - 2 * points @ self.centres.T
        return np.sqrt(np.maximum(square, 0))


def _stack(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()) if len(v) else np.zeros((0, 1))


def _fit(points: DataFrame, cell_rows: int) -> np.ndarray:
    """Centres by a few rounds of k-means over a bounded sample, the rows first in the order of their id's hash."""
    rows, width = points.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    many = max(1, min(math.ceil(rows / cell_rows), CENTRE_BYTES // (8 * max(width, 1)), SAMPLE_ROWS // 16))
    order = [F.xxhash64("id"), "id"]
    sample = _stack(points.orderBy(*order).limit(min(SAMPLE_ROWS, 64 * many)).select("v").toPandas()["v"])
    if not len(sample):
        return np.zeros((1, width))
    centres = sample[:many]
    for _ in range(ROUNDS):
        nearest = np.argmin(Cells(centres, np.zeros(0)).distances(sample), axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(nearest, minlength=len(centres))
        np.add.at(sums, nearest, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def build_cells(points: DataFrame, rows: DataFrame, cell_rows: int = CELL_ROWS) -> tuple[Cells, DataFrame]:
    """Cells fitted on a sample of `points`, and all `rows` (with `v`) with the number of their cell, written once."""
    fitted = Cells(_fit(points, cell_rows), np.zeros(0))
    shared = points.sparkSession.sparkContext.broadcast(fitted)

    @F.pandas_udf("cell int, away double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        away = shared.value.distances(_stack(v))
        cell = np.argmin(away, axis=1)
        return pd.DataFrame({"cell": cell, "away": away[np.arange(len(cell)), cell]})

    placed = staged(rows.withColumn("c", nearest("v")).select("*", "c.cell", "c.away").drop("c"))
    reach, counts = np.full(len(fitted.centres), -np.inf), np.zeros(len(fitted.centres), dtype=np.int64)
    for cell, away, n in placed.groupBy("cell").agg(F.max("away"), F.count(F.lit(1))).collect():
        reach[cell], counts[cell] = away, n
    return Cells(fitted.centres, reach, counts), placed


def _straight(distance: Column, metric: str) -> Column:
    """Straight-line distance, rounded up, for a distance of the metric."""
    line = F.sqrt(2 * distance) if metric == "cosine" else distance
    return line * (1 + 1e-9) + 1e-6


def _meets(cells: Cells, points: np.ndarray, own: np.ndarray, far: np.ndarray, most: int | None) -> np.ndarray:
    """For each point and cell other than its own: whether the cell may hold a neighbour nearer than `far`.

    No vector of a cell is nearer than the centre's distance less the cell's reach. With `most`, only the cells with
    the nearest centres are visited, the point's own among them.
    """
    away = cells.distances(points)
    meets = away - cells.reach <= far[:, None]
    if most is not None and most < away.shape[1]:
        near = np.argpartition(away, most - 1, axis=1)[:, :most]
        chosen = np.zeros_like(meets)
        np.put_along_axis(chosen, near, True, axis=1)
        meets &= chosen
    meets[np.arange(len(points)), own] = False
    return meets


def _visits(asked: DataFrame, cells: Cells, most: int | None) -> DataFrame:
    """A row for each point (id, v, cell, far, last) and tile in which it has a cell to visit."""
    shared = asked.sparkSession.sparkContext.broadcast(cells)
    last = F.col("last") if "last" in asked.columns else F.lit(None).cast("double")

    def visit(batches):
        c = shared.value
        member = (c.tile[:, None] == np.arange(c.tile.max() + 1)).astype("float32")
        for pdf in batches:
            # Few points at a time, so that a table of points and cells stays small.
            for at in range(0, len(pdf), QUERY_BLOCK):
                part = pdf.iloc[at : at + QUERY_BLOCK]
                meets = _meets(c, _stack(part["v"]), part["cell"].to_numpy(), part["far"].to_numpy(), most)
                row, tile = np.nonzero(meets.astype("float32") @ member)
                yield part.iloc[row].assign(tile=tile)

    schema = "id string, v array<double>, cell int, far double, last double, tile long"
    return asked.select("id", "v", "cell", "far", last.alias("last")).mapInPandas(visit, schema)


def _tile_kernel(cells, keep: int, metric: str, most: int | None):
    """The nearest rows of a tile for each point, found cell by cell; `last` of a point bounds how far they are."""

    def best(q, b):
        c, b = cells.value, in_order(b)
        # Cells of the tile one after another, rows in the order of ties inside.
        number = np.argsort(b["cell"].to_numpy(), kind="stable")
        homes = b["cell"].to_numpy()[number]
        starts = np.flatnonzero(np.diff(homes, prepend=-1))
        stops, held = np.append(starts[1:], len(homes)), homes[starts]
        q = q.sort_values(["cell", "id"])
        x, y = rows_of(q["v"], metric), rows_of(b["v"].iloc[number], metric)
        forms, parts = base_forms(x, y, metric), []
        for at in range(0, len(q), QUERY_BLOCK):
            part = q.iloc[at : at + QUERY_BLOCK]
            bound = part["last"].fillna(np.inf).to_numpy()
            meets = _meets(c, _stack(part["v"]), part["cell"].to_numpy(), part["far"].to_numpy(), most)[:, held]
            nearest = Nearest(x[at : at + QUERY_BLOCK], keep, metric, bound)
            # Cells that most points visit come first: they bring the bounds down.
            for k in np.argsort(-meets.sum(0), kind="stable"):
                mine = np.flatnonzero(meets[:, k])
                if len(mine):
                    nearest.meet(y, forms, slice(starts[k], stops[k]), number, None if len(mine) == len(part) else mine)
            row, col, near = nearest.found()
            parts.append((row + at, col, near))
        return found_rows(q, b, parts)

    return best


def _search(placed: DataFrame, lenders: DataFrame, cells: Cells, k: int, metric: str, cell_rows: int, most: int | None) -> DataFrame:
    """First each point's own cell, which bounds how far its neighbours can be; then the cells within that bound."""
    kernel = best_kernel(k + 1, metric)
    own = staged(chunk_pairs(placed.select("id", "v", "cell"), lenders, ["cell"], "id", kernel, FOUND, 2 * cell_rows))
    order = Window.partitionBy("id").orderBy("distance", F.length("neighbour"), "neighbour")
    last = own.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k + 1).select("id", F.col("distance").alias("last"))
    # A cell with too few members bounds nothing.
    far = F.coalesce(_straight(F.col("last"), metric), F.lit(float("inf")))
    asked = placed.join(last, "id", "left").select("id", "v", "cell", far.alias("far"), "last")
    spark = lenders.sparkSession
    shared = spark.sparkContext.broadcast(cells)
    tiles = spark.createDataFrame([(i, int(t)) for i, t in enumerate(cells.tile)], "cell int, tile long")
    others = chunk_pairs(
        _visits(asked, cells, most), lenders.join(tiles, "cell"), ["tile"], "id", _tile_kernel(shared, k + 1, metric, most), FOUND, cell_rows, side=1
    )
    return own.unionByName(others)


def _cells_to_visit(points: DataFrame, placed: DataFrame, lenders: DataFrame, cells: Cells, k: int, metric: str, cell_rows: int, recall: float) -> int:
    """Fewest cells that hold the asked share of the true neighbours of a bounded number of trial points."""
    some = placed.orderBy(F.xxhash64("id"), "id").limit(TRIAL_POINTS)
    some = staged(some)
    found = _search(some, lenders, cells, k, metric, cell_rows, None)
    order = Window.partitionBy("id").orderBy("distance", F.length("neighbour"), "neighbour")
    found = found.filter("id <> neighbour").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    homes = lenders.select(F.col("id").alias("neighbour"), F.col("cell").alias("home"))
    pairs = found.select("id", "neighbour").join(some.select("id", "v"), "id").join(homes, "neighbour").select("v", "home").toPandas()
    if not len(pairs):
        return 1
    away = cells.distances(_stack(pairs["v"]))
    place = (away < away[np.arange(len(pairs)), pairs["home"].to_numpy()][:, None]).sum(1) + 1
    return int(np.sort(place)[min(len(place) - 1, math.ceil(recall * len(place)) - 1)])


def knn_index(df: DataFrame, k: int = 10, metric: str = "cosine", recall: float | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The k nearest others of each vector, in the shape and with the ties of `knn_pairs`.

    Vectors lie in cells around fitted centres. A point is compared with its own cell first; the k-th distance found
    there bounds how far its neighbours can be, and only cells that reach into that distance are visited. So the result
    is exact, and the work depends on how well the vectors gather. With `recall` (a share below 1) a point visits only
    the cells with the nearest centres, as many as hold that share of the true neighbours of some trial points.

    Centres and trial points come from bounded samples; every vector is indexed. Cells of any size are cut into chunks.
    """
    if recall is not None and not 0 < recall <= 1:
        raise ValueError("recall must be above 0 and at most 1")

    def search(points: DataFrame, lenders: DataFrame) -> DataFrame:
        cells, homes = build_cells(points, lenders, cell_rows)
        homes = homes.drop("away")
        placed = points.select("id").join(homes.select("id", "v", "cell"), "id")
        most = None if recall is None else _cells_to_visit(points, placed, homes, cells, k, metric, cell_rows, recall)
        return _search(placed, homes, cells, k, metric, cell_rows, most)

    return neighbour_lists(df, k, metric, search)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """pairs (of the exact lists) and recall: the share of them that was found."""
    told = exact.select("id", "neighbour").join(found.select("id", "neighbour", F.lit(1).alias("hit")), ["id", "neighbour"], "left")
    return told.agg(F.count(F.lit(1)).alias("pairs"), (F.count("hit") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("recall"))
