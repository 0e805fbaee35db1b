"""Exact nearest neighbours, and distance sums, without pairing every vector with every other in the result."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.functions.arrays import l2_normalise, norm
from pitchframe.plans.blocks import CHUNK_ROWS, chunk_pairs
from pitchframe.plans.session import staged

METRICS = ("cosine", "euclidean")
FOUND = "id string, distance double, neighbour string, neighbour_label string"
# Rows compared at once.
QUERY_BLOCK, FIRST_BLOCK, BASE_BLOCK = 512, 1024, 8192
# Distances are equal if they are so to 12 decimals; what products of short numbers may lose near zero.
ROUNDING, TINY = 1e-12, 1e-30


def _space(vec: Column, metric: str) -> Column:
    """Vectors in which straight-line distance gives the order of the metric.

    For cosine these are unit vectors with one more coordinate, set only for zero vectors: they then lie at equal
    distance from all others, as the metric has it.
    """
    if metric == "euclidean":
        return vec
    zero = norm(vec) == 0
    return F.concat(l2_normalise(vec), F.array(F.when(zero, 1.0).otherwise(0.0)))


class Base:
    """Base rows as numbers of one precision, so that one product with a query's gives the order of the distances.

    For cosine the product is that of unit vectors; for straight lines it is xy - yy/2, all numbers divided by the
    largest length first. `slack` is how far rounding may move it, as a share of the squared lengths.
    """

    def __init__(self, y: np.ndarray, metric: str, scale: float, kind: type):
        self.metric, self.scale, self.kind = metric, scale, kind
        self.slack = (y.shape[1] + 8) * float(np.finfo(kind).eps)
        if metric == "cosine":
            self.rows, self.longest = y.astype(kind), 1.0
        else:
            size = ((y / scale) ** 2).sum(1)
            self.rows = np.concatenate([y / scale, (self.slack - 0.5) * size[:, None]], axis=1).astype(kind)
            self.longest = np.nanmax(size, initial=0.0)

    def queries(self, x: np.ndarray) -> np.ndarray:
        return (x if self.metric == "cosine" else np.concatenate([x / self.scale, np.ones((len(x), 1))], axis=1)).astype(self.kind)

    def least(self, x: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The product below which a row is farther than `far`, whatever the rounding."""
        if self.metric == "cosine":
            return (1.0 - far - ROUNDING - 2 * self.slack).astype(self.kind)
        size, reach = ((x / self.scale) ** 2).sum(1), ((far + ROUNDING) / self.scale) ** 2
        return ((size - reach) / 2 - self.slack * (size + reach) - TINY).astype(self.kind)

    def widened(self, x: np.ndarray, product: np.ndarray) -> np.ndarray:
        """What all rows reach that may come before the row with this product."""
        if self.metric == "cosine":
            return product - self.kind(4 * self.slack + 2 * ROUNDING)
        size, step = ((x / self.scale) ** 2).sum(1), ROUNDING / self.scale
        return (product - 4 * self.slack * (size + self.longest) - 4 * step - step * step - TINY).astype(self.kind)


class Nearest:
    """The `keep` nearest rows of some query rows among the base rows they have met so far; ties go to the lower number."""

    def __init__(self, x: np.ndarray, keep: int, metric: str, bound: np.ndarray | None = None):
        self.x, self.keep, self.metric = x, keep, metric
        self.near, self.col = np.full((len(x), keep), np.inf), np.full((len(x), keep), -1)
        # Rows beyond a bound known from elsewhere are of no use.
        self.bound = np.full(len(x), np.inf) if bound is None else bound
        self.ready: dict[type, np.ndarray] = {}

    def far(self) -> np.ndarray:
        last = np.where(np.isnan(self.near[:, -1]), np.inf, self.near[:, -1])
        return np.minimum(last, self.bound)

    def _candidates(self, base: Base, part: slice, mine: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(query, place in the part) of all that may be among the nearest by the fast product."""
        if base.kind not in self.ready:
            self.ready[base.kind] = base.queries(self.x)
        x, q, far = self.x, self.ready[base.kind], self.far()
        if mine is not None:
            x, q, far = x[mine], q[mine], far[mine]
        product = q @ base.rows[part].T
        least = base.least(x, far)
        new = np.flatnonzero(np.isinf(far))
        if len(new):
            many = product.shape[1]
            least[new] = -np.inf
            if many > self.keep:
                edge = -np.partition(-product[new], self.keep - 1, axis=1)[:, self.keep - 1]
                least[new] = base.widened(x[new], edge)
            else:
                # Too few to choose from: all of them, also those without a distance.
                product[new] = np.inf
        row, col = np.divmod(np.flatnonzero(product >= least[:, None]), product.shape[1])
        return row if mine is None else mine[row], col

    def meet(self, y: np.ndarray, forms: Callable[[type], Base], part: slice, number: np.ndarray, mine: np.ndarray | None = None) -> None:
        """Compare the query rows (`mine` of them) with a part of the base rows, whose numbers are `number`."""
        row, place = self._candidates(forms(np.float32), part, mine)
        if len(row) > 8 * self.keep * (len(self.x) if mine is None else len(mine)):
            # Rows closer to each other than short numbers can tell.
            row, place = self._candidates(forms(np.float64), part, mine)
        if not len(row):
            return
        near = np.empty(len(row))
        for at in range(0, len(row), 4096):
            a, b = self.x[row[at : at + 4096]], y[part.start + place[at : at + 4096]]
            step = 1.0 - (a * b).sum(1) if self.metric == "cosine" else np.sqrt(((a - b) ** 2).sum(1))
            near[at : at + 4096] = np.round(step, 12) + 0.0
        touched, row = np.unique(row, return_inverse=True)
        held, old = np.nonzero(self.col[touched] >= 0)
        row = np.concatenate([held, row])
        near = np.concatenate([self.near[touched][held, old], near])
        col = np.concatenate([self.col[touched][held, old], number[part][place]])
        order = np.lexsort((col, near, row))
        row, near, col = row[order], near[order], col[order]
        at = np.arange(len(row)) - np.searchsorted(row, row)
        first = at < self.keep
        self.near[touched[row[first]], at[first]], self.col[touched[row[first]], at[first]] = near[first], col[first]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, number of the base row and distance, in order."""
        row, at = np.nonzero(self.col >= 0)
        return row, self.col[row, at], self.near[row, at]


def base_forms(x: np.ndarray, y: np.ndarray, metric: str) -> Callable[[type], Base]:
    """The base rows in short and in long numbers, each made when first asked for."""
    made: dict[type, Base] = {}
    lengths = np.concatenate([(x * x).sum(1), (y * y).sum(1)])
    scale = float(np.sqrt(np.max(lengths[np.isfinite(lengths)], initial=0.0))) or 1.0

    def form(kind: type) -> Base:
        if kind not in made:
            made[kind] = Base(y, metric, scale, kind)
        return made[kind]

    return form


def rows_of(v: pd.Series, metric: str) -> np.ndarray:
    rows = np.stack(v.to_numpy())
    return rows[:, :-1] if metric == "cosine" else rows


def in_order(b: pd.DataFrame) -> pd.DataFrame:
    """Base rows in the order in which ties are settled."""
    return b.assign(n=b["id"].str.len()).sort_values(["n", "id"])


def found_rows(q: pd.DataFrame, b: pd.DataFrame, parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    row, col, near = (np.concatenate(x) for x in zip(*parts))
    return pd.DataFrame(
        {
            "id": q["id"].to_numpy()[row],
            "distance": near,
            "neighbour": b["id"].to_numpy()[col],
            "neighbour_label": b["label"].to_numpy()[col],
        }
    )


def best_kernel(keep: int, metric: str):
    """The `keep` nearest base rows of each query row of a chunk pair; ties go to the shorter, then smaller id."""

    def best(q, b):
        b = in_order(b)
        x, y = rows_of(q["v"], metric), rows_of(b["v"], metric)
        forms, number, parts = base_forms(x, y, metric), np.arange(len(y)), []
        for at in range(0, len(x), QUERY_BLOCK):
            nearest = Nearest(x[at : at + QUERY_BLOCK], keep, metric)
            start, many = 0, FIRST_BLOCK
            while start < len(y):
                nearest.meet(y, forms, slice(start, start + many), number)
                # A small block first brings the bounds down, larger ones then have few candidates.
                start, many = start + many, min(2 * many, BASE_BLOCK)
            row, col, near = nearest.found()
            parts.append((row + at, col, near))
        return found_rows(q, b, parts)

    return best


def knn_pairs(
    df: DataFrame,
    k: int = 10,
    metric: str = "cosine",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The k nearest others of each vector: (id, label, rank, neighbour, neighbour_label, distance).

    `df` has a unique text `id`, `vec` and, if there is one, `label`. Exact; distances equal to 12 decimals tie and go
    to the id first in (length, text) order. Equal vectors are searched once and lend k+1 of their ids at most. Distinct
    vectors meet chunk against chunk, a chunk pair giving back k+1 rows for each vector only; the work is N x N
    products of whole vectors, one plan at any size, but a vector is copied to a fixed number of chunks. For many
    vectors see `vector_index.knn_index`.
    """

    def search(points: DataFrame, lenders: DataFrame) -> DataFrame:
        return chunk_pairs(points, lenders, [], "id", best_kernel(k + 1, metric), FOUND, chunk_rows)

    return neighbour_lists(df, k, metric, search)


def neighbour_lists(df: DataFrame, k: int, metric: str, search: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The k nearest others of each vector by any `search`.

    `search(points, lenders)` gets the distinct vectors (id, v) and the rows that may be neighbours (id, label, v), and
    gives rows (id, distance, neighbour, neighbour_label) that hold the k+1 nearest of each point.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    label = F.col("label").cast("string") if "label" in df.columns else F.lit(None).cast("string")
    members = df.select("id", label.alias("label"), _space(F.col("vec"), metric).alias("v"))
    twins = Window.partitionBy("v").orderBy(F.length("id"), "id")
    # Written once: it is counted twice and read on both sides.
    lenders = staged(members.withColumn("t", F.row_number().over(twins)).filter(F.col("t") <= k + 1))
    points = lenders.filter("t = 1").select("id", "v")
    best = search(points, lenders.select("id", "label", "v"))
    order = Window.partitionBy("id").orderBy("distance", F.length("neighbour"), "neighbour")
    best = best.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    found = F.struct("r", "distance", "neighbour", "neighbour_label")
    lists = best.groupBy("id").agg(F.array_sort(F.collect_list(found)).alias("found"))
    lists = lists.join(points.select("id", "v"), "id").drop("id")
    others = F.slice(F.filter("found", lambda f: f["neighbour"] != F.col("id")), 1, k)
    return (
        members.join(lists, "v")
        .select("id", "label", F.posexplode(others).alias("p", "f"))
        .select(
            "id",
            "label",
            (F.col("p") + 1).cast("bigint").alias("rank"),
            "f.neighbour",
            "f.neighbour_label",
            "f.distance",
        )
    )


def neighbour_purity(pairs: DataFrame) -> DataFrame:
    """Share of neighbours with the label of the vector they belong to."""
    same = F.count_if(F.col("label") == F.col("neighbour_label"))
    total = F.greatest(F.count(F.lit(1)), F.lit(1))
    return pairs.agg((same / total).alias("neighbor_purity"))


def label_distances(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Sum of straight-line distances of each vector to all members of each label: (id, label, other, total, n).

    A chunk pair gives back one partial sum for each vector and label.
    """

    def sums(q, b):
        x, y = np.stack(q["vec"].to_numpy()), np.stack(b["vec"].to_numpy())
        codes, names = pd.factorize(b["label"])
        many, size = len(names), (y * y).sum(1)
        total, n = np.zeros((len(x), many)), np.bincount(codes[codes >= 0], minlength=many)
        # One product gives xx + yy - 2xy.
        wide = np.concatenate([-2 * y, np.ones((len(y), 1)), size[:, None]], axis=1)
        for at in range(0, len(x), QUERY_BLOCK):
            part = x[at : at + QUERY_BLOCK]
            mine = (part * part).sum(1)
            asked = np.concatenate([part, mine[:, None], np.ones((len(part), 1))], axis=1)
            for start in range(0, len(y), CHUNK_ROWS):
                near = slice(start, start + CHUNK_ROWS)
                square = asked @ wide[near].T
                # The fast product loses small distances; those are taken from the coordinates.
                small = np.flatnonzero(square <= (1e-6 * (mine + np.nanmax(size[near], initial=0.0)))[:, None])
                np.maximum(square, 0, out=square)
                dist = np.sqrt(square, out=square)
                row, col = np.divmod(small, dist.shape[1])
                for k in range(0, len(row), 4096):
                    i, j = row[k : k + 4096], col[k : k + 4096]
                    dist[i, j] = np.sqrt(((part[i] - y[near][j]) ** 2).sum(1))
                total[at : at + QUERY_BLOCK] += dist @ (codes[near, None] == np.arange(many)).astype("float64")
        return pd.DataFrame(
            {
                "id": np.repeat(q["id"].to_numpy(), many),
                "label": np.repeat(q["label"].to_numpy(), many),
                "other": np.tile(np.asarray(names), len(q)),
                "total": total.ravel(),
                "n": np.tile(n.astype("int64"), len(q)),
            }
        )

    rows = df.select("id", F.col("label").cast("string").alias("label"), "vec")
    schema = "id string, label string, other string, total double, n long"
    partial = chunk_pairs(rows, rows, [], "id", sums, schema, chunk_rows)
    return partial.groupBy("id", "label", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
