"""A plane in which vectors lie near their nearest neighbours."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.operators.vector_index import knn_index
from pitchframe.operators.vectors import fit_components
from pitchframe.plans.ranking import position_by_sort
from pitchframe.plans.session import staged

MAP_LABELS = 50
NEIGHBOURS, ROUNDS = 10, 12
# Rows that push a point away in a round, largest move in a round, half width of the first plane.
SAMPLES, MOVE, HALF_WIDTH = 5, 4.0, 10.0
# A row's sample is its number times an odd factor of the draw, modulo a prime, modulo the number of rows.
FACTOR, PRIME = 48_271, 2_147_483_647


def neighbour_edges(pairs: DataFrame, numbers: DataFrame) -> DataFrame:
    """(i, j, w) by row numbers, in both directions, from lists of nearest neighbours.

    The nearest neighbour of a row weighs 1, others fall off with the distance beyond it; two rows that both name each
    other weigh a + b - ab.
    """
    lists = Window.partitionBy("id")
    near = F.min("distance").over(lists)
    reach = F.greatest(F.avg("distance").over(lists) - near, F.lit(1e-9))
    named = pairs.select("id", "neighbour", F.exp(-(F.col("distance") - near) / reach).alias("w"))
    named = named.join(numbers.select("id", F.col("n").alias("i")), "id")
    named = named.join(numbers.select(F.col("id").alias("neighbour"), F.col("n").alias("j")), "neighbour").select("i", "j", "w")
    both = named.unionByName(named.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    joined = F.when(F.count(F.lit(1)) == 1, F.max("w")).otherwise(F.max("w") + F.min("w") - F.max("w") * F.min("w"))
    return both.groupBy("i", "j").agg(joined.alias("w"))


def _within(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(MOVE)), F.lit(-MOVE))


def move(points: DataFrame, edges: DataFrame, step: int, rounds: int, rows: int) -> DataFrame:
    """One round on (n, x, y): every point is drawn to its neighbours by their weights and pushed from sampled rows."""
    other = points.select(F.col("n").alias("j"), F.col("x").alias("u"), F.col("y").alias("v"))
    dx, dy = F.col("x") - F.col("u"), F.col("y") - F.col("v")
    far = dx * dx + dy * dy
    pull = -2 * F.col("w") / (1 + far)
    drawn = edges.join(points.withColumnRenamed("n", "i"), "i").join(other, "j").groupBy("i")
    drawn = drawn.agg(*[(F.sum(pull * d) / F.sum("w")).alias(c) for c, d in (("px", dx), ("py", dy))])
    draw = (F.col("n") + 1) * (2 * (step * SAMPLES + F.col("s")) + 1) * FACTOR % PRIME % rows
    push = 2 / ((0.1 + far) * (1 + far))
    pushed = points.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1)))).withColumn("j", draw)
    pushed = pushed.join(other, "j").groupBy(F.col("n").alias("i"))
    pushed = pushed.agg(*[(F.sum(_within(push * d)) / SAMPLES).alias(c) for c, d in (("qx", dx), ("qy", dy))])
    forces = points.withColumnRenamed("n", "i").join(pushed, "i").join(drawn, "i", "left")
    rate = 1 - step / rounds
    moved = [(F.col(c) + rate * _within(F.coalesce(f"p{c}", F.lit(0.0)) + F.col(f"q{c}"))).alias(c) for c in ("x", "y")]
    return forces.select(F.col("i").alias("n"), *moved)


def layout_2d(vectors: DataFrame, k: int = NEIGHBOURS, metric: str = "cosine", rounds: int = ROUNDS) -> DataFrame:
    """Two plot coordinates for each id, and whether its name is shown (about MAP_LABELS names in all).

    Points start on the two principal components. Each round moves them towards their k nearest neighbours and away
    from a few other rows; it is one job of joins on row numbers, whose size is that of the neighbour lists. Samples
    follow from the row numbers, so a layout does not depend on partitions.
    """
    placed = staged(position_by_sort(vectors.select("id", "vec"), [F.length("id"), F.col("id")], "n"))
    rows = placed.count()
    every = max(rows // MAP_LABELS, 1)
    if not rows:
        none = F.lit(None).cast("double")
        return placed.select("id", none.alias("x"), none.alias("y"), F.lit(True).alias("show_label"))
    model = fit_components(placed, 2)
    flat = staged(model.transform(model.prepare(placed)).select("n", vector_to_array("_s").alias("p")))
    x, y = F.col("p")[0], F.coalesce(F.get("p", 1), F.lit(0.0))
    widest = flat.agg(F.max(F.greatest(F.abs(x), F.abs(y)))).first()[0] or 1.0
    points = staged(flat.select("n", (HALF_WIDTH * x / widest).alias("x"), (HALF_WIDTH * y / widest).alias("y")))
    edges = staged(neighbour_edges(knn_index(placed.select("id", "vec"), k, metric), placed.select("id", "n")))
    for step in range(rounds):
        points = staged(move(points, edges, step, rounds, rows))
    return placed.select("id", "n").join(points, "n").select("id", "x", "y", (F.col("n") % every == 0).alias("show_label"))
