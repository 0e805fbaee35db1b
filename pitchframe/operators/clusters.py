"""k-means with several restarts in one pass over the rows for each round."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.plans.ranking import hash_text
from pitchframe.plans.session import staged

ROUNDS = 50
# First centres are drawn from a bounded sample; the centres of all restarts are broadcast, so their bytes are checked.
SAMPLE_ROWS, CENTRE_BYTES = 16_384, 64 << 20
# Draws go by a number of 28 bits of each row, multiplied modulo a prime for each draw.
HASH_DIGITS, PRIME = 7, 2_147_483_647
# Costs equal to so many decimals tie, and the earlier restart wins.
COST_DIGITS = 6


def _square(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points * points).sum(1)[:, None] + (centres * centres).sum(1) - 2 * points @ centres.T, 0)


def first_centres(points: np.ndarray, hashes: np.ndarray, k: int, restarts: int) -> list[np.ndarray]:
    """Rows of `points` for each restart, drawn one by one with a chance that grows with the squared distance to those
    already drawn. A draw takes the row with the smallest -ln(u)/weight, u being a number between 0 and 1 that the row's
    hash gives for this draw, so it does not depend on the order of rows. Fewer than k if rows repeat."""
    out = []
    for r in range(restarts):
        near, chosen = np.ones(len(points)), []
        for step in range(k):
            u = (hashes * (2 * (r * k + step) + 1) % PRIME + 0.5) / PRIME
            live = np.flatnonzero(near > 0)
            if not len(live):
                break
            chosen.append(live[np.argmin(-np.log(u[live]) / near[live])])
            away = ((points - points[chosen[-1]]) ** 2).sum(1)
            near = np.minimum(near, away) if step else away
        out.append(points[chosen])
    return out


def _partial_sums(centres: list[np.ndarray]):
    """Sum, number and cost of each cluster of each restart over the rows of a task."""

    def run(batches):
        sums, counts = [np.zeros_like(c) for c in centres], [np.zeros(len(c)) for c in centres]
        costs = [np.zeros(len(c)) for c in centres]
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["vec"].to_numpy())
            for c, s, n, cost in zip(centres, sums, counts, costs):
                away = _square(x, c)
                member = away.argmin(1)
                s += (member == np.arange(len(c))[:, None]).astype(np.float64) @ x
                n += np.bincount(member, minlength=len(c))
                cost += np.bincount(member, away[np.arange(len(x)), member], len(c))
        rows = [(r, k, n[k], cost[k], s[k]) for r, (s, n, cost) in enumerate(zip(sums, counts, costs)) for k in np.flatnonzero(n)]
        yield pd.DataFrame(rows, columns=["restart", "cluster", "n", "cost", "total"])

    return run


def _one_round(rows: DataFrame, centres: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """New centres of all restarts, and what the old ones cost; a cluster without rows keeps its centre."""
    schema = "restart int, cluster int, n double, cost double, total array<double>"
    parts = rows.select("vec").mapInPandas(_partial_sums(centres), schema)
    summed = parts.groupBy("restart", "cluster").agg(
        F.sum("n").alias("n"), F.sum("cost").alias("cost"), Summarizer.sum(array_to_vector("total")).alias("total")
    )
    new, costs = [c.copy() for c in centres], np.zeros(len(centres))
    for r in summed.select("restart", "cluster", "n", "cost", vector_to_array("total").alias("total")).collect():
        new[r.restart][r.cluster] = np.array(r.total) / r.n
        costs[r.restart] += r.cost
    return new, costs


def kmeans(df: DataFrame, k: int, restarts: int, seed: int, rounds: int = ROUNDS) -> DataFrame:
    """Add `cluster` to rows of (id, vec): the cheapest of several k-means runs.

    Every round is one job for all restarts: tasks give back one sum for each cluster of each restart. Clusters are
    numbered by their first id in (length, text) order, so the numbers do not depend on how a run came to them.
    """
    rows = staged(df)
    width = rows.agg(F.max(F.size("vec"))).first()[0]
    if not width:
        return rows.withColumn("cluster", F.lit(0))
    if restarts * k * width * 8 > CENTRE_BYTES:
        raise ValueError(f"{restarts} times {k} centres of {width} numbers take more than {CENTRE_BYTES} bytes; ask for fewer restarts")
    number = F.conv(F.substring(hash_text(["id"], seed), 1, HASH_DIGITS), 16, 10).cast("bigint")
    sample = rows.select("id", "vec", number.alias("h")).orderBy("h", F.length("id"), "id").limit(SAMPLE_ROWS).toPandas()
    centres = first_centres(np.stack(sample["vec"].to_numpy()), sample["h"].to_numpy(), k, restarts)
    for _ in range(rounds):
        new, _ = _one_round(rows, centres)
        still = all(np.allclose(a, b, rtol=1e-12, atol=1e-12) for a, b in zip(new, centres))
        centres = new
        if still:
            break
    _, costs = _one_round(rows, centres)
    best = rows.sparkSession.sparkContext.broadcast(centres[int(np.argmin(np.round(costs, COST_DIGITS)))])

    @F.pandas_udf("int")
    def nearest(vec: pd.Series) -> pd.Series:
        return pd.Series(_square(np.stack(vec.to_numpy()), best.value).argmin(1) if len(vec) else [], dtype="int32")

    found = staged(rows.withColumn("_found", nearest("vec")))
    # One row for each cluster, so one task numbers them.
    first = found.groupBy("_found").agg(F.min(F.struct(F.length("id").alias("n"), "id")).alias("first"))
    numbers = first.select("_found", (F.row_number().over(Window.orderBy("first")) - 1).alias("cluster"))
    return found.join(numbers, "_found").drop("_found")
