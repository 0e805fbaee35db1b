"""Quality of a labelled vector space: purity, silhouette, mutual information with clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.functions.arrays import l2_normalise
from pitchframe.operators.clusters import kmeans
from pitchframe.operators.neighbours import knn_pairs, label_distances, neighbour_purity
from pitchframe.operators.rows import require_rows
from pitchframe.operators.vectors import mean_vectors
from pitchframe.plans.blocks import CHUNK_ROWS, chunk_pairs
from pitchframe.plans.ranking import position_by_sort
from pitchframe.plans.session import staged

RESTARTS = 10
SEED = 42


def labelled_vectors(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """Vectors whose id has a label."""
    return vectors.join(labels.select("id", "label"), "id")


def common_ids(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    return vectors.select("id").intersect(labels.select("id"))


def unlabelled_ids(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    return vectors.select("id").exceptAll(labels.select("id"))


def distinct_labels(labels: DataFrame) -> DataFrame:
    """Each label once with its code, 0-based in text order."""
    return position_by_sort(labels.select("label").distinct(), ["label"], "code")


def _score(own: Column, other: Column, own_n: Column) -> Column:
    """Silhouette of one vector from its mean distance to its own label and to the closest other one."""
    width = F.greatest(own, other)
    return F.when((own_n <= 1) | (width == 0), 0.0).otherwise((other - own) / width)


def _cosine_scores(df: DataFrame, chunk_rows: int) -> DataFrame:
    """Every vector against one mean unit vector for each label; a chunk pair gives one row for each vector."""

    def nearest(q, b):
        import numpy as np
        import pandas as pd

        x, m = np.stack(q["vec"].to_numpy()), np.stack(b["vec"].to_numpy())
        dist = 1.0 - x @ m.T
        own = q["label"].to_numpy()[:, None] == b["label"].to_numpy()[None, :]
        n = b["n_vectors"].to_numpy().astype("float64")
        # The mean distance to the own label leaves the vector itself out.
        total = dist * n - (1.0 - (x * x).sum(1))[:, None]
        mine = np.where(own, total / np.maximum(n - 1, 1), np.nan)
        out = pd.DataFrame({"id": q["id"]})
        has = own.any(1)
        out["own"] = np.where(has, np.nan_to_num(mine).sum(1), np.nan)
        out["own_n"] = np.where(has, (own * n).sum(1), np.nan)
        best = np.where(own, np.inf, dist).min(1)
        out["other"] = np.where(np.isinf(best), np.nan, best)
        return out

    unit = df.select("id", F.col("label").cast("string").alias("label"), l2_normalise("vec").alias("vec"))
    means = mean_vectors(unit, ["label"]).withColumn("id", F.col("label"))
    schema = "id string, own double, own_n double, other double"
    parts = chunk_pairs(unit, means, [], "id", nearest, schema, chunk_rows)
    null = F.lit(None).cast("double")
    merged = parts.groupBy("id").agg(
        *[f(F.nanvl(c, null)).alias(c) for f, c in ((F.max, "own"), (F.max, "own_n"), (F.min, "other"))]
    )
    return merged.select("id", _score(F.col("own"), F.col("other"), F.col("own_n")).alias("score"))


def _euclidean_scores(df: DataFrame, chunk_rows: int) -> DataFrame:
    sums = label_distances(df, chunk_rows)
    own = F.col("label") == F.col("other")
    means = sums.groupBy("id").agg(
        F.max(F.when(own, F.col("total") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("own"),
        F.max(F.when(own, F.col("n"))).alias("own_n"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("other"),
    )
    return means.select("id", _score(F.col("own"), F.col("other"), F.col("own_n")).alias("score"))


def silhouette(df: DataFrame, metric: str = "cosine", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Mean silhouette of (id, vec, label); NULL unless there are 2 .. N-1 labels."""
    scores = _cosine_scores(df, chunk_rows) if metric == "cosine" else _euclidean_scores(df, chunk_rows)
    size = df.agg(F.count_distinct("label").alias("k"), F.count(F.lit(1)).alias("n"))
    mean = scores.agg(F.avg("score")).scalar()
    return size.select(F.when((F.col("k") >= 2) & (F.col("k") <= F.col("n") - 1), mean).alias("silhouette"))


def kmeans_labels(df: DataFrame, k: int | None = None, restarts: int = RESTARTS, seed: int = SEED) -> DataFrame:
    """Add `cluster`: the best of `restarts` k-means runs by cost, k being the number of labels."""
    k = k or df.select("label").distinct().count()
    return kmeans(df, k, restarts, seed) if k > 1 else df.withColumn("cluster", F.lit(0))


def nmi(df: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    """Mutual information of two labellings over the mean of their entropies; 1 when both have one class only.

    H(l)+H(c)-H(l,c) needs only the sums of n*log(n) over the two margins and the joint counts.
    """
    joint = df.groupBy(F.col(label).alias("l"), F.col(cluster).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    left = joint.groupBy("l").agg(F.sum("n").alias("n")).select(F.lit("l").alias("kind"), "n")
    right = joint.groupBy("c").agg(F.sum("n").alias("n")).select(F.lit("c").alias("kind"), "n")
    both = joint.select(F.lit("lc").alias("kind"), "n")

    def entropy(kind: str) -> Column:
        of = F.col("kind") == kind
        total = F.sum(F.when(of, F.col("n")))
        return F.log(total) - F.sum(F.when(of, F.col("n") * F.log(F.col("n")))) / total

    sums = left.unionByName(right).unionByName(both)
    sums = sums.agg(entropy("l").alias("hl"), entropy("c").alias("hc"), entropy("lc").alias("hlc"))
    mutual = F.greatest(F.col("hl") + F.col("hc") - F.col("hlc"), F.lit(0.0))
    mean = (F.col("hl") + F.col("hc")) / 2
    return sums.select(F.when(mean <= 1e-15, 1.0).otherwise(mutual / mean).alias("nmi"))


def space_report(vectors: DataFrame, labels: DataFrame, space: str, metric: str = "cosine", k: int = 10) -> DataFrame:
    """(space, metric, value) for purity, silhouette and mutual information of one vector space."""
    both = staged(require_rows(labelled_vectors(vectors, labels), "no overlapping ids between vectors and labels"))
    results = [neighbour_purity(knn_pairs(both, k, metric)), silhouette(both, metric), nmi(kmeans_labels(both))]
    rows = [r.select(F.lit(r.columns[0]).alias("metric"), F.col(r.columns[0]).alias("value")) for r in results]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select(F.lit(space).alias("space"), "metric", "value")


def compare_spaces(spaces: dict[str, DataFrame], labels: DataFrame, metric: str = "cosine", k: int = 10) -> DataFrame:
    """Reports of several spaces, one below the other."""
    out = None
    for name, vectors in spaces.items():
        report = space_report(vectors, labels, name, metric, k)
        out = report if out is None else out.unionByName(report)
    return out


def write_metrics_json(report: DataFrame, path: str) -> None:
    """One JSON object {space: {metric: value}}; a report has three rows for each space."""
    inner = F.map_from_entries(F.collect_list(F.struct("metric", "value")))
    spaces = report.groupBy("space").agg(inner.alias("m"))
    whole = F.to_json(F.map_from_entries(F.collect_list(F.struct("space", "m"))))
    spaces.agg(whole.alias("value")).write.mode("overwrite").text(path)
