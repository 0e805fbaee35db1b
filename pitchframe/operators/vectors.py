"""One vector for each player or attack, and its projection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.functions.arrays import l2_normalise
from pitchframe.operators.windows import WINDOW
from pitchframe.schemas import SLOTS, VECTOR_WIDTH

# The covariance of the vectors is solved on the driver: width x width doubles.
MAX_PCA_WIDTH = 4096


def mean_vectors(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Mean vector of each group. Partial sums are merged before the shuffle, so a hot group is no burden."""
    return (
        df.withColumn("_v", array_to_vector(vec))
        .groupBy(*keys)
        .agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count(F.lit(1)).alias("n_vectors"))
        .select(*keys, "n_vectors", vector_to_array("_m").alias(vec))
    )


def player_mean_vectors(features: DataFrame) -> DataFrame:
    """Mean of the unit window vectors of each player over all attacks and windows."""
    known = features.filter(F.col("entity_id").isNotNull() & (F.col("entity_id") != "ball"))
    unit = known.select(F.col("entity_id").alias("id"), l2_normalise("vec").alias("vec"))
    return mean_vectors(unit, ["id"])


def player_order(df: DataFrame, key: str = "id") -> DataFrame:
    return df.orderBy(F.length(key), key)


def attack_vectors(features: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Mean over the slots of a window, empty slots counting as zero, then unit length."""
    mean = mean_vectors(features, WINDOW)
    share = F.col("n_vectors") / slots
    return mean.select(*WINDOW, l2_normalise(F.transform("vec", lambda x: x * share)).alias("vec"))


@dataclass
class Projection:
    model: PipelineModel  # centring, principal components, their signs
    vectors: DataFrame  # id, vec of unit length
    ids: DataFrame  # id


class Components:
    """Centring, principal components and their signs, fitted; gives column `_s`."""

    def __init__(self, model: PipelineModel):
        self.model = model

    @staticmethod
    def prepare(vectors: DataFrame) -> DataFrame:
        return vectors.withColumn("_v", array_to_vector("vec"))

    def transform(self, prepared: DataFrame) -> DataFrame:
        return self.model.transform(prepared)


def fit_components(vectors: DataFrame, k: int) -> Components:
    """The first min(k, rows, width) principal components of centred vectors.

    A component and its negative explain the same, so the sign is fixed: its entry of largest size, the first of equal
    ones, is positive. The covariance is summed up in tasks; the driver solves width x width numbers.
    """
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    if not size["n"]:
        raise ValueError("no vectors to project")
    if size["d"] > MAX_PCA_WIDTH:
        raise ValueError(f"vectors of width {size['d']} exceed {MAX_PCA_WIDTH}")
    k = min(k, size["n"], size["d"])
    data = Components.prepare(vectors)
    centre = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(data)
    pca = PCA(k=k, inputCol="_c", outputCol="_p").fit(centre.transform(data))
    parts = pca.pc.toArray()
    first = (np.abs(parts) >= np.abs(parts).max(axis=0) - 1e-9).argmax(axis=0)
    signs = np.where(parts[first, np.arange(k)] < 0, -1.0, 1.0)
    sign = ElementwiseProduct(scalingVec=Vectors.dense(signs), inputCol="_p", outputCol="_s")
    return Components(PipelineModel([centre, pca, sign]))


def pca_project(vectors: DataFrame, k: int = VECTOR_WIDTH) -> Projection:
    """Project centred vectors on their first components, scale to unit length."""
    fitted = fit_components(vectors, k)
    out = fitted.transform(fitted.prepare(vectors)).select("id", l2_normalise(vector_to_array("_s")).alias("vec"))
    return Projection(fitted.model, out, vectors.select("id"))


def save_projection(projection: Projection, path: str) -> None:
    """Keep the centring mean, the components and the ids beside the vectors."""
    projection.model.write().overwrite().save(f"{path}/model")
    projection.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    player_order(projection.ids).write.mode("overwrite").parquet(f"{path}/ids")
