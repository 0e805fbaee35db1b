"""Movement targets of a patch, the losses on them, and the linear head that predicts them."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.plans.ranking import position_by_long
from pitchframe.plans.session import staged
from pitchframe.schemas import TEMPERATURE

LAST_FRAMES = 10
DELTA_WEIGHT, NCE_WEIGHT = 1.0, 0.5
BATCH = 64
BATCHES_PER_GROUP = 32
MAX_HEAD_WIDTH = 1024
MERGED = 64


def frame_deltas(patches: DataFrame) -> DataFrame:
    """Add `deltas`, the steps dx, dy between the last ten frames (18 numbers), and `valid`.

    Patches shorter than ten frames have zero steps. A slot is valid if it is non-zero in one of the last two frames.
    """
    n = F.size("xs")

    def at(axis: str, i: Column) -> Column:
        return F.get(axis, n - LAST_FRAMES + i)

    steps = F.transform(
        F.sequence(F.lit(1), F.lit(LAST_FRAMES - 1)),
        lambda i: F.array(at("xs", i) - at("xs", i - 1), at("ys", i) - at("ys", i - 1)),
    )
    none = F.array_repeat(F.lit(0.0), 2 * (LAST_FRAMES - 1))

    def moved(back: int) -> Column:
        return F.coalesce((F.get("xs", n - back) != 0) | (F.get("ys", n - back) != 0), F.lit(False))

    return patches.withColumns(
        {"deltas": F.when(n < LAST_FRAMES, none).otherwise(F.flatten(steps)), "valid": moved(1) | moved(2)}
    )


def masked_mse(df: DataFrame, pred: str, target: str, valid: str = "valid", by: list[str] | None = None) -> DataFrame:
    """Mean squared error of each row's trajectory, averaged over the valid rows."""
    square = F.zip_with(pred, target, lambda a, b: (a - b) * (a - b))
    err = F.aggregate(square, F.lit(0.0), lambda s, e: s + e) / F.size(target)
    ok = F.col(valid).cast("int")
    return df.groupBy(*(by or [])).agg((F.sum(err * ok) / F.greatest(F.sum(ok), F.lit(1))).alias("masked_mse"))


def batches(df: DataFrame, key: str, size: int = BATCH) -> DataFrame:
    """Add `batch_id`: consecutive batches of `size` rows in the order of a unique whole-number key."""
    placed = position_by_long(df, key, "_pos")
    return placed.withColumn("batch_id", F.floor(F.col("_pos") / size)).drop("_pos")


def _by_batch(df: DataFrame, key: str, size: int, tau: float, per_batch, schema: str) -> DataFrame:
    """Run `per_batch(keys, similarities)` on each batch; a task gets 32 batches at a time."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        out = []
        for batch, rows in pdf.groupby("batch_id"):
            rows = rows.sort_values(key)
            v = np.stack(rows["vec"].to_numpy())
            out.append(per_batch(batch, rows[key].to_numpy(), v @ v.T / tau))
        return pd.concat(out)

    rows = batches(df.select(key, "vec"), key, size)
    group = F.floor(F.col("batch_id") / BATCHES_PER_GROUP)
    return rows.groupBy(group.alias("_group")).applyInPandas(run, schema)


def batch_similarity(df: DataFrame, key: str, size: int = BATCH, tau: float = TEMPERATURE) -> DataFrame:
    """Similarities of each vector with its batch, in key order, over the temperature: (batch_id, key, sims).

    Batches are cut here, so a list has `size` numbers at most.
    """

    def rows(batch, keys, sims):
        import pandas as pd

        return pd.DataFrame({"batch_id": batch, key: keys, "sims": list(sims)})

    return _by_batch(df, key, size, tau, rows, f"batch_id long, `{key}` long, sims array<double>")


def info_nce_rows(df: DataFrame, key: str, size: int = BATCH, tau: float = TEMPERATURE) -> DataFrame:
    """(batch_id, key, loss): -log softmax of each vector's own place among its batch."""

    def rows(batch, keys, sims):
        import numpy as np
        import pandas as pd

        top = sims.max(1)
        loss = top + np.log(np.exp(sims - top[:, None]).sum(1)) - np.diagonal(sims)
        return pd.DataFrame({"batch_id": batch, key: keys, "loss": loss})

    return _by_batch(df, key, size, tau, rows, f"batch_id long, `{key}` long, loss double")


def info_nce(df: DataFrame, key: str, size: int = BATCH, tau: float = TEMPERATURE) -> DataFrame:
    return info_nce_rows(df, key, size, tau).agg(F.avg("loss").alias("info_nce"))


def evaluate_splits(rows: DataFrame, key: str, size: int = BATCH) -> DataFrame:
    """Losses of each split. `rows` has split, a unique key, vec, pred, deltas and valid; it is written once."""
    rows = staged(rows.select("split", key, "vec", "pred", "deltas", "valid"))
    delta = masked_mse(rows, "pred", "deltas", by=["split"]).withColumnRenamed("masked_mse", "loss_delta")
    nce = None
    for name in ("train", "val", "test"):
        part = info_nce(rows.filter(F.col("split") == name), key, size).select(
            F.lit(name).alias("split"), F.col("info_nce").alias("loss_infonce")
        )
        nce = part if nce is None else nce.unionByName(part)
    total = DELTA_WEIGHT * F.col("loss_delta") + NCE_WEIGHT * F.col("loss_infonce")
    return delta.join(nce, "split").withColumn("loss", total)


def fit_delta_head(df: DataFrame) -> np.ndarray | None:
    """Least squares of `deltas` on `vec` (with an intercept) over the valid rows: a (width+1) x 18 matrix, None without
    a valid row.

    One pass: tasks sum X'X and X'Y over their rows, the sums of MERGED tasks are added up by one task, those of
    MERGED such tasks by the next, and what is left of them last. The driver solves the small system.
    """
    width = df.filter("valid").agg(F.max(F.size("vec")).alias("d")).first()["d"]
    if width is None:
        return None
    if not width or width > MAX_HEAD_WIDTH:
        raise ValueError(f"vectors must have 1..{MAX_HEAD_WIDTH} numbers, not {width}")
    n, m = width + 1, 2 * (LAST_FRAMES - 1)

    def products(batches):
        import numpy as np
        import pandas as pd

        total = np.zeros((n, n + m))
        for pdf in batches:
            if len(pdf):
                x = np.column_stack([np.stack(pdf["vec"].to_numpy()), np.ones(len(pdf))])
                total += x.T @ np.column_stack([x, np.stack(pdf["deltas"].to_numpy())])
        yield pd.DataFrame({"p": [total.ravel()]})

    parts = df.filter("valid").select("vec", "deltas").mapInPandas(products, "p array<double>")
    parts = parts.select(F.spark_partition_id().alias("part"), array_to_vector("p").alias("p"))
    for _ in range(2):
        parts = parts.groupBy(F.floor(F.col("part") / MERGED).alias("part")).agg(Summarizer.sum(F.col("p")).alias("p"))
    summed = parts.agg(Summarizer.sum(F.col("p")).alias("s"))
    total = np.array(summed.select(vector_to_array("s").alias("s")).first()["s"]).reshape(n, n + m)
    return np.linalg.lstsq(total[:, :n], total[:, n:], rcond=None)[0]


def predict_deltas(df: DataFrame, head: np.ndarray | None) -> DataFrame:
    """Add `pred`, the steps the head expects; NULL without a head."""
    if head is None:
        return df.withColumn("pred", F.lit(None).cast("array<double>"))

    @F.pandas_udf("array<double>")
    def apply(vec):
        import numpy as np
        import pandas as pd

        return pd.Series(list(np.stack(vec.to_numpy()) @ head[:-1] + head[-1]))

    return df.withColumn("pred", apply("vec"))
