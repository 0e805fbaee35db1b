"""A wide vector for each entity in a window: fixed convolutions over its path, pooled over time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.functions.arrays import zero_fill
from pitchframe.operators.windows import WINDOW, in_windows, sliding_windows
from pitchframe.schemas import ATTACK

KERNELS, TAPS = 256, 3
# Weights come from their number by a multiplicative generator.
FACTOR, PRIME = 48_271, 2_147_483_647
# Windows worked on at a time in a task.
AT_ONCE = 256


def _draw(n: np.ndarray) -> np.ndarray:
    """Numbers between -1 and 1, fixed by n."""
    return (n + 1) * FACTOR % PRIME * FACTOR % PRIME / PRIME * 2 - 1


def kernels(count: int, win: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dilation, numbers, weights, biases) of groups of kernels. A kernel has three taps on x and three on y, whose
    mean is taken off, so it answers to movement and not to the place; dilations double until a kernel fills a window."""
    reach = max(1, (win - 1) // (TAPS - 1))
    spread = [1 << k for k in range(reach.bit_length())]
    number = np.arange(count)
    weights = _draw(number[:, None] * 7 + np.arange(2 * TAPS)).reshape(count, 2, TAPS)
    weights -= weights.mean(axis=2, keepdims=True)
    biases = _draw(number * 7 + 2 * TAPS) / 10
    return [(d, g, weights[g], biases[g]) for i, d in enumerate(spread) if len(g := number[number % len(spread) == i])]


def convolve(paths: np.ndarray, count: int) -> np.ndarray:
    """(n, 2, win) coordinates -> (n, 2 * count): largest answer of each kernel, and share of its answers above zero."""
    n, _, win = paths.shape
    out = np.zeros((n, 2 * count))
    for d, numbers, weights, biases in kernels(count, win):
        places = win - d * (TAPS - 1)
        if places < 1:
            continue
        taps = np.stack([paths[:, c, j * d : j * d + places] for c in range(2) for j in range(TAPS)], axis=2)
        answer = taps @ weights.reshape(len(numbers), -1).T + biases
        out[:, numbers], out[:, count + numbers] = answer.max(axis=1), (answer > 0).mean(axis=1)
    return out


def conv_features(
    slab: DataFrame, entities: DataFrame, lengths: DataFrame, win: int = 150, stride: int = 75, min_observed: int = 0, count: int = KERNELS
) -> DataFrame:
    """`window_features` with a vector of 2 * `count` numbers: answers of fixed kernels to the entity's path.

    The path is the window's frames, zero where nothing was seen. Entities a window never saw are all-zero vectors, left
    out if min_observed is above 0. Weights follow from the kernel's number alone, so vectors of different runs compare.
    """
    seen = in_windows(slab.filter(F.col("x").isNotNull() & F.col("y").isNotNull()), win, stride)
    frames = seen.groupBy(*WINDOW, "entity_idx").agg(
        F.count(F.lit(1)).alias("n_observed"), F.map_from_entries(F.collect_list(F.struct("window_pos", F.struct("x", "y")))).alias("_m")
    )
    steps = F.sequence(F.lit(0).cast("bigint"), F.lit(win - 1).cast("bigint"))
    x, y = (F.transform(steps, lambda i: zero_fill(F.try_element_at("_m", i)[axis])) for axis in ("x", "y"))
    paths = frames.select(*WINDOW, "entity_idx", "n_observed", F.concat(x, y).alias("path"))

    @F.pandas_udf("array<double>")
    def encode(path: pd.Series) -> pd.Series:
        found = []
        for at in range(0, len(path), AT_ONCE):
            found.extend(convolve(np.stack(path.iloc[at : at + AT_ONCE].to_numpy()).reshape(-1, 2, win), count))
        return pd.Series(found, dtype=object)

    encoded = paths.select(*WINDOW, "entity_idx", "n_observed", encode("path").alias("vec"))
    slots = sliding_windows(lengths, win, stride).join(entities.select(*ATTACK, "entity_idx", "is_ball", "entity_id"), ATTACK)
    return (
        slots.join(encoded, [*WINDOW, "entity_idx"], "left")
        .withColumn("n_observed", F.coalesce("n_observed", F.lit(0).cast("bigint")))
        .filter(F.col("n_observed") >= min_observed)
        .select(
            *WINDOW, "entity_idx", "is_ball", "entity_id", "n_observed", F.coalesce("vec", F.array_repeat(F.lit(0.0), 2 * count)).alias("vec")
        )
    )
