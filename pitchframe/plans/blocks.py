"""Comparison of every query row with every base row of the same group, chunk against chunk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK_ROWS = 2048
# A side of a large group is cut into so many chunks, and into more only to keep them below this many rows. So a row is
# copied a fixed number of times up to SIDE * TASK_ROWS rows, however many there are.
SIDE, TASK_ROWS = 8, 131_072


def _chunks(mine: Column, other: Column, rows: int, side: int) -> Column:
    """How many chunks one side is cut into: the other side's rows are copied to each, so a small other side allows more."""
    most = side * F.greatest(F.lit(1), F.floor(mine / other))
    return F.greatest(F.least(F.ceil(mine / rows), most), F.ceil(mine / TASK_ROWS))


def _cut(df: DataFrame, row_key: str, mine: str, other: str, n_mine: Column, n_other: Column) -> DataFrame:
    """Give each row its own chunk, and a copy of it to each chunk of the other side."""
    cut = df.withColumn(mine, F.pmod(F.xxhash64(row_key), n_mine)).withColumn(
        other, F.explode(F.sequence(F.lit(0).cast("bigint"), n_other - 1))
    )
    # Columns of its own, as both sides may come from one table.
    return cut.select(*[F.col(c).alias(c) for c in cut.columns if c not in ("_nq", "_nb")])


def chunk_pairs(
    queries: DataFrame,
    base: DataFrame,
    keys: list[str],
    row_key: str,
    kernel: Callable,
    schema: str,
    rows: int = CHUNK_ROWS,
    side: int = SIDE,
) -> DataFrame:
    """Run `kernel(query_pdf, base_pdf) -> pdf` once for each pair of chunks of a group.

    A group is cut into chunks of about `rows` rows on both sides, but into `side` chunks at most as long as those stay
    below TASK_ROWS; so a task holds two chunks however large the group is, and the rows shuffled grow with the rows
    given. Every chunk pair is one unit of work that any executor can take. The kernel walks large chunks in blocks and
    gives back a few rows for each query row (its best matches, a partial sum), never the pairs. `row_key` must identify
    a row; without `keys` all rows are one group.
    """
    nq, nb = (_chunks(F.col(a), F.col(b), rows, side).alias(c) for a, b, c in (("_q", "_b", "_nq"), ("_b", "_q", "_nb")))
    if keys:
        qn = queries.groupBy(*keys).agg(F.count(F.lit(1)).alias("_q"))
        bn = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_b"))
        sizes = qn.join(bn, keys).select(*keys, nq, nb)
        queries, base = queries.join(sizes, keys), base.join(sizes, keys)
    else:
        counts = {c: df.agg(F.count(F.lit(1))).scalar() for c, df in (("_q", queries), ("_b", base))}
        # Without rows on one side there is no chunk to send the other side's rows to.
        some = (F.col("_q") > 0) & (F.col("_b") > 0)
        queries, base = (df.withColumns(counts).filter(some).select(*df.columns, nq, nb) for df in (queries, base))
    q = _cut(queries, row_key, "_qc", "_bc", F.col("_nq"), F.col("_nb"))
    b = _cut(base, row_key, "_bc", "_qc", F.col("_nb"), F.col("_nq"))
    on, names = [*keys, "_qc", "_bc"], StructType.fromDDL(schema).names

    def run(query_pdf, base_pdf):
        if len(query_pdf) and len(base_pdf):
            return kernel(query_pdf, base_pdf)
        # A chunk may have got no row.
        import pandas as pd

        return pd.DataFrame(columns=names)

    return q.groupBy(*on).cogroup(b.groupBy(*on)).applyInPandas(run, schema)
