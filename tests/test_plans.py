import random

import pytest
from pyspark.sql import functions as F

from pitchframe.plans import ranking as RK
from pitchframe.plans.blocks import SIDE, chunk_pairs
from pitchframe.plans.session import shared_folder, staged


@pytest.mark.parametrize("spread", [1, 1000, 10**9])
def test_position_by_long(spark, spread):
    """Dense, sparse and far apart keys, negative ones too, most of them in one block."""
    rng = random.Random(spread)
    keys = sorted({rng.randrange(-50, 400) * spread for _ in range(300)} | {-(2**62), 2**62})
    df = spark.createDataFrame([(k,) for k in rng.sample(keys, len(keys))], "k long")
    got = {r.k: r.position for r in RK.position_by_long(df, "k").collect()}
    assert got == {k: i for i, k in enumerate(keys)}


def test_position_by_hash_and_sort(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k")).repartition(5)
    got = RK.position_by_hash(df, ["k"], 1).collect()
    assert sorted(r.position for r in got) == list(range(500))
    import hashlib

    want = sorted((str(i) for i in range(500)), key=lambda k: hashlib.md5(f"1|{k}".encode()).hexdigest())
    assert [r.k for r in sorted(got, key=lambda r: r.position)] == want
    placed = {r.k: r.position for r in RK.position_by_sort(df, [F.length("k"), F.col("k")]).collect()}
    assert placed == {str(i): i for i in range(500)}


@pytest.mark.parametrize("chunk", [32, 2])
def test_every_chunk_pair_once(spark, chunk):
    """Groups of very different size: each query meets each base row of its group exactly once."""
    total = 300 if chunk > 2 else 20
    rows = [(0, i) for i in range(total)] + [(1, i) for i in range(total, total + 3)]
    df = spark.createDataFrame(rows, "g int, k int")

    def kernel(q, b):
        import pandas as pd

        return pd.DataFrame({"g": q["g"], "k": q["k"], "n": len(b), "s": int(b["k"].sum())})

    out = chunk_pairs(df, df, ["g"], "k", kernel, "g int, k int, n long, s long", rows=chunk)
    assert out.count() > total
    got = out.groupBy("g", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    assert len(got) == total + 3
    assert {(r.g, r.n, r.s) for r in got} == {(0, total, total * (total - 1) // 2), (1, 3, 3 * total + 3)}


def test_staged_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, None, [1.0, None])], "a int, b string, c array<double>")
    again = staged(df)
    assert again.dtypes == df.dtypes and again.collect() == df.collect()
    assert shared_folder(spark) in again.inputFiles()[0]


class Session:
    """Settings and master of a session that names no folder."""

    def __init__(self, master):
        self.conf, self.sparkContext = Settings(), type("Context", (), {"master": master})()


class Settings(dict):
    def set(self, key, value):
        self[key] = value


def test_only_a_local_session_makes_its_own_folder(spark):
    local = Session("local[2]")
    assert shared_folder(local) == shared_folder(local)
    with pytest.raises(ValueError):
        shared_folder(Session("yarn"))
    named = Session("yarn")
    named.conf.set("spark.checkpoint.dir", "hdfs:///x")
    assert shared_folder(named) == "hdfs:///x"
    spark.conf.set("spark.pitchframe.folder", "x")
    spark.conf.unset("spark.pitchframe.folder")


def test_copies_do_not_grow_with_the_group(spark):
    """A large group is cut into SIDE chunks however small they were asked for; a small other side allows more."""
    df = spark.range(600).withColumnRenamed("id", "k")

    def kernel(q, b):
        import pandas as pd

        return pd.DataFrame({"k": q["k"], "n": len(b)})

    def met(queries, base):
        out = chunk_pairs(queries, base, [], "k", kernel, "k long, n long", rows=6)
        return [tuple(r)[1:] for r in out.groupBy("k").agg(F.count("*"), F.sum("n")).collect()]

    assert met(df, df) == [(SIDE, 600)] * 600
    assert met(df, df.limit(6)) == [(1, 6)] * 600
    assert all(chunks > SIDE and n == 600 for chunks, n in met(df.limit(6), df))
