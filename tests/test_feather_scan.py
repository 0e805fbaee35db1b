"""How much of a Feather folder is read: tasks, files, batches and columns."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pitchframe.sources import feather as FE


@pytest.fixture
def folder(spark, tmp_path):
    def write(name, first, batches):
        with pa.OSFile(str(tmp_path / f"{name}.feather"), "wb") as out:
            schema = pa.schema([("n", pa.int64()), ("s", pa.string()), ("x", pa.float64())])
            with pa.ipc.new_file(out, schema) as w:
                for b in range(batches):
                    rows = range(first + 100 * b, first + 100 * (b + 1))
                    w.write_batch(pa.record_batch([list(rows), [None if i % 7 == 0 else f"t{i % 3}" for i in rows], [i / 2 for i in rows]], schema=schema))

    write("a", 0, 10)
    write("b", 1000, 1)
    write("c", 1100, 1)
    yield str(tmp_path)
    FE.register_feather(spark)


def register(spark, size):
    spark.dataSource.register(FE._source(size))


def test_large_files_are_cut_and_small_ones_share_a_task(spark, folder):
    register(spark, 5000)
    df = spark.read.format("feather").load(folder)
    assert df.count() == 1200 and df.rdd.getNumPartitions() > 4
    spread = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("stem").alias("n"), F.min("stem").alias("s")).collect()
    assert sum(r.s == "a" for r in spread) > 3
    register(spark, 1 << 20)
    assert spark.read.format("feather").load(folder).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("equals", [{"stem": "b"}, {"n": 7}, {"s": "t1", "stem": "a"}, {"x": 10.5}, {"s": "none"}])
def test_rows_are_chosen(spark, folder, equals):
    register(spark, 1)
    whole = spark.read.format("feather").load(folder)
    some = spark.read.format("feather").option("equals", json.dumps(equals)).load(folder)
    want = whole
    for name, value in equals.items():
        want = want.filter(F.col(name) == value)
    assert sorted(map(str, some.collect())) == sorted(map(str, want.collect()))
    if equals.get("stem") == "b":
        assert some.rdd.getNumPartitions() == 1
    assert whole.count() == 1200


def test_columns_are_chosen(spark, folder):
    register(spark, 1 << 20)
    df = spark.read.format("feather").option("columns", "x, stem").load(folder)
    assert df.columns == ["x", "stem"]
    assert df.filter("stem = 'c'").agg(F.sum("x")).first()[0] == sum(i / 2 for i in range(1100, 1200))
    assert spark.read.format("feather").option("columns", "stem").load(folder).distinct().count() == 3
