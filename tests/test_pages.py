import pytest
from pyspark.sql import functions as F

from pitchframe.operators import rows as R
from pitchframe.sources import pages as PG


@pytest.fixture
def table(spark):
    return spark.range(1000).select((F.col("id") * 7919 % 1000 * 3 - 500).alias("rid"), F.md5(F.col("id").cast("string")).alias("t")).repartition(5)


def test_pages_are_the_table_in_order(spark, table, tmp_path):
    path = str(tmp_path / "p")
    PG.write_pages(table, path, file_rows=90)
    want = [tuple(r) for r in table.orderBy("rid").collect()]
    got = [[tuple(r) for r in PG.read_page(spark, path, i, 130).collect()] for i in range(9)]
    assert [len(p) for p in got] == [130] * 7 + [90, 0] and sum(got, []) == want
    assert got[3] == [tuple(r) for r in R.page(table, 3, "rid", 130).collect()]
    assert PG.read_page(spark, path, 10**12).columns == ["rid", "t"] and PG.read_page(spark, path, 0, 10**9).count() == 1000


def test_a_page_opens_its_files_only(spark, table, tmp_path):
    path = str(tmp_path / "p")
    PG.write_pages(table, path, file_rows=50)
    assert PG.page_index(spark, path).count() >= 20
    for i in (0, 7, 31):
        df = PG.read_page(spark, path, i, 32)
        assert len(df.inputFiles()) <= 2
        plan = df._jdf.queryExecution().toString()
        assert "GreaterThanOrEqual(_place," in plan[plan.index("PushedFilters") :]


def test_keys_of_a_read_and_null(spark, tmp_path):
    rows = [((f"f{i % 3}", i), i) for i in range(40)] + [(None, 99)]
    df = spark.createDataFrame(rows, "rid struct<file:string,line:bigint>, n bigint").repartition(3)
    PG.write_pages(df, str(tmp_path / "p"))
    got = [r.n for i in range(5) for r in PG.read_page(spark, str(tmp_path / "p"), i, 10).collect()]
    assert got == [99, *sorted(range(40), key=lambda i: (i % 3, i))]


def test_refusals(spark, table, tmp_path):
    path = str(tmp_path / "p")
    PG.write_pages(table.limit(0), path)
    assert PG.read_page(spark, path, 0).count() == 0
    with pytest.raises(Exception, match="exists"):
        PG.write_pages(table, path)
    with pytest.raises(ValueError):
        PG.read_page(spark, path, -1)
    with pytest.raises(ValueError):
        PG.write_pages(table.withColumn("_place", F.lit(1)), path)
    table.withColumn("_place", F.lit(1)).write.parquet(f"{tmp_path}/q/rows")
    with pytest.raises(FileNotFoundError):
        PG.read_page(spark, f"{tmp_path}/q", 0)
