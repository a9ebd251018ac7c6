import pytest
from pyspark.sql import functions as F

from noteloom import runtime
from noteloom.runtime import Scratch, fresh_name, numbered, scans_parquet


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "odd name%é" / "t.parquet")
    spark.range(1000).withColumn("uid", F.lit(7)).repartition(5).write.parquet(path)
    yield spark.read.parquet(path)
    for key in ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


def numbers(spark, df, partitions, **more):
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    spark.conf.set("spark.sql.files.minPartitionNum", partitions)
    return sorted((r.id, r.row_number) for r in numbered(df, Scratch(spark, "test"), "row_number", **more).collect())


def test_numbers_stay_when_a_scan_is_cut_otherwise(spark, table):
    part = table.filter("id % 2 = 0").select("id")
    first = numbers(spark, part, 1)
    assert first == numbers(spark, part, 8) and len({n for _, n in first}) == 500


def test_other_plans_are_written(spark, table):
    assert scans_parquet(table) and not scans_parquet(table.distinct()) and not scans_parquet(table.filter("rand() < 2")) and not scans_parquet(spark.range(3))
    for df, more in ((table.distinct(), {}), (table, {"most_names": 3}), (spark.range(1000), {}), (table.unionByName(table), {})):
        made = numbered(df, Scratch(spark, "test"), "row_number", **more)
        want = df.count()
        assert made.columns == [*df.columns, "row_number"] and made.select("row_number").distinct().count() == want
        assert sorted(made.collect()) == sorted(made.collect())
    assert numbered(table.limit(0), Scratch(spark, "test")).count() == numbered(table.filter("id < 0"), Scratch(spark, "test"), "n").count() == 0


def test_names_that_clash(spark, table):
    assert fresh_name(table, "uid") == "uid_" and fresh_name(table, "UID") == "UID_" and fresh_name(table, "x") == "x"
    assert {r.uid for r in numbered(table, Scratch(spark, "test"), fresh_name(table, "uid")).collect()} == {7}


def test_a_cluster_needs_a_shared_folder(spark):
    class Far:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_folder(Far)


def test_files_that_are_scanned_twice(spark, table, tmp_path):
    """Each reading of a file's row is a row of its own, with a number of its own."""
    path = tmp_path / "odd name%é" / "t.parquet"
    for df in (spark.read.parquet(str(path), str(path)), spark.read.parquet(str(path), str(next(path.glob("part*.parquet"))))):
        assert scans_parquet(df) and not runtime.numberable(df)
        made = numbered(df, Scratch(spark, "test"), "row_number")
        assert made.select("row_number").distinct().count() == df.count() > 1000
        assert sorted(made.collect()) == sorted(made.collect())
    assert runtime.numberable(table) and runtime.numberable(table.filter("id < 5").select("id"))


@pytest.mark.parametrize("name", ["_metadata", "_METADATA", "a.b", "a`b"])
def test_odd_names(spark, tmp_path, name):
    df = spark.range(50).select("id", F.col("id").alias(name))
    df.repartition(3).write.parquet(str(tmp_path / "t"))
    for t in (spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "t")).select("id")):
        made = numbered(t, Scratch(spark, "test"), "row_number")
        assert made.columns == [*t.columns, "row_number"] and made.select("row_number").distinct().count() == 50
        assert all(r[0] == r[-2] for r in made.collect())
