"""JSON lines: one record for each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of a file or folder; none if it isn't there. Blank lines are skipped, a bad line raises."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """One JSON object for each row, nulls and all; a folder of part files."""
    (df.write.partitionBy(*partition_by) if partition_by else df.write).mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_splits(df: DataFrame, path: str) -> DataFrame:
    """Write rows with a ``split`` as folders seed and by split; returns the counts."""
    write_jsonl(df.drop("split"), f"{path}/seed")
    write_jsonl(df, f"{path}/splits", ["split"])
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def load_split(spark: SparkSession, path: str, split: str, schema: T.StructType | str) -> DataFrame:
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    return read_jsonl(spark, f"{path}/splits/split={split}", schema)
