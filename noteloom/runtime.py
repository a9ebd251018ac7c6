"""Session helpers shared by the whole library: code shipping and scratch tables."""

from __future__ import annotations

import atexit
import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_scratch: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application.

    Workers that already find the package on their path lose nothing; others
    (a driver started from another folder, a cluster without a shared home)
    need it to load the functions of Arrow operators.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="noteloom-")) / "noteloom_code.zip"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("noteloom") / p.relative_to(root)))
    target.write_bytes(data.getvalue())
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir, or one of our own if that is unset and executors run in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="noteloom-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return qualified(spark, found.rstrip("/"))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system, as Spark understands it: without one, that of fs.defaultFS."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables that an operator writes to cut lineage and to survive lost executors.

    They live in one folder under :func:`shared_folder`. ``drop`` removes a table
    that nothing reads any more; what is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/noteloom-{name}-{uuid.uuid4().hex}"
        _scratch[self.path] = spark.sparkContext.applicationId

    def write(self, df: DataFrame, name: str) -> DataFrame:
        to = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, f"{self.path}/{name}")


@atexit.register
def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path, app in _scratch.items():
        try:
            if app == spark.sparkContext.applicationId:
                delete_path(spark, path)
        except Exception:  # the application may be gone already
            return


#: File names that may be broadcast, in characters.
MOST_NAMES = 32 << 20


def quoted(name: str) -> str:
    """A column's name as an expression reads it, whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parquet_relation(df: DataFrame):
    """The relation if ``df`` is rows and columns of one set of Parquet files, picked without chance; else None."""
    node = df._jdf.queryExecution().analyzed()
    if not node.deterministic():
        return None
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    if node.getClass().getSimpleName() != "LogicalRelation" or node.isStreaming():
        return None
    relation = node.relation()
    parquet = relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().getClass().getSimpleName() == "ParquetFileFormat"
    return relation if parquet else None


def scans_parquet(df: DataFrame) -> bool:
    return parquet_relation(df) is not None


def numberable(df: DataFrame) -> bool:
    """Whether a row's file and its place there tell it from all others: each file is scanned once, and no data column hides ``_metadata``."""
    relation = parquet_relation(df)
    if relation is None or "_metadata" in {c.lower() for c in (*df.columns, *relation.schema().fieldNames())}:
        return False
    scanned = list(relation.location().inputFiles())
    return len(set(scanned)) == len(scanned)


def numbered(df: DataFrame, scratch: Scratch, uid: str = "uid", name: str = "numbered", most_names: int = MOST_NAMES) -> DataFrame:
    """``df`` with a number for each row that stays the same in every job and every repeated task.

    A row of a Parquet scan is numbered by its file (of the sorted names, which are
    broadcast if they are within ``most_names``) and its place in it, however the
    scan is cut into tasks. The rows of any other plan, of more files, of files that
    are scanned more than once, or with a column ``_metadata`` of their own, are
    written once with their numbers, and that table is read from then on.
    """
    spark = df.sparkSession
    own = [F.col(quoted(c)) for c in df.columns]
    if numberable(df):
        files = sorted({re.sub(r"^([\w+.-]+):///", r"\1:/", f) for f in df.inputFiles()})  # as the scan spells them
        some = df.select("_metadata.file_path").first() if files and sum(map(len, files)) <= most_names else None
        if some is not None and some.file_path in files:
            file, row, number, path = (fresh_name(df, x) for x in ("__file", "__row", "__number", "__path"))
            names = spark.createDataFrame([(f, i) for i, f in enumerate(files)], f"{path} string, {number} long")
            placed = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)).join(F.broadcast(names), F.col(file) == F.col(path), "left")
            known = F.coalesce(F.shiftleft(F.col(number), 40), F.raise_error(F.lit("a file of the scan isn't among its files")).cast("long")) + F.col(row)
            return placed.select(*own, known.alias(uid))
    return scratch.write(df.withColumn(uid, F.monotonically_increasing_id()), name)
