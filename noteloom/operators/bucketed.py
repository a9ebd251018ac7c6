"""Exact look-ups of long texts in tables that are bucketed once, so that no later look-up shuffles a text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.runtime import Scratch, fresh_name, quoted

KEY = "lookup_key"


def key_of(text: Column) -> Column:
    """128 bits of a text, null of null."""
    return F.unhex(F.md5(text.cast("binary")))


class Bucketed:
    """A table in ``buckets`` buckets by the key of one of its columns, each sorted by it. Its rows are shuffled when it is written, never after.

    The table lies in the shared folder and is known to this session's catalogue;
    tables with equal ``buckets`` are joined bucket by bucket.
    """

    def __init__(self, df: DataFrame, text: str, buckets: int):
        if KEY in df.columns:
            raise ValueError(f"there is a column {KEY!r} already")
        self.spark, self.text, self.buckets = df.sparkSession, text, buckets
        self.name = f"noteloom_{uuid.uuid4().hex}"
        path = Scratch(self.spark, "bucketed").path
        keyed = df.withColumn(KEY, key_of(F.col(quoted(text)))).repartition(buckets, KEY)  # a file for each bucket
        keyed.write.bucketBy(buckets, KEY).sortBy(KEY).option("path", path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)


def answers(pairs: DataFrame, text: str, value: str, order: list[str], buckets: int) -> Bucketed:
    """Pairs (text, value) as a bucketed table: of equal texts the last by ``order``. The texts are shuffled here, once."""
    return Bucketed(pairs.groupBy(text).agg(F.max_by(value, F.struct(*order)).alias(value)), text, buckets)


def look_up(asked: Bucketed, known: Bucketed, value: str) -> DataFrame:
    """The rows of ``asked`` with ``value`` of the equal text in ``known``; null without one, or if the text is null.

    Buckets are joined side by side (a merge without an exchange); the texts
    themselves are compared after, so that equal keys of unlike texts don't match.
    """
    if asked.buckets != known.buckets:
        raise ValueError("tables with unequal numbers of buckets would be shuffled")
    a = asked.read()
    other, found = fresh_name(a, "__text"), fresh_name(a, value)
    b = known.read().select(KEY, F.col(quoted(known.text)).alias(other), F.col(quoted(value)).alias(found)).hint("merge")
    both = a.join(b, KEY, "left")
    right = F.when(F.col(quoted(asked.text)) == F.col(other), F.col(found))
    return both.select(*[F.col(quoted(c)) for c in a.columns if c not in (KEY, value)], right.alias(value))
