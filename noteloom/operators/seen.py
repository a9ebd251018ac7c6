"""Duplicates across runs: a kept table of the keys that earlier runs let pass.

A run is told from others by its number. Its rows are freed of duplicates among
themselves, and of those whose key a run with a lower number has kept; the keys of
the rest are written as the run's own part of the table. A run that is repeated
writes the same part again, so nothing changes.

Before the exact comparison stands a Bloom filter, kept beside the keys as a table
of 64-bit words: a key sets three bits of one word. Only keys whose bits are all set
go on to the anti join with the keys themselves, which is narrowed to those words;
most new rows never meet the table of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.operators.rows import text_key
from noteloom.runtime import Scratch, delete_path, fresh_name, qualified

#: Keys for each word of the filter: 10 bits or so for a key.
KEYS_A_WORD = 6


def word_of(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words))


def bits_of(key: Column) -> Column:
    """Three of 64 bits, of a hash that is apart from the word's."""
    h = F.xxhash64(F.lit("bits"), key)
    # shiftleft by a column, which the function of that name doesn't take
    one = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(3)]
    return one[0].bitwiseOR(one[1]).bitwiseOR(one[2])


class SeenKeys:
    """The kept table under ``path``: keys/run=N and bloom/run=N. ``expected``: keys it is made for; with more the filter is weaker, never wrong."""

    def __init__(self, spark: SparkSession, path: str, expected: int = 1_000_000):
        self.spark, self.path = spark, qualified(spark, path.rstrip("/"))
        self.words = max(1, expected // KEYS_A_WORD)

    def _runs(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/keys")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        # a part counts once it is whole
        return sorted(int(n[4:]) for n in names if n.startswith("run=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/bloom/{n}/_SUCCESS")))

    def _read(self, what: str, runs: list[int], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{what}/run={r}" for r in runs])

    def new_rows(self, df: DataFrame, run: int, text: str, order: str) -> DataFrame:
        """The rows of run ``run`` that no run with a lower number has kept, the first by ``order`` of each text; all columns.

        Texts are equal as in ``rows.text_key``: case and outer white space aside, null
        as empty. Of rows equal in text and order too, each stays. The rows come from
        a written table; the run's keys are kept when this returns. An empty run keeps
        an empty part.
        """
        scratch = Scratch(self.spark, "seen")
        key, first = fresh_name(df, "__seen_key"), fresh_name(df, "__seen_first")
        keyed = df.withColumn(key, F.unhex(text_key(F.col(text))))
        firsts = scratch.write(keyed.groupBy(F.col(key).alias("key")).agg(F.min(order).alias("first")), "firsts")  # a map-side aggregate
        earlier = [r for r in self._runs() if r < run]
        fresh = firsts
        if earlier:
            bloom = self._read("bloom", earlier, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
            asked = firsts.withColumns({"word": word_of(F.col("key"), self.words), "mine": bits_of(F.col("key"))}).join(bloom, "word", "left")
            asked = scratch.write(asked.select("key", "first", F.coalesce(F.col("bits").bitwiseAND(F.col("mine")) == F.col("mine"), F.lit(False)).alias("maybe")), "asked")
            known = self._read("keys", earlier, "key binary").join(asked.filter("maybe").select("key"), "key", "left_semi")
            fresh = scratch.write(asked.filter("NOT maybe").select("key", "first").unionByName(asked.filter("maybe").join(known, "key", "left_anti").select("key", "first")), "fresh")
        part = f"run={run}"
        delete_path(self.spark, f"{self.path}/bloom/{part}")
        fresh.select("key").write.mode("overwrite").parquet(f"{self.path}/keys/{part}")
        fresh.groupBy(word_of(F.col("key"), self.words).alias("word")).agg(F.bit_or(bits_of(F.col("key"))).alias("bits")).write.mode("overwrite").parquet(f"{self.path}/bloom/{part}")
        kept = fresh.select(F.col("key").alias(key), F.col("first").alias(first))
        return keyed.join(kept, [key]).filter(F.col(order) == F.col(first)).select(*[keyed[f"`{c}`"] for c in df.columns])
