"""Whether splits share texts, as set operations over their normalised texts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.operators.rows import text_key
from noteloom.runtime import Scratch, quoted


def shared_texts(df: DataFrame, group: str, split: str, text: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Texts that two splits share: grp, a, b, key (of the text, case and outer white space aside), n (how often both have it).

    ``INTERSECT ALL`` of every two splits: a text that one split has three times and
    another twice is shared twice. Nulls are equal here: a null group is a group, and
    a null text counts as empty. Splits not named are left out; empty ones share
    nothing.
    """
    keys = _keys(df, group, split, text, splits)
    out = [_of(keys, a).intersectAll(_of(keys, b)).groupBy("grp", "key").agg(F.count(F.lit(1)).alias("n")).select("grp", F.lit(a).alias("a"), F.lit(b).alias("b"), "key", "n") for a, b in combinations(splits, 2)]
    return _all(out)


def split_overlap(df: DataFrame, group: str, split: str, text: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Counts by group for every two splits: grp, a, b, shared (rows of ``INTERSECT ALL``), only_a, only_b (of ``EXCEPT ALL``). Groups that neither has are absent."""
    keys = _keys(df, group, split, text, splits)
    out = []
    for a, b in combinations(splits, 2):
        sets = {"shared": _of(keys, a).intersectAll(_of(keys, b)), "only_a": _of(keys, a).exceptAll(_of(keys, b)), "only_b": _of(keys, b).exceptAll(_of(keys, a))}
        counted = _all([s.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).select("grp", F.lit(name).alias("what"), "n") for name, s in sets.items()])
        sums = [F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0).cast("long")).alias(name) for name in sets]
        out.append(counted.groupBy("grp").agg(*sums).select("grp", F.lit(a).alias("a"), F.lit(b).alias("b"), *sets))
    return _all(out)


def _keys(df: DataFrame, group: str, split: str, text: str, splits) -> DataFrame:
    """Written once, for all the set operations: keys, not texts."""
    keys = df.select(F.col(quoted(group)).cast("string").alias("grp"), F.col(quoted(split)).alias("split"), text_key(F.col(quoted(text))).alias("key"))
    return Scratch(df.sparkSession, "splits").write(keys.filter(F.col("split").isin(*splits)), "keys")


def _of(keys: DataFrame, split: str) -> DataFrame:
    return keys.filter(F.col("split") == split).select("grp", "key")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
