"""Operators on whole tables: duplicates, places in groups, splits, lookups, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions.notes import strip
from noteloom.rules import STRATA
from noteloom.runtime import fresh_name, quoted


def text_key(c: Column) -> Column:
    return F.sha1(F.lower(strip(F.coalesce(c, F.lit("")))))


def dedup_groups(df: DataFrame, text: str, order: str) -> DataFrame:
    """key, first (least ``order``), size of each group of rows with equal texts, case and outer white space aside."""
    return df.groupBy(text_key(F.col(text)).alias("key")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size"))


def dedup_first(df: DataFrame, text: str, order: str) -> DataFrame:
    """The first row of each such group; all columns. Groups come from a map-side aggregate, so a large one is no hot task."""
    name = fresh_name(df, "__first")
    first = dedup_groups(df, text, order).select(F.col("first").alias(name))
    return df.join(first, F.col(order) == F.col(name), "left_semi")


def hash_order(c: Column, seed: int) -> Column:
    return F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))


def placed(df: DataFrame, group: str, key: str, bucket: Column, place: str = "place", of: str = "of") -> DataFrame:
    """Adds ``place`` (from 1, by ``key``) and ``of``, the group's size, under names that no column may have.

    bucket must not fall as ``key`` rises. Rows are numbered within (group, bucket)
    and a prefix sum over the buckets' sizes is added, so that no task needs a
    whole group.
    """
    if fresh_name(df, place) != place or fresh_name(df, of) != of:
        raise ValueError(f"there is a column {place!r} or {of!r} already; give other names")
    own = [F.col(quoted(c)) for c in df.columns]
    cut, inside, group_, cut_, before_, n = (fresh_name(df, x) for x in ("__bucket", "__inside", "__group", "__b", "__before", "__n"))
    df = df.withColumn(cut, bucket)
    sizes = df.groupBy(group, cut).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(group).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col(group).alias(group_), F.col(cut).alias(cut_), F.coalesce(F.sum(n).over(before), F.lit(0).cast("long")).alias(before_), F.sum(n).over(Window.partitionBy(group)).alias(of)
    )
    numbered = df.withColumn(inside, F.row_number().over(Window.partitionBy(group, cut).orderBy(key)))
    joined = numbered.join(sizes, F.col(group).eqNullSafe(F.col(group_)) & (F.col(cut) == F.col(cut_)))
    return joined.select(*own, (F.col(before_) + F.col(inside)).alias(place), F.col(of))


def stratified_split(df: DataFrame, stratum: str, id_col: str, val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds ``split``: of each stratum, in hash order, first test, then val, then train. All other columns stay.

    With n rows: of 3 or more, test and val get their share, rounded half to even, 1 at least; of 2, one is test.
    """
    names = [c for c in df.columns if c != "split"]
    h, key, place, of = (fresh_name(df, x) for x in ("__h", "__key", "__place", "__of"))
    df = df.withColumn(h, hash_order(F.col(id_col), seed))
    df = df.withColumn(key, F.struct(h, id_col))
    df = placed(df, stratum, key, F.substring(h, 1, 3), place, of)
    n, at = F.col(of), F.col(place)
    share = lambda f: F.greatest(F.lit(1), F.bround(n * F.lit(f))).cast("long")
    n_test = F.when(n >= 3, share(test)).when(n == 2, 1).otherwise(0)
    n_val = F.when(n >= 3, share(val)).otherwise(0)
    split = F.when(at <= n_test, "test").when(at <= n_test + n_val, "val").otherwise("train")
    return df.select(*[F.col(f"`{c}`") for c in names], split.alias("split"))


def coverage(df: DataFrame, stratum: str, expected=STRATA) -> DataFrame:
    """Rows of each expected stratum, 0 for those without."""
    names = df.sparkSession.createDataFrame([(s,) for s in expected], "stratum string")
    counts = df.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "stratum", "left").select("stratum", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def plan_scale(plan: DataFrame, count: int, total: int) -> DataFrame:
    """A plan (stratum, n) scaled to about ``count`` records in all, 1 at least for each stratum."""
    return plan.withColumn("n", F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(count / total))).cast("long"))


def even_plan(count: int, strata=STRATA) -> dict[str, int]:
    """About ``count`` records in all: as many for each stratum, rounded half to even, 1 at least."""
    return {s: max(1, round(count / len(strata))) for s in strata}


def even_plan_rows(strata: DataFrame, stratum: str, count: int) -> DataFrame:
    """:func:`even_plan` as a table (stratum, n), for the strata that a table has (null is none)."""
    names = strata.select(F.col(quoted(stratum)).alias("stratum")).filter("stratum IS NOT NULL").distinct()
    return names.withColumn("n", F.lit(max(1, round(count / max(1, names.count())))).cast("long"))


def lookup_last(inputs: DataFrame, pairs: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Exact-input lookup: adds ``value`` for ``key``; of pairs with one key, the last by ``order``; null if there is none."""
    last = pairs.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))
    return inputs.join(last, key, "left")
