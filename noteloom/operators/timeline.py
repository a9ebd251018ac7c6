"""Joins along a line: the last row at or before another one, and rows whose intervals overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.runtime import Scratch, quoted


def as_of(left: DataFrame, right: DataFrame, on: list[str], ts: str, carry: dict[str, str], tie: str | None = None) -> DataFrame:
    """Each row of ``left`` with columns of the last row of ``right`` at or before it, among rows with equal ``on``.

    carry: columns of ``right``, old name to new, which no column of ``left`` may have;
    null where there is no such row. Of rows of ``right`` at one time the one with the
    largest ``tie`` counts (any one without it). Rows with a null key or time stay and
    match nothing. Repeated rows of ``left`` stay. Empty tables are fine.

    Both sides are put in order by ranges of (keys, time), which cut a key with many
    rows into many ranges; within a range the last row is carried along, and what a
    range begins with comes from a window over ranges. No window holds a key.
    """
    scratch = Scratch(left.sparkSession, "as_of")
    keys = [f"k{i}" for i in range(len(on))]
    place = [*[F.col(quoted(c)).alias(k) for c, k in zip(on, keys)], F.col(quoted(ts)).alias("t")]
    got = F.struct(*[F.col(quoted(a)).alias(f"c{i}") for i, a in enumerate(carry)])
    order = F.col(quoted(tie)) if tie else F.lit(0)
    a = left.select(*place, F.lit(1).alias("side"), F.struct(*[F.col(quoted(c)) for c in left.columns]).alias("own"))
    b = right.select(*place, F.lit(0).alias("side"), order.alias("tie"), got.alias("got")).filter(" AND ".join(f"{k} IS NOT NULL" for k in [*keys, "t"]))
    both = a.unionByName(b, allowMissingColumns=True)
    ranged = scratch.write(both.repartitionByRange(*keys, "t").select("*", F.spark_partition_id().alias("range")), "ranged")
    inside = Window.partitionBy(*keys, "range").orderBy("t", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    ends = ranged.groupBy(*keys, "range").agg(F.max_by(F.when(F.col("side") == 0, F.col("got")), F.when(F.col("side") == 0, F.struct("t", "tie"))).alias("last"))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col("range").alias("b_range"), F.last("last", ignorenulls=True).over(before).alias("begin"))
    carried = ranged.withColumn("here", F.last("got", ignorenulls=True).over(inside)).filter("side = 1")
    same = F.col("range") == F.col("b_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    known = F.lit(True)
    for k in [*keys, "t"]:
        known = known & F.col(k).isNotNull()
    out = carried.join(begins, same, "left").withColumn("found", F.when(known, F.coalesce("here", "begin")))
    return out.select("own.*", *[F.col(f"found.c{i}").alias(new) for i, new in enumerate(carry.values())])


def overlaps(
    left: DataFrame, right: DataFrame, spans: tuple[Column, Column, Column, Column], width: int, carry: dict[str, str], carry_right: dict[str, str], on: list[str] = ()
) -> DataFrame:
    """Pairs of rows whose intervals, ends included, have a point in common, and that agree in ``on``.

    spans: start and end on the left, start and end on the right, as integers (times
    in microseconds, say). carry, carry_right: columns to return, old name to new, all
    new names apart. Intervals with a null or with their end before their start
    overlap nothing; null keys agree with nothing. Repeated rows give a row each.

    The line is cut into bins of ``width``; an interval goes to each of its bins, and a
    pair that meets in several counts in the first of them. So rows are joined on
    equal bins, never by comparing all with all. A width near the length of the longer
    intervals is best: an interval makes (length / width) + 1 rows.
    """

    def binned(df: DataFrame, start: Column, end: Column, own: dict[str, str], s: str) -> DataFrame:
        df = df.select(start.cast("long").alias(f"{s}_start"), end.cast("long").alias(f"{s}_end"), *[F.col(quoted(c)).alias(f"on{i}") for i, c in enumerate(on)], *[F.col(quoted(a)).alias(b) for a, b in own.items()])
        df = df.filter(f"{s}_start <= {s}_end").withColumn(f"{s}_first", F.floor(F.col(f"{s}_start") / F.lit(width)))
        return df.withColumn("bin", F.explode(F.sequence(f"{s}_first", F.floor(F.col(f"{s}_end") / F.lit(width)))))

    a, b = binned(left, spans[0], spans[1], carry, "a"), binned(right, spans[2], spans[3], carry_right, "b")
    met = a.join(b, [*[f"on{i}" for i in range(len(on))], "bin"])
    met = met.filter("a_start <= b_end AND b_start <= a_end AND bin = greatest(a_first, b_first)")
    return met.select(*carry.values(), *carry_right.values())
