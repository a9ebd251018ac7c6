"""Places of rows in groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.runtime import Scratch, fresh_name

#: Rows of a range, about.
RANGE_ROWS = 20_000


def ordered(rows: DataFrame, group: str, by: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with ``idx`` (place in its group by ``by``, from 0) and ``n`` (size of the group), where a group may be any share of the rows.

    ``rows`` is a written table without columns piece_of, piece, before, idx and n; a null group is a group.
    """
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    part, at, first, count = (fresh_name(rows, x) for x in ("__range", "__at", "__first", "__rows"))
    dealt = rows.repartitionByRange(ranges, group, *by).sortWithinPartitions(group, *by)
    placed = scratch.write(dealt.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(at)), f"{name}_ranges")
    pieces = placed.groupBy(F.col(group).alias("piece_of"), F.col(part).alias("piece")).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(count))
    before = Window.partitionBy("piece_of").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = [F.coalesce(F.sum(count).over(before), F.lit(0).cast("long")).alias("before"), F.sum(count).over(Window.partitionBy("piece_of")).alias("n")]
    pieces = scratch.write(pieces.select("piece_of", "piece", first, *sums), f"{name}_pieces")
    joined = placed.join(pieces, F.col(group).eqNullSafe(F.col("piece_of")) & (F.col(part) == F.col("piece")))
    return joined.select(*rows.columns, (F.col("before") + F.col(at) - F.col(first)).alias("idx"), "n")
