"""When a run of ordered attempts stops: enough made, too many failures in a row, or too many attempts.

Attempts of a group are cut into blocks that are a range of the order each. A block
is summed up by its attempts, its successes, the failures it begins with, those it
ends with, and its longest run of failures; these sums compose, so what the blocks
before one leave behind is a window over blocks, not over attempts. The block in
which a group stops is found from its sums, and only that block is gone through
attempt by attempt. No task holds a group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.runtime import Scratch


@dataclass(frozen=True)
class StopRule:
    """in_row: failures in a row that end a group; attempts = factor x target + slack at most."""

    in_row: int = 25
    factor: int = 20
    slack: int = 30


#: Of attempts that cost nothing, and of those of a model.
OFFLINE, MODEL = StopRule(60, 50, 30), StopRule()


def runs_in(attempts: DataFrame, group: str, block: str, order: str, ok: str) -> DataFrame:
    """Each attempt with its place in its block (``at``, from 1), the successes up to it (``made``) and the failures in a row that it ends within the block (``row``)."""
    inside = Window.partitionBy(group, block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = attempts.withColumns({"at": F.row_number().over(Window.partitionBy(group, block).orderBy(order)), "made": F.sum(F.col(ok).cast("int")).over(inside)})
    last = F.max(F.when(F.col(ok), F.col("at"))).over(inside)
    return numbered.withColumn("row", F.col("at") - F.coalesce(last, F.lit(0)))


def block_sums(runs: DataFrame, group: str, block: str) -> DataFrame:
    """The sums of a block: n, made, lead, trail, longest (runs of failures)."""
    lead = F.max(F.when(F.col("made") == 0, F.col("at")))
    return runs.groupBy(group, block).agg(
        F.count(F.lit(1)).alias("n"), F.max("made").cast("long").alias("made"), F.coalesce(lead, F.lit(0)).cast("long").alias("lead"), F.max_by("row", "at").cast("long").alias("trail"), F.max("row").cast("long").alias("longest")
    )


def carried(sums: DataFrame, group: str, block: str) -> DataFrame:
    """Adds what the blocks before leave: attempts and successes (``n_before``, ``made_before``) and the failures that they end with (``open``)."""
    before = Window.partitionBy(group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    out = sums.withColumns({"n_before": F.coalesce(F.sum("n").over(before), zero), "made_before": F.coalesce(F.sum("made").over(before), zero)})
    # the last block with a success: where it ends, and how many failures it ends with; all attempts since are failures
    out = out.withColumn("mark", F.when(F.col("made") > 0, F.struct((F.col("n_before") + F.col("n")).alias("upto"), F.col("trail").alias("trail"))))
    mark = F.last("mark", ignorenulls=True).over(before)
    return out.withColumn("open", F.col("n_before") - F.coalesce(mark["upto"], zero) + F.coalesce(mark["trail"], zero)).drop("mark")


def stop_points(attempts: DataFrame, group: str, order: str, ok: str, block: Column, targets: DataFrame, rule: StopRule = MODEL) -> DataFrame:
    """Where each group stops: group, target, attempts, made, in_row (failures in a row at the end) and reason.

    attempts: a row each, of a group, in ``order``, which is unique in a group; ``ok``
    may be null, which is a failure. ``block`` must not fall as ``order`` rises.
    targets: (group, target). reason is ``made``, ``in_row``, ``attempts`` or, if the
    attempts given end before, ``open``. A target of 0 or less is made without an
    attempt; a group without attempts is ``open``; attempts of a group without a
    target aren't looked at. Groups are not null.
    """
    scratch = Scratch(attempts.sparkSession, "stops")
    rows = attempts.select(F.col(group).alias("grp"), F.col(order).alias("ord"), F.coalesce(F.col(ok), F.lit(False)).alias("ok"), block.alias("block"))
    runs = scratch.write(runs_in(rows, "grp", "block", "ord", "ok"), "runs")
    goals = targets.select(F.col(group).alias("grp"), F.col("target").cast("long").alias("target"))
    goals = goals.withColumn("most", F.col("target") * rule.factor + rule.slack)
    sums = carried(block_sums(runs, "grp", "block"), "grp", "block").join(goals, "grp")
    stops = (F.col("made_before") + F.col("made") >= F.col("target")) | (F.col("n_before") + F.col("n") >= F.col("most")) | (F.greatest(F.col("open") + F.col("lead"), F.col("longest")) >= rule.in_row)
    sums = scratch.write(sums.withColumn("stops", stops & (F.col("target") > 0)), "sums")
    where = scratch.write(sums.filter("stops").groupBy("grp").agg(F.min("block").alias("block")), "where")
    # attempt by attempt, in one block of each group
    here = runs.join(where, ["grp", "block"]).join(sums.select("grp", "block", "n_before", "made_before", "open", "target", "most"), ["grp", "block"])
    here = here.withColumns({"upto": F.col("n_before") + F.col("at"), "sofar": F.col("made_before") + F.col("made"), "failing": F.col("row") + F.when(F.col("made") == 0, F.col("open")).otherwise(0)})
    reason = F.when(F.col("sofar") >= F.col("target"), "made").when(F.col("failing") >= rule.in_row, "in_row").when(F.col("upto") >= F.col("most"), "attempts")
    first = here.withColumn("reason", reason).filter("reason IS NOT NULL").groupBy("grp").agg(F.min_by(F.struct("upto", "sofar", "failing", "reason"), "upto").alias("stop"))
    # groups that don't stop: what all their blocks come to
    ends = sums.groupBy("grp").agg(F.sum("n").alias("n"), F.sum("made").alias("all_made"), F.max_by(F.struct("n", "made", "trail", "open"), "block").alias("last"))
    trail = F.when(F.col("last.made") > 0, F.col("last.trail")).otherwise(F.col("last.open") + F.col("last.n"))
    zero = F.lit(0).cast("long")
    out = goals.join(first, "grp", "left").join(ends, "grp", "left")
    done = F.col("target") <= 0
    of = lambda name, other: F.when(done, zero).otherwise(F.coalesce(F.col(f"stop.{name}").cast("long"), other, zero))
    return out.select(
        F.col("grp").alias(group), "target", of("upto", F.col("n")).alias("attempts"), of("sofar", F.col("all_made")).alias("made"), of("failing", trail).alias("in_row"), F.when(done, "made").otherwise(F.coalesce("stop.reason", F.lit("open"))).alias("reason")
    )
