"""The same scores on a stream of drafts: pass rates in tumbling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.plans.scoring import RATES, example_scores


def window_rates(drafts: DataFrame, ts: str = "ts", size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rates by window and stratum of a (streaming) table of drafts with an event time; later rows than ``late`` are dropped."""
    scores = example_scores(drafts.withWatermark(ts, late))
    rates = [F.avg(F.col(c).cast("int")).alias(c) for c in (*RATES, "passed")]
    return scores.groupBy(F.window(ts, size), "stratum").agg(F.count(F.lit(1)).alias("n"), *rates)
