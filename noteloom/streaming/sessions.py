"""Events by key as they come: sessions, visits with a state of their own, and streams that are run part by part.

All of these take a table or a stream. Rows without a time are left out; rows that
come later than ``late`` behind the newest time are dropped by Spark, and counted by
:class:`Parts`.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from noteloom.runtime import Scratch, quoted, ship


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str, measures: list[Column]) -> DataFrame:
    """A row for each session of a key, of rows that are at most ``gap`` apart: key, first, last, n and ``measures``.

    A streamed session comes out once the watermark has passed its end. Partial
    sessions are merged before the shuffle where Spark is told to
    (spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition).
    """
    k, t = quoted(key), F.col(quoted(ts))
    rows = events.filter(t.isNotNull()).withWatermark(ts, late)
    found = rows.groupBy(F.session_window(ts, gap).alias("session"), F.col(k)).agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count(F.lit(1)).alias("n"), *measures)
    return found.drop("session")


VISIT = "first long, last long, n long, outcome string"
#: A key's state: the open visit, and rows that the watermark hasn't passed yet.
_STATE = "first long, last long, n long, times array<long>, ids array<long>, ends array<boolean>"


def visits(events: DataFrame, key: str, ts: str, order: str, ends: Column, idle_seconds: int, late: str) -> DataFrame:
    """A row for each visit of a key (a stream's rows only): key, first and last (microseconds), n, outcome.

    A visit ends with a row for which ``ends`` holds (outcome ``done``), or when the
    key is idle for longer than ``idle_seconds`` (outcome ``idle``), found by a timeout
    in event time. Rows of a key count by (``ts``, ``order``), whatever order they come
    in: a row waits in the state until the watermark has passed it. So a state holds
    the rows of a key within ``late``, and those of one part.
    """
    ship(events.sparkSession)
    idle = idle_seconds * 1_000_000
    field = events.schema[key]
    rows = events.filter(F.col(quoted(ts)).isNotNull()).withWatermark(ts, late)
    rows = rows.select(F.col(quoted(key)), F.col(quoted(ts)), F.unix_micros(F.col(quoted(ts))).alias("t"), F.col(quoted(order)).cast("long").alias("i"), F.coalesce(ends, F.lit(False)).alias("e"))

    def step(of: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n, waiting = 0, 0, 0, []
        if state.exists:
            first, last, n, *lists = state.get
            waiting = list(zip(*lists))
        for f in frames:
            waiting += zip(f["t"].tolist(), f["i"].tolist(), f["e"].tolist())
        waiting.sort()
        passed = state.getCurrentWatermarkMs() * 1000
        out, done = [], 0
        for t, _, end in waiting:
            if t > passed:
                break
            done += 1
            if n and t - last > idle:
                out.append((*of, first, last, n, "idle"))
                n = 0
            first, last, n = t if n == 0 else first, t, n + 1
            if end:
                out.append((*of, first, last, n, "done"))
                n = 0
        waiting = waiting[done:]
        if n and passed >= last + idle:
            out.append((*of, first, last, n, "idle"))
            n = 0
        if n or waiting:
            times, ids, flags = (list(x) for x in zip(*waiting)) if waiting else ([], [], [])
            state.update((first, last, n, times, ids, flags))
            due = min(([last + idle] if n else []) + times[:1])
            state.setTimeoutTimestamp(max(due, passed) // 1000 + 1)
        else:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "first", "last", "n", "outcome"])

    return rows.groupBy(F.col(quoted(key))).applyInPandasWithState(step, f"{quoted(key)} {field.dataType.simpleString()}, {VISIT}", _STATE, "append", GroupStateTimeout.EventTimeTimeout)


class _Dropped(StreamingQueryListener):
    """Rows of one query that came too late."""

    def __init__(self) -> None:
        self.rows, self.ended = {}, threading.Event()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.rows[p.batchId] = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.set()


class Parts:
    """A stream that is run to the end of what there is each time a part of its rows comes, and started again from its checkpoint.

    ``build`` makes the streamed result from the streamed rows. Parts, checkpoint and
    result lie in the shared folder; a part's files make one batch.
    """

    def __init__(self, spark: SparkSession, schema, build: Callable[[DataFrame], DataFrame], name: str = "parts"):
        self.spark, self.scratch, self.late, self.part = spark, Scratch(spark, name), 0, 0
        self.schema, self.build = schema, build

    def add(self, rows: DataFrame) -> None:
        """Rows that come now."""
        path = self.scratch.path
        rows.write.mode("append").parquet(f"{path}/in/part={self.part}")
        self.part += 1
        fed = self.spark.readStream.schema(self.schema).parquet(f"{path}/in/part=*")
        heard = _Dropped()
        self.spark.streams.addListener(heard)
        try:
            made = self.build(fed).writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode("append")
            query = made.trigger(availableNow=True).start(f"{path}/out")
            query.awaitTermination()
            heard.ended.wait(60)
        finally:
            self.spark.streams.removeListener(heard)
        self.late += sum(heard.rows.values())

    def result(self) -> DataFrame:
        """What has come out so far."""
        return self.spark.read.schema(self.build(self.spark.readStream.schema(self.schema).parquet(f"{self.scratch.path}/in/part=*")).schema).parquet(f"{self.scratch.path}/out")


def run_in_parts(rows: DataFrame, ts: str, build: Callable[[DataFrame], DataFrame], parts: int, after: str, name: str = "parts") -> DataFrame:
    """The result of ``build`` after all ``rows`` came in ``parts`` by time, and then a row of nulls ``after`` the last one, which moves the watermark past all."""
    spark = rows.sparkSession
    stream = Parts(spark, rows.schema, build, name)
    t = F.col(quoted(ts))
    bounds = rows.agg(F.unix_micros(F.min(t)).alias("a"), F.unix_micros(F.max(t)).alias("b")).first()
    if bounds.a is None:
        stream.add(rows.limit(0))
        return stream.result()
    cuts = [bounds.a + (bounds.b - bounds.a) * k // parts for k in range(1, parts)]
    at = sum((F.when(F.unix_micros(t) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    for k in range(parts):
        stream.add(rows.filter(t.isNotNull() & (at == k)))
    end = spark.range(1).select(*[(F.timestamp_micros(F.lit(bounds.b)) + F.expr(f"INTERVAL {after}") if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
    stream.add(end)
    return stream.result()
