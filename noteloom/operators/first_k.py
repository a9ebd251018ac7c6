"""The first k rows of each group, by a bounded buffer in every task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.runtime import fresh_name, quoted, ship

#: Rows that a task holds before it passes them on, so that many groups don't fill it.
MOST_HELD = 100_000


def first_of(rows: pa.Table, group: str, key: str, k: int) -> pa.Table:
    """The first k rows of each group of an Arrow table, by key, nulls first."""
    order = pc.sort_indices(rows, sort_keys=[(group, "ascending"), (key, "ascending")], null_placement="at_start")
    codes = rows.column(group).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)[order.to_numpy()]
    begins = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1)) if len(codes) else np.zeros(0, np.int64)
    place = np.arange(len(codes)) - np.repeat(begins, np.diff(begins, append=len(codes)))
    return rows.take(order.filter(pa.array(place < k)))


def first_k(df: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """The first ``k`` rows of each group by ``key``, nulls first; all columns. Ties in ``key`` are cut anywhere, so give one that has none.

    A task keeps the first k rows of each group that it has met, in Arrow tables, and
    passes on no others: what is shuffled is at most k rows a group and task (or
    buffer, with very many groups), and no window sorts a group. group and key:
    strings, integers, dates or times; a null group is a group. ``k`` of 0 or less and
    empty tables give no rows.
    """
    if k < 1:
        return df.limit(0)
    ship(df.sparkSession)
    g, o, rank = (fresh_name(df, x) for x in ("__group", "__order", "__rank"))
    keyed = df.select("*", F.col(quoted(group)).alias(g), F.col(quoted(key)).alias(o))

    def partial(batches):
        held: list[pa.RecordBatch] = []
        n, least = 0, 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= max(4 * least, MOST_HELD // 4):
                kept = first_of(pa.Table.from_batches(held), g, o, k)
                if kept.num_rows > MOST_HELD:
                    yield from kept.to_batches()
                    kept = kept.slice(0, 0)
                held, n = kept.to_batches(), kept.num_rows
                least = n
        if held:
            yield from first_of(pa.Table.from_batches(held), g, o, k).to_batches()

    plain = keyed.toDF(*[f"c{i}" for i in range(len(keyed.columns))])  # names as Arrow reads them
    back = dict(zip(keyed.columns, plain.columns))
    few = _renamed(plain, partial, back, g, o)
    place = F.row_number().over(Window.partitionBy(back[g]).orderBy(back[o]))
    out = few.withColumn(rank, place).filter(F.col(rank) <= k)
    return out.select(*[F.col(back[c]).alias(c) for c in df.columns])


def _renamed(plain: DataFrame, partial, back: dict[str, str], g: str, o: str) -> DataFrame:
    """``partial`` over a frame with plain names."""

    def run(batches):
        names = {back[g]: g, back[o]: o}
        own = None

        def named():
            nonlocal own
            for b in batches:
                own = b.schema.names
                yield b.rename_columns([names.get(c, c) for c in own])

        for b in partial(named()):
            yield b.rename_columns(own)

    return plain.mapInArrow(run, plain.schema)
