"""Line de-duplication by pairwise alignment.

A run is the shortest stretch of lines, from a line forwards or backwards, that
has ``min_words`` words; any block that two documents share and that has as many
words is made of runs they share. Runs are known by a 128-bit hash of their
normalised lines and by how often the document has had them before, so that each
occurs once in a document. Two documents overlap if they share a run: each later
document is paired with the first that holds the run, rare or common. (A limit
on how common a run may be would lose the copies in large groups; pairing with
the first holder only keeps the pairs below the number of runs.) Each pair is
aligned by patience sorting: the longest chain of shared runs in the order of
both documents. Lines of the chain are deleted from the later document.

First holders come from a map-side aggregate. Occurrences are joined with them as
tables, so adaptive execution can split a run that a third of all rows share.
What one document shares is at most its own runs, and goes to one task.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.ordering import ordered
from noteloom.llm.word_ids import batches_by_size
from noteloom.runtime import Scratch, numbered, ship

MIN_WORDS = 5


def runs_of(text: str | None, min_words: int = MIN_WORDS) -> list[tuple[bytes, int, int]]:
    """(key, first line, last line) of each run of a text, in order of its first line. Lines without words are skipped over."""
    lines, counts, at = [], [], []
    for i, line in enumerate((text or "").split("\n")):
        words = line.split()
        if words:
            lines.append(" ".join(words))
            counts.append(len(words))
            at.append(i)
    spans = set()
    n = len(lines)
    end = total = 0
    for start in range(n):  # forwards
        if end < start:
            end, total = start, 0
        while end < n and total < min_words:
            total += counts[end]
            end += 1
        if total < min_words:
            break
        spans.add((start, end))
        total -= counts[start]
    start, total = n, 0
    for end in range(n, 0, -1):  # backwards
        if start > end:
            start, total = end, 0
        while start > 0 and total < min_words:
            start -= 1
            total += counts[start]
        if total < min_words:
            break
        spans.add((start, end))
        total -= counts[end - 1]
    seen: dict[bytes, int] = {}
    out = []
    for a, b in sorted(spans):
        content = xxhash.xxh3_128_digest("\n".join(lines[a:b]))
        k = seen[content] = seen.get(content, -1) + 1
        out.append((xxhash.xxh3_128_digest(content + k.to_bytes(8, "little")) if k else content, at[a], at[b - 1]))
    return out


def chain(pairs: list[tuple[int, int]]) -> list[int]:
    """Positions of the longest chain of ``pairs`` that rises strictly in both, by patience sorting; ``pairs`` rise in the first."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    # of equal first places the larger second comes first, so that one of them joins a chain at most
    order = sorted(range(len(pairs)), key=lambda i: (pairs[i][0], -pairs[i][1]))
    for i in order:
        k = bisect_left(tops, pairs[i][1])
        before.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(pairs[i][1])
            piles.append(len(before) - 1)
        else:
            tops[k], piles[k] = pairs[i][1], len(before) - 1
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(order[k])
        k = before[k]
    return out[::-1]


def aligned_lines(matches: list[tuple[int, int, int, int]]) -> list[int]:
    """Lines of a document that align with the documents it shares runs with. matches: (other, first, last, place in other)."""
    out: set[int] = set()
    for _, own in groupby(sorted(matches), key=lambda m: m[0]):
        rows = list(own)
        for forward in (True, False):
            # runs end at different lines if they start at one: chains by first lines, and by last lines
            pairs = [(r[1] if forward else r[2], r[3]) for r in rows]
            for i in chain(pairs):
                out.update(range(rows[i][1], rows[i][2] + 1))
    return sorted(out)


_RUNS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("lines", pa.int64())])


def lines_hash(text: str | None) -> int:
    """64-bit hash of the lines with words, the same for texts that align alike. It is only compared among holders of one run."""
    worded = (" ".join(line.split()) for line in (text or "").split("\n"))
    return int.from_bytes(xxhash.xxh3_64_digest("\n".join(x for x in worded if x)), "little", signed=True)


def _emit(min_words: int):
    def run(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            for group in batches_by_size(rows, lambda r: 64 + len(r[2] or "")):
                keys, uid, doc, first, last, lines = [], [], [], [], [], []
                for u, d, text in group:
                    same = lines_hash(text)
                    for key, a, b in runs_of(text, min_words):
                        keys.append(key)
                        uid.append(u)
                        doc.append(d)
                        first.append(a)
                        last.append(b)
                        lines.append(same)
                both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                cols = [np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]), uid, doc, first, last, lines]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RUNS)], schema=_RUNS)

    return run


def _align(batches):
    """Matches, sorted by uid, to (uid, lines to delete, [first, last] of the runs with lines that stay)."""
    waiting: list = []
    last = None

    def done():
        gone = aligned_lines(waiting)
        lines = set(gone)
        left = [[a, b] for a, b in sorted({(m[1], m[2]) for m in waiting}) if not lines.issuperset(range(a, b + 1))]
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([gone], pa.list_(pa.int32())), pa.array([left], pa.list_(pa.list_(pa.int32())))], names=["uid", "gone", "left"])

    for batch in batches:
        for uid, *match in zip(*(c.to_pylist() for c in batch.columns)):
            if uid != last:
                if waiting:
                    yield done()
                waiting, last = [], uid
            waiting.append(tuple(match))
    if waiting:
        yield done()


def _delete(batches):
    for batch in batches:
        texts, gone = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        out, counts = [], []
        for text, lines in zip(texts, gone):
            parts = None if text is None else text.split("\n")
            counts.append(len(parts or []))
            if lines:
                drop = set(lines)
                text = "\n".join(x for i, x in enumerate(parts) if i not in drop)
            out.append(text)
        cols = [batch.column(0), pa.array(out, pa.string()), pa.array(counts, pa.int64()), pa.array([len(x or []) for x in gone], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", "n_lines", "n_deleted"])


_ALIGNED = "uid long, gone array<int>, left array<array<int>>"


def _aligned(matches: DataFrame) -> DataFrame:
    return matches.repartition("uid").sortWithinPartitions("uid").mapInArrow(_align, _ALIGNED)


def further_lines(runs: DataFrame, gone: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(uid, lines to delete) from the alignments of what ``gone`` leaves over with its further earlier holders; None if nothing is left over.

    A round takes the next holders of each left run, up to four times as far down
    the run's list, and only for lines that no round before has placed. At worst, where
    no two holders of a line have its surroundings in common, the rounds come to as
    many pairs as the line has open rows and holders. Both arguments are written tables.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("uid").alias("uid"))
    left = gone.select("uid", "gone", F.explode("left").alias("run")).select("uid", F.col("run")[0].alias("first"), F.col("run")[1].alias("last"), "gone")
    need = F.array_except(F.sequence("first", "last"), "gone")
    open_runs = scratch.write(left.join(runs, ["uid", "first", "last"]).select("uid", "k1", "k2", place.alias("own"), need.alias("need")), "open0")
    if open_runs.isEmpty():
        return None
    # of holders with the same lines the earliest; numbered by place, the first holder (tried already) is 1
    held = runs.join(open_runs.select("k1", "k2").distinct(), ["k1", "k2"]).groupBy("k1", "k2", "lines").agg(F.min(place).alias("at"))
    # by ranges and prefix sums, as one run may have a third of all rows as holders
    held = ordered(scratch.write(held.select(F.struct("k1", "k2").alias("run"), "at"), "holding"), "run", ["at"], scratch, "holding")
    held = scratch.write(held.select("run.k1", "run.k2", "at", (F.col("idx") + 1).alias("number")), "held")
    most = held.agg(F.max("number").alias("n")).first().n
    found, start = [], 2
    while start <= most and not open_runs.isEmpty():
        next_ones = held.filter(F.col("number").between(start, 4 * start - 1))
        pairs = open_runs.join(next_ones, ["k1", "k2"]).filter("at < own").select("uid", F.col("at.uid").alias("other")).distinct()
        pairs = scratch.write(pairs, f"pairs{start}")
        own = pairs.join(runs.select("uid", "k1", "k2", "first", "last"), "uid")
        there = runs.select(F.col("uid").alias("other"), "k1", "k2", F.col("first").alias("there"))
        met = own.join(there, ["other", "k1", "k2"]).select("uid", "other", "first", "last", "there")
        more = scratch.write(_aligned(met).select("uid", F.col("gone").alias("more")), f"more{start}")
        found.append(more)
        rest = open_runs.join(more, "uid", "left").withColumn("need", F.array_except("need", F.coalesce("more", F.array().cast("array<int>"))))
        open_runs = scratch.write(rest.filter(F.size("need") > 0).drop("more"), f"open{start}")
        start *= 4
    if not found:
        return None
    return reduce(DataFrame.unionByName, found).groupBy("uid").agg(F.flatten(F.collect_list("more")).alias("more"))


def delete_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, every: bool = False) -> DataFrame:
    """Delete, from each document, the lines of blocks that align with an earlier one (a smaller id).

    ``every`` aligns each document with every earlier one that it shares a run
    with; without it, only with the first holders of its runs.

    Returns one row per row of ``docs``: doc_id, text (what is left, lines and
    white space as they were; null stays null), n_lines, n_deleted. Lines are
    equal if their words are. A null id is later than all others; of rows that
    share an id, the one read first is earlier. With ``every``, a copy of an
    earlier document ends up with what lines it has without words (and lines that
    no run holds). Texts are read whole, however long. An empty table gives an empty
    result. Columns other than those named aren't read, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "lines")
    rows = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), scratch)
    runs = rows.select("uid", "doc_id", "text").mapInArrow(_emit(min_words), "k1 long, k2 long, uid long, doc_id long, first int, last int, lines long")
    runs = scratch.write(runs, "runs")  # read more than once from here on
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid", "first", "last")
    holders = runs.groupBy("k1", "k2").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    holders = scratch.write(holders.select("k1", "k2", F.col("at.uid").alias("other"), F.col("at.first").alias("there")), "holders")
    # both joins sort and merge at every size: a broadcast would do for small inputs only
    met = runs.join(holders.hint("merge"), ["k1", "k2"]).filter("uid <> other").select("uid", "other", "first", "last", "there")
    gone = scratch.write(_aligned(met), "gone")
    more = further_lines(runs, gone, scratch) if every else None
    if more is not None:
        gone = gone.join(more, "uid", "left").withColumn("gone", F.array_union("gone", F.coalesce("more", F.array().cast("array<int>"))))
    return rows.join(gone.hint("merge"), "uid", "left").select("doc_id", "text", "gone").mapInArrow(_delete, "doc_id long, text string, n_lines long, n_deleted long")
