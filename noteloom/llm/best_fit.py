"""Best-fit packing by exact complements.

How token sequences are packed depends on their lengths only, and a sequence of
1024 tokens has 1024 of these. So tasks encode and count, a plan is made from the
counts (a number for each length, however large the corpus), and every piece finds
its place by its length and its rank among the pieces of that length, which is a
prefix sum over the tasks.

The plan goes through lengths from the longest down. The gap that a length leaves is
looked up among the sums of one, two and three lengths that are still there, and as
many sequences are filled exactly as the counts allow; what has no exact complement
is then placed by best fit, longest first, into the smallest gap that holds it. This
is done for several least lengths of the members of a pair or triple, since short
pieces are the fillers that best fit lives on, and the shortest plan is taken. One
entry of the plan stands for all sequences of one composition, so making it takes
the same time for a thousand documents and for 10^12.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteloom.llm.word_ids import GROUP, Table, batches_by_size, cache, cut_before_spaces, keyed_ids, library_encoder
from noteloom.runtime import Scratch, ship

TOKENS = 1024
#: Shares of a sequence from which on a piece may join a pair or triple that fills one; at a half only single complements do.
LEAST = (0, 1 / 16, 1 / 8, 3 / 16, 1 / 4, 1 / 2)


class Sums:
    """Which sums one, two and three of the lengths still there make, as counts of combinations by sum."""

    def __init__(self, left: np.ndarray):
        self.left, self.most = left, len(left) - 1
        self.there = np.zeros(len(left), np.int64)
        self.pairs = np.zeros(len(left), np.int64)
        self.triples = np.zeros(len(left), np.int64)
        for length in np.flatnonzero(left):
            self._turn(int(length), 1)

    def _turn(self, a: int, sign: int) -> None:
        """A length comes in (1) or goes (-1): so do the pairs and triples that hold it."""
        m = self.most
        if sign > 0:
            self.there[a] = 1
        else:  # a's own combinations are counted while it is there
            self.pairs[a:] -= self.there[: m + 1 - a]
            self.there[a] = 0
        if sign > 0:
            self.pairs[a:] += self.there[: m + 1 - a]
        others = self.pairs.copy()
        if sign > 0:
            others[a:] -= self.there[: m + 1 - a]
        # a with two others; twice a with another; three times a
        self.triples[a:] += sign * others[: m + 1 - a]
        if 2 * a <= m:
            without = self.there.copy()
            without[a] = 0
            self.triples[2 * a :] += sign * without[: m + 1 - 2 * a]
        if 3 * a <= m:
            self.triples[3 * a] += sign

    def use(self, lengths: dict[int, int], times: int) -> None:
        for a, k in lengths.items():
            self.left[a] -= k * times
            if not self.left[a]:
                self._turn(a, -1)

    def two(self, total: int, below: int, least: int):
        """Pairs (a, b), below >= a >= b >= least, with this sum, the longest a first."""
        if total < 2 * least or not self.pairs[total]:
            return
        a = np.arange(min(total - least, below), (total + 1) // 2 - 1, -1)
        for x in a[(self.there[a] > 0) & (self.there[total - a] > 0)].tolist():
            yield x, total - x

    def complements(self, gap: int, least: int):
        """Lengths that make the sum: one of any length; two, then three of at least ``least``; the longest first."""
        if gap < 1:
            return
        if self.there[gap]:
            yield (gap,)
        yield from self.two(gap, gap, least)
        if gap >= 3 * least and self.triples[gap]:
            a = np.arange(gap - 2 * least, (gap + 2) // 3 - 1, -1)
            for x in a[(self.there[a] > 0) & (self.pairs[gap - a] > 0)].tolist():
                for y, z in self.two(gap - x, x, least):
                    yield x, y, z


def exact_then_best(counts: dict[int, int], tokens: int, least: int) -> list[tuple[int, tuple[int, ...]]]:
    """Exact complements for lengths from the longest, then best fit for what is left."""
    left = np.zeros(tokens + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[int, tuple[int, ...]]] = []
    sums = Sums(left)
    if left[tokens]:
        plan.append((int(left[tokens]), (tokens,)))
        sums.use({tokens: 1}, int(left[tokens]))
    for length in range(tokens - 1, 0, -1):
        found = True
        while found and left[length]:
            found = False
            for others in sums.complements(tokens - length, least):
                need = Counter((length, *others))
                times = min(int(left[a]) // k for a, k in need.items())
                if times:
                    plan.append((times, tuple(sorted((length, *others), reverse=True))))
                    sums.use(need, times)
                    found = True
                    break
    return plan + best_fit({int(a): int(left[a]) for a in np.flatnonzero(left)}, tokens)


def plan_sequences(counts: dict[int, int], tokens: int = TOKENS) -> list[tuple[int, tuple[int, ...]]]:
    """(how many, lengths from the longest) of the sequences that hold pieces of these lengths (1 to ``tokens``), each once.

    Short pieces are worth most as fillers of best fit, where no exact sum is left, so
    a plan is made for each of the lengths from which pieces may join a pair or
    triple (``LEAST``), and that with the fewest sequences is taken.
    """
    best = None
    for least in LEAST:
        plan = exact_then_best(counts, tokens, max(1, int(least * tokens)))
        size = sum(times for times, _ in plan)
        if best is None or size < best[0]:
            best = size, plan
    return best[1]


def best_fit(counts: dict[int, int], tokens: int) -> list[tuple[int, tuple[int, ...]]]:
    """Longest first, each into the smallest gap that holds it, all pieces of a length at a time."""
    gaps: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for length in sorted(counts, reverse=True):
        n = counts[length]
        for gap in range(length, tokens):
            held = gaps.get(gap)
            while n and held:
                # as many of this length as a gap holds, as best fit returns to a gap until it is too small
                lengths, times = next(iter(held.items()))
                k = min(gap // length, n)
                use = min(times, n // k)
                if use == times:
                    del held[lengths]
                else:
                    held[lengths] -= use
                _put(gaps, gap - k * length, lengths + (length,) * k, use)
                n -= use * k
        k = tokens // length
        if n >= k:
            _put(gaps, tokens - k * length, (length,) * k, n // k)
        if n % k:
            _put(gaps, tokens - (n % k) * length, (length,) * (n % k), 1)
    return [(times, lengths) for gap in sorted(gaps) for lengths, times in gaps[gap].items()]


def _put(gaps: dict, gap: int, lengths: tuple[int, ...], times: int) -> None:
    gaps[gap][lengths] = gaps[gap].get(lengths, 0) + times


class Places:
    """Where the r-th piece of a length goes, by a plan: few intervals of ranks for each length."""

    def __init__(self, plan: list[tuple[int, tuple[int, ...]]]):
        rows, taken, sequence = [], Counter(), 0
        for times, lengths in plan:
            offset = 0
            for length, k in sorted(Counter(lengths).items(), reverse=True):
                rows.append((length, taken[length], sequence, offset, k))
                taken[length] += k * times
                offset += length * k
            sequence += times
        rows.sort()
        self.length, self.first, self.sequence, self.offset, self.each = (np.array(x, np.int64) for x in (zip(*rows) if rows else [[]] * 5))
        self.sequences = sequence
        # ranks are searched among intervals of all lengths at once: one axis, a length after the other
        self.base = np.zeros(int(self.length.max(initial=0)) + 2, np.int64)
        for length, n in taken.items():
            self.base[length + 1] = n
        self.base = np.cumsum(self.base)
        self.start = self.base[self.length] + self.first

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.start, self.base[length] + rank, side="right") - 1
        inside = rank - self.first[k]
        return self.sequence[k] + inside // self.each[k], self.offset[k] + inside % self.each[k] * length


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, at long"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in ddl.split(", ")])


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int, tokens: int, with_ids: bool) -> DataFrame:
    """Pieces of the encoded texts, each with its task and its place among the task's pieces of that length."""
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, whatever the corpus
    ddl = _PIECES + (", ids binary" if with_ids else "")
    arrow = _schema(ddl)

    def run(batches):
        data = vocabulary.value
        kept, encode = cache(("before spaces", zlib.crc32(data.encode())), lambda: (Table(), library_encoder(data)))
        end = np.array([end_id], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), [0] * (tokens + 1)
        for batch in batches:
            for group in batches_by_size(zip(*(c.to_pylist() for c in batch.columns)), lambda r: len(r[1] or ""), GROUP):
                rows: list[list] = [[] for _ in arrow]
                for (doc, _), ids in zip(group, keyed_ids([r[1] or "" for r in group], cut_before_spaces, encode, kept)):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % tokens or tokens, n + 1, tokens)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        part = ids[4 * a : 4 * b]
                        for to, x in zip(rows, (doc, piece, a, b - a, zlib.crc32(part), task, seen[b - a], part)):
                            to.append(x)
                        seen[b - a] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, arrow)], schema=arrow)

    return docs.mapInArrow(run, ddl)


def place_pieces(spark: SparkSession, pieces: DataFrame, scratch: Scratch, tokens: int) -> DataFrame:
    """Adds sequence_id and offset to written pieces (length, task, at)."""
    sizes = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    bases = scratch.write(sizes.select("length", "task", "n", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("before")), "bases")
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``tokens`` rows
    places = spark.sparkContext.broadcast(Places(plan_sequences(counts, tokens)))  # a few rows for each length
    ranked = pieces.join(bases.drop("n"), ["length", "task"]).select(*pieces.drop("task", "at").columns, (F.col("at") + F.col("before")).alias("rank"))
    out = [f for f in pieces.drop("task", "at").schema]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out).replace("bigint", "long") + ", sequence_id long, offset long"
    arrow = _schema(ddl)

    def run(batches):
        for batch in batches:
            sequence, offset = places.value.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            found = {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays([found.get(f.name) if f.name in found else batch.column(f.name) for f in arrow], schema=arrow)

    return ranked.mapInArrow(run, ddl)


def pack_whole(docs: DataFrame, tokenizer_path: str, end_id: int = 2, tokens: int = TOKENS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode texts, append ``end_id`` to each, and pack them whole into as few sequences as the method finds.

    Only documents of more than ``tokens`` ids are cut: into pieces of ``tokens``, of
    which the first may be shorter. Returns one row per piece: doc_id, piece, start
    (ids of its document before it), length, ids_crc32, sequence_id (from 0, without
    gaps), offset and, if asked, ids (little-endian unsigned 32-bit).

    A null text counts as empty and is a piece with the end id alone. Ids of
    documents may be null or repeat: every row is packed, copies too. Pieces of equal
    length are told apart by task and order. A text of any length is cut whole. An
    empty table gives an empty result. Columns other than those named aren't read,
    whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "best_fit")
    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = scratch.write(pieces_of(some, tokenizer_path, end_id, tokens, with_ids), "pieces")
    return place_pieces(spark, pieces, scratch, tokens)
