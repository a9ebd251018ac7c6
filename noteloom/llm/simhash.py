"""SimHash near-duplicates by vantage-point trees.

Distinct fingerprints are dealt to shards by a tree of vantage points: a node
sends those nearer to its vantage point than its threshold left, the rest right.
By the triangle inequality, two fingerprints on different sides of a node lie
within ``radius`` of each other only if both lie within ``radius`` of its
threshold; those just left of it therefore visit the right side too, and go on
as visitors wherever a match may be. Each shard goes on the same way in memory
until few are left, and compares those. So every linked pair meets, exactly.

The tree is built from a bounded sample (a documented parameter), which decides
where shards begin and end, not what is found. Shards grow as the square root of
the number of fingerprints. A shard returns links that span what it has joined,
no more than its rows, so groups of thousands don't become pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.components import components
from noteloom.runtime import Scratch, fresh_name, numbered, ship

WORDS = 3
RADIUS = 3
SAMPLE = 1 << 15
SEED = 42


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of the word shingles of a text with A-Z lower-cased; 0 for a text without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    n = len(tokens) - words + 1
    if n < 2:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    digest, seed = xxhash.xxh64_intdigest, SEED
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = tokens[at : min(at + (1 << 16), n) + words - 1]
        hashes = np.array([digest(b" ".join(s), seed) for s in zip(*(part[i:] for i in range(words)))], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(2)], "<u8").view("<i8")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], names=["uid", "doc_id", "fp"])


def distances(prints: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(prints ^ np.uint64(point)).astype(np.int16)


def choose(sample: np.ndarray, tries: int = 12):
    """A vantage point among the first of ``sample`` and the threshold nearest to halving it; None if none divides it."""
    best = None
    for v in sample[:tries]:
        d = distances(sample, v)
        for mu in {int(np.median(d)), int(np.median(d)) + 1}:
            left = int((d < mu).sum())
            near = int((np.abs(d - mu) <= RADIUS).sum())
            score = max(left, len(d) - left) + near / 2
            if 0 < left < len(d) and (best is None or score < best[0]):
                best = (score, int(v), mu)
    return best and best[1:]


def build(sample: np.ndarray, leaves: int):
    """Nested (point, threshold, left, right); a leaf is its number."""
    count = iter(range(1 << 30))

    def grow(part: np.ndarray, want: int):
        picked = choose(part) if want > 1 and len(part) >= 16 else None
        if picked is None:
            return next(count)
        left = distances(part, picked[0]) < picked[1]
        return (*picked, grow(part[left], want // 2), grow(part[~left], want - want // 2))

    return grow(sample, leaves)


def sides(d: np.ndarray, home: np.ndarray, mu: int, radius: int):
    """Which go left, which go right, and which of these are at home on the right."""
    left = np.where(home, d < mu, d - radius < mu)
    return left, d + radius >= mu, home & (d >= mu)


def route(tree, prints: np.ndarray, home: np.ndarray, radius: int = RADIUS):
    """(leaf, fingerprints, at home) for each leaf that any of ``prints`` lives in or visits."""
    if not len(prints):
        return
    if isinstance(tree, int):
        yield tree, prints, home
        return
    point, mu, below, above = tree
    left, right, stays = sides(distances(prints, point), home, mu, radius)
    yield from route(below, prints[left], home[left], radius)
    yield from route(above, prints[right], stays[right], radius)


class Joined:
    """Union-find over positions, many pairs at a time."""

    def __init__(self, n: int):
        self.p = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.p[a], self.p[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.p, np.maximum(x, y), np.minimum(x, y))
            while (up := self.p[self.p] != self.p).any():
                self.p[up] = self.p[self.p[up]]


def close_pairs(prints: np.ndarray, home: np.ndarray, radius: int = RADIUS, few: int = 384):
    """Yields positions (a, b) of all pairs within ``radius`` of which one at least is at home; by vantage points down to ``few``."""
    stack = [(np.arange(len(prints)), home)]
    while stack:
        at, own = stack.pop()
        members = at[own]
        if not len(members) or len(at) < 2:
            continue
        picked = choose(prints[members[:: max(1, len(members) // 256)]], 4) if len(members) > few else None
        if picked is not None:
            d = distances(prints[at], picked[0])
            left, right, stays = sides(d, own, picked[1], radius)
            if (stays.any() and (own & ~stays).any()) and left.sum() < len(at):
                stack += [(at[left], own[left]), (at[right], stays[right])]
                continue
        m = prints[members]
        step = max(1, (1 << 20) // len(m))
        for i in range(0, len(at), step):
            a, b = np.nonzero(np.bitwise_count(prints[at[i : i + step], None] ^ m[None, :]) <= radius)
            a, b = at[i + a], members[b]
            if len(a):
                yield a[a != b], b[a != b]


def _links(radius: int):
    def run(batches):
        waiting: list = []

        def found():
            leaf = np.concatenate([x[0] for x in waiting])
            fp = np.concatenate([x[1] for x in waiting])
            home = np.concatenate([x[2] for x in waiting])
            cuts = [0, *(np.flatnonzero(np.diff(leaf)) + 1), len(leaf)]
            for i, j in zip(cuts, cuts[1:]):
                prints, own = fp[i:j].view("<u8"), home[i:j]
                joined = Joined(j - i)
                for a, b in close_pairs(prints, own, radius):
                    joined.join(a, b)
                child = np.flatnonzero(joined.p != np.arange(j - i))
                if len(child):
                    yield pa.RecordBatch.from_arrays([pa.array(fp[i:j][joined.p[child]]), pa.array(fp[i:j][child])], names=["u", "v"])

        last = None
        for batch in batches:  # sorted by leaf: done with those before the last
            if not batch.num_rows:
                continue
            cols = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            if last is not None and cols[0][0] != last:
                yield from found()
                waiting.clear()
            if len(cut := np.flatnonzero(np.diff(cols[0]))):
                k = cut[-1] + 1
                waiting.append(tuple(c[:k] for c in cols))
                yield from found()
                waiting.clear()
                cols = tuple(c[k:] for c in cols)
            waiting.append(cols)
            last = cols[0][-1]
        if waiting:
            yield from found()

    return run


def near_links(prints: DataFrame, scratch: Scratch, radius: int = RADIUS, sample: int = SAMPLE) -> DataFrame:
    """Links (u, v) that span the fingerprints of ``prints`` (fp long, distinct, a written table) within ``radius``."""
    n = prints.count()
    leaves = max(1, 2 ** round(math.log2(max(1.0, math.sqrt(n) / 8))))
    size = min(sample, 64 * leaves)
    rows = prints.orderBy(F.xxhash64("fp")).limit(size).collect() if leaves > 1 else []
    tree = build(np.array([r.fp for r in rows], "<i8").view("<u8"), leaves)

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view("<u8")
            for leaf, part, home in route(tree, fp, np.ones(len(fp), bool), radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), leaf, np.int32)), pa.array(part.view("<i8")), pa.array(home)], names=["leaf", "fp", "home"])

    dealt = prints.select("fp").mapInArrow(deal, "leaf int, fp long, home boolean").repartition("leaf").sortWithinPartitions("leaf")
    return dealt.mapInArrow(_links(radius), "u long, v long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, uid_col: str | None = None) -> DataFrame:
    """Groups of rows whose fingerprints are linked, directly or through others.

    Returns one row per row of ``docs``: uid long (a number of the row, or what
    ``uid_col`` names), doc_id, fingerprint (16 hexadecimal digits), component_id (smallest id of its group),
    kept (whether it is the row of its group that stays: the one with that id).

    A null text counts as empty; texts without words have fingerprint zero and
    are linked like others. A null id sorts above all others. Of rows that share
    that id, one stays. Texts are read whole, however long, in slices of shingles.
    An empty table gives an empty result. Other columns, whatever their names, are
    not read.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "simhash")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(uid_col).alias("uid")] if uid_col else []))
    rows = (docs if uid_col else numbered(docs, scratch)).select("uid", "doc_id", "text")
    prints = scratch.write(rows.mapInArrow(_fingerprints, "uid long, doc_id long, fp long"), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")
    classes = scratch.write(prints.groupBy("fp").agg(first), "classes")
    linked = components(near_links(classes.select("fp"), scratch, radius), scratch)
    of_class = scratch.write(classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp")), "roots")
    groups = scratch.write(of_class.groupBy("root").agg(F.min("first").alias("least")), "groups")
    named = scratch.write(of_class.join(groups, "root").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.uid").alias("keep_uid")), "named")
    scratch.drop("classes", "roots", "groups")
    return prints.join(named, "fp").select("uid", "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", (F.col("uid") == F.col("keep_uid")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of :func:`near_groups`; all columns as they were, whatever their names."""
    scratch = Scratch(docs.sparkSession, "near")
    uid = fresh_name(docs, "__uid")
    rows = numbered(docs, scratch, uid)
    gone = near_groups(rows, id_col, text_col, uid_col=uid).filter("not kept").select(F.col("uid").alias(uid))
    return rows.join(gone, uid, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
