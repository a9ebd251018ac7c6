"""Near-duplicate vectors by epsilon grid order.

Vectors of length one lie within eps = sqrt(2 - 2 c) of each other exactly if
their cosine is c or more. They are put in the order of the grid cells (of side
eps) that hold them, on the leading principal dimensions. The sequence is cut
into intervals, each a file in the shared folder; two intervals, and recursively
the halves of two intervals, are joined unless they are provably further than eps
apart: by their bounding boxes, which rotation can't change and of which the
length left over beyond the leading dimensions is one more coordinate, or by their
centres and radii in all dimensions (the triangle bound). What is left is compared
in double precision, and exactly where rounding could decide.

Equal vectors are one class with a size, so copies cost nothing more. The
intervals' ends come from a bounded sample of cells, ties broken by a hash, and
decide only how the work is cut. Vectors are dealt out once, to their interval; a
task reads the files of the two intervals that it joins, so that nothing is sent
once for each pair. It returns counts for its vectors and links that span what it
has joined, never all pairs.

How much can be skipped depends on the vectors: most of it where they gather in
clusters, nothing where they are random directions in many dimensions, all of
which are about equally far from each other.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_right
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.components import components
from noteloom.llm.simhash import Joined
from noteloom.llm.token_files import _store
from noteloom.runtime import Scratch, numbered, ship

COSINE = 0.9
LEADING = 16
SAMPLE = 8192
LARGEST = 1 << 16
FEW = 128


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    scale = np.abs(x).max(1, keepdims=True)  # keeps squares of very small or large numbers finite
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal(sample: np.ndarray, leading: int) -> np.ndarray:
    """Orthonormal columns: the leading principal dimensions of the sample."""
    _, v = np.linalg.eigh(np.cov(sample.T) if len(sample) > 1 else np.eye(sample.shape[1]))
    return np.ascontiguousarray(v[:, ::-1][:, :leading])


def coordinates(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Leading coordinates and the length of the rest; distances between these never exceed those between vectors."""
    lead = x @ basis if basis.shape[0] == x.shape[1] else x[:, : basis.shape[1]]
    rest = np.sqrt(np.maximum(0, 1 - (lead * lead).sum(1, keepdims=True)))
    short = basis.shape[1] - lead.shape[1]
    return np.hstack([lead, np.zeros((len(x), max(0, short))), rest])


def apart(low_a, high_a, low_b, high_b, eps: float) -> bool:
    """Whether two boxes are provably further than eps apart."""
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float(gap @ gap) > eps * eps + 1e-9


def linked(a: np.ndarray, b: np.ndarray, cosine: float) -> bool:
    """Whether the cosine of two vectors is ``cosine`` or more, without rounding."""
    a, b = [Fraction(float(v)) for v in a], [Fraction(float(v)) for v in b]
    dot = lambda p, q: sum(x * y for x, y in zip(p, q))
    ab = dot(a, b)
    return ab > 0 and ab * ab >= Fraction(cosine) ** 2 * dot(a, a) * dot(b, b)


class Bounds:
    """Bounding box of the coordinates, centre and radius of a stretch of vectors."""

    def __init__(self, x: np.ndarray, coords: np.ndarray):
        self.low, self.high, self.centre = coords.min(0), coords.max(0), x.mean(0)
        away = x - self.centre
        self.radius = float(np.sqrt((away * away).sum(1).max()))

    def apart(self, other: "Bounds", eps: float) -> bool:
        """Whether two stretches are provably further than eps apart."""
        if apart(self.low, self.high, other.low, other.high, eps):
            return True
        between = self.centre - other.centre
        return math.sqrt(float(between @ between)) - self.radius - other.radius > eps + 1e-9


class Stretch:
    """Vectors in grid order, with the bounds of the halves that the recursion comes to."""

    def __init__(self, raw: np.ndarray, basis: np.ndarray, eps: float):
        x = unit(raw)
        coords = coordinates(x, basis)
        cells = np.floor(coords / eps)
        self.order = np.lexsort(cells.T[::-1])
        self.x, self.coords, self.raw = x[self.order], coords[self.order], raw
        self.known: dict = {}
        change = np.diff(cells[self.order], axis=0) != 0
        self.level = np.where(change.any(1), change.argmax(1), cells.shape[1]) if len(x) > 1 else np.zeros(0, int)

    def middle(self, a: int, b: int) -> int:
        """Where to halve a stretch: at the border of the greatest cells in its middle half."""
        low, high = a + (b - a) // 4, b - (b - a) // 4
        levels = self.level[low - 1 : high - 1]
        best = np.flatnonzero(levels == levels.min()) + low
        return int(best[np.abs(best - (a + b) // 2).argmin()])

    def bounds(self, a: int, b: int) -> Bounds:
        if (a, b) not in self.known:
            self.known[a, b] = Bounds(self.x[a:b], self.coords[a:b])
        return self.known[a, b]


def ego_pairs(s: Stretch, t: Stretch, eps: float, cosine: float, few: int = FEW, seen: dict | None = None):
    """Yields positions (in s, in t) of linked pairs of two stretches, or once each within one if they are the same.

    seen: counts of the pairs compared and of all pairs, if asked for.
    """
    same = s is t
    stack = [(0, len(s.x), 0, len(t.x))]
    if seen is not None:
        seen["all"] = seen.get("all", 0) + (len(s.x) * (len(s.x) - 1) // 2 if same else len(s.x) * len(t.x))
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        alike = same and (a0, a1) == (b0, b1)
        if not alike and s.bounds(a0, a1).apart(t.bounds(b0, b1), eps):
            continue
        if a1 - a0 <= few and b1 - b0 <= few:
            if seen is not None:
                seen["compared"] = seen.get("compared", 0) + ((a1 - a0) * (a1 - a0 - 1) // 2 if alike else (a1 - a0) * (b1 - b0))
            dots = s.x[a0:a1] @ t.x[b0:b1].T
            i, j = np.nonzero(dots >= cosine - 1e-9)
            if alike:
                i, j = i[i < j], j[i < j]
            if len(i):
                good = np.ones(len(i), bool)
                for k in np.flatnonzero(np.abs(dots[i, j] - cosine) <= 1e-9):  # rounding decides nothing
                    good[k] = linked(s.raw[s.order[a0 + i[k]]], t.raw[t.order[b0 + j[k]]], cosine)
                yield s.order[a0 + i[good]], t.order[b0 + j[good]]
            continue
        am, bm = s.middle(a0, a1) if a1 - a0 > few else a1, t.middle(b0, b1) if b1 - b0 > few else b1
        if alike:
            stack += [(a0, am, a0, am), (a0, am, am, a1), (am, a1, am, a1)]
        else:
            stack += [(p, q, r, z) for p, q in ((a0, am), (am, a1)) for r, z in ((b0, bm), (bm, b1))]


_INTERVAL = pa.schema([("cid", pa.int64()), ("size", pa.int64()), ("width", pa.int32()), ("raw", pa.binary())])


def _write_intervals(folder: str):
    """Rows (part, cid, size, width, raw), sorted by part, to a file for each; gives the parts."""

    def run(batches):
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        now = out = file = None

        def done():
            out.close()
            file.close()
            store.move(own, f"{at}/{now}.arrow")
            return pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int32())})

        for batch in batches:
            parts = batch.column(0).to_numpy()
            begin = 0
            for end in [*(np.flatnonzero(np.diff(parts)) + 1), len(parts)]:
                if end == begin:
                    continue
                if now is not None and parts[begin] != now:
                    yield done()
                    now = None
                if now is None:
                    now = int(parts[begin])
                    own = f"{at}/{now}.{uuid.uuid4().hex}"
                    file = store.open_output_stream(own)
                    out = pa.ipc.new_stream(file, _INTERVAL)
                cut = batch.slice(begin, end - begin)
                out.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cut.columns[1:], _INTERVAL)], schema=_INTERVAL))
                begin = end
        if now is not None:
            yield done()

    return run


def _read_interval(folder: str, part: int) -> pa.Table:
    store, at = _store(folder)
    with store.open_input_stream(f"{at}/{part}.arrow") as f:
        return pa.ipc.open_stream(f).read_all()


def vector_links(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, leading: int = LEADING, sample: int = SAMPLE, largest: int = LARGEST) -> DataFrame:
    """Links between vectors with a cosine of ``cosine`` or more (above 0), in double precision.

    Returns one row per row of ``vectors``: vec_id, n_links (other rows linked
    directly), component_id (smallest vec_id reachable, itself included), kept
    (vec_id = component_id). Vectors that are null, empty or zero or hold null or
    non-finite components link with nothing, nor do vectors of unlike length,
    however long. A null vec_id sorts above all others; rows may repeat, and link
    with their copies. An empty table gives an empty result. Columns other than
    those named aren't read, whatever their names.

    sample: vectors that the dimensions and the intervals' ends come from, at most.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "ego")
    eps = math.sqrt(2 - 2 * cosine)
    kind = "<f8" if "double" in vectors.schema[embedding].dataType.simpleString() else "<f4"
    rows = numbered(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v")), scratch)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.coalesce((F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0), F.lit(False))
    least = F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id")).alias("least")
    classes = rows.filter(fine).groupBy("v").agg(F.min("uid").alias("cid"), least, F.count(F.lit(1)).alias("size"))
    classes = scratch.write(classes, "classes")
    n = classes.count()
    picked = classes.select("v", "cid").orderBy(F.xxhash64("cid")).limit(sample).collect()  # of a bounded number
    lengths = [len(r.v) for r in picked]
    width = max(set(lengths), key=lengths.count) if lengths else 1
    like = [r for r in picked if len(r.v) == width]
    start = unit(np.array([r.v for r in like], kind)) if like else np.ones((1, 1))
    basis = principal(start, min(leading, width))
    k = basis.shape[1] + 1
    mix = lambda c: (np.asarray(c, np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).tolist()

    def keys(coords, cids):
        return [(*c, h) for c, h in zip(np.floor(coords / eps).astype(int).tolist(), mix(cids))]

    intervals = int(max(1, round(math.sqrt(n) / 16), n // largest))
    ends: list = []
    if intervals > 1:
        ordered = sorted(keys(coordinates(start, basis), [r.cid for r in like]))
        ends = [ordered[len(ordered) * i // intervals] for i in range(1, intervals)]

    placed_arrow = pa.schema([("part", pa.int32()), ("cid", pa.int64()), ("size", pa.int64()), ("width", pa.int32()), ("raw", pa.binary()), *((f"c{i}", pa.float64()) for i in range(k))])

    def place(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                cut = batch.slice(at, 4096)
                cids, sizes = cut.column(1).to_numpy(), cut.column(2).to_numpy()
                vectors = [np.array(v, kind) for v in cut.column(0).to_pylist()]
                for w in sorted({len(v) for v in vectors}):
                    mine = [i for i, v in enumerate(vectors) if len(v) == w]
                    coords = coordinates(unit(np.stack([vectors[i] for i in mine])), basis)
                    parts = [bisect_right(ends, key) for key in keys(coords, cids[mine])]
                    cols = [parts, cids[mine], sizes[mine], [w] * len(mine), [vectors[i].tobytes() for i in mine], *coords.T]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, placed_arrow)], schema=placed_arrow)

    named = ", ".join(f"c{i} double" for i in range(k))
    placed = scratch.write(classes.select("v", "cid", "size").mapInArrow(place, f"part int, cid long, size long, width int, raw binary, {named}"), "placed")
    boxes = placed.groupBy("part").agg(*[f(f"c{i}").alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(k)]).collect()  # one row for each interval
    box = {r.part: (np.array(r[1 : 1 + k]), np.array(r[1 + k :])) for r in boxes}
    folder = f"{scratch.path}/intervals"
    dealt = placed.select("part", "cid", "size", "width", "raw").repartition(intervals, "part").sortWithinPartitions("part", "width")
    dealt.mapInArrow(_write_intervals(folder), "part int").write.format("noop").mode("overwrite").save()

    def join(batches):
        held: dict = {}

        def interval(part):
            """Tables by length of vectors, with their vectors in grid order; the last few that were asked for."""
            if part not in held:
                while len(held) > 1:
                    held.pop(next(iter(held)))
                table, found = _read_interval(folder, part), {}
                widths = table.column("width").to_numpy()
                for w in np.unique(widths):
                    own = table.filter(pa.array(widths == w))
                    raw = np.frombuffer(b"".join(own.column("raw").to_pylist()), kind).reshape(len(own), -1)
                    found[int(w)] = (own.column("cid").to_numpy(), own.column("size").to_numpy(), Stretch(raw, basis, eps))
                held[part] = found
            held[part] = held.pop(part)
            return held[part]

        for batch in batches:
            for pair in batch.column(0).to_pylist():
                p, q = divmod(pair, intervals)
                if q < p or p not in box or q not in box or (p != q and apart(*box[p], *box[q], eps)):
                    continue
                first = interval(p)
                second = interval(q)
                for w in sorted(set(first) & set(second)):
                    (cids, sizes, s), (more, theirs, t) = first[w], second[w]
                    m = len(cids)
                    if p != q:
                        cids, sizes = np.concatenate([cids, more]), np.concatenate([sizes, theirs])
                    counts, joined = np.zeros(len(cids), np.int64), Joined(len(cids))
                    for a, b in ego_pairs(s, t, eps, cosine):
                        b = b if p == q else b + m
                        np.add.at(counts, a, sizes[b])
                        np.add.at(counts, b, sizes[a])
                        joined.join(a, b)
                    hit = np.flatnonzero(counts)
                    if len(hit):
                        root = joined.p[hit]
                        links = np.where(root == hit, -1, cids[root])
                        yield pa.RecordBatch.from_arrays([pa.array(cids[hit]), pa.array(links, pa.int64(), mask=root == hit), pa.array(counts[hit])], names=["u", "v", "n"])

    tasks = min(intervals * intervals, max(4 * spark.sparkContext.defaultParallelism, min(intervals * intervals // 16, 50_000)))
    met = spark.range(0, intervals * intervals, 1, tasks).mapInArrow(join, "u long, v long, n long")
    met = scratch.write(met, "met")
    linked = components(met.filter("v is not null").select("u", "v"), scratch)
    counts = met.groupBy("u").agg(F.sum("n").alias("n"))
    known = classes.select("v", "cid", "least", "size").join(linked.withColumnRenamed("node", "cid"), "cid", "left").join(counts.withColumnRenamed("u", "cid"), "cid", "left")
    known = scratch.write(known.withColumn("root", F.coalesce("component", "cid")), "known")
    groups = scratch.write(known.groupBy("root").agg(F.min("least").alias("first")), "groups")
    named_classes = known.join(groups, "root").select("v", F.col("first.vec_id").alias("found"), (F.coalesce("n", F.lit(0).cast("long")) + F.col("size") - 1).alias("n_links"))
    named_classes = scratch.write(named_classes, "named")
    out = rows.filter(fine).join(named_classes, "v").select("vec_id", "n_links", F.col("found").alias("component_id"))
    alone = rows.filter(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
