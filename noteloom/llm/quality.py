"""Graded quality by ordinal cumulative-link regression over hashed text.

One weight vector w gives every text a score f = w.x; ordered thresholds
t_1 < t_2 < ... cut the score into grades: P(grade >= k) = logistic(f - t_k). So
all grades share the weights, the sum of these probabilities is the expected
grade, and each is a tail probability to select by.

Features are hashed: which words a text has (each counts once), and the shares of
its tokens that have each shape (letter case, digits, signs) or repeat the token
before them. The model is fitted on the driver on a bounded sample of labelled
rows (``sample``: those whose ids hash lowest, a row for each, of at most ``widest``
features); every row is scored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom.llm.word_ids import Kept, batches_by_size, cache, chunked, cut_words
from noteloom.runtime import Scratch, fresh_name, quoted, ship

BUCKETS = 1 << 20
SAMPLE = 16_000
ACCEPT = 0.7
SHARE = 6.0
LEAST = 3
WIDEST = 8192
#: Features of all rows that the fit takes.
MOST_FEATURES = 8_000_000

_LETTERS = re.compile(r"[^\W\d_]+")
_SIGNS = frozenset(",.;:!?")
_KEPT_CHUNKS = 2_000_000
_KEPT_BYTES = 40 << 20
#: Characters of text that are scored at a time.
GROUP = 1 << 20


def kept_chunks() -> Kept:
    """The cache of a worker: buckets by chunk."""
    return cache("quality chunks", lambda: Kept(_KEPT_CHUNKS, _KEPT_BYTES, weigh=lambda values: (160 + 36 * (len(a) + len(b)) for a, b in values)))


def bucket(kind: str, name: str) -> int:
    return zlib.crc32(f"{kind}:{name}".encode()) % BUCKETS


def shape(chunk: str) -> str:
    """Runs of capitals, small letters and digits of the whole chunk as A, a, 0; signs as they are."""
    s = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in chunk)
    return re.sub(r"(A+|a+|0+)", lambda m: m[0][0], s)


def shapes(chunk: str) -> list[str]:
    """The shape in pieces of at most 12 signs, so that a text without white space has as many as it is long."""
    s = shape(chunk)
    return [s[i : i + 12] for i in range(0, len(s), 12)] or [""]


@lru_cache(1 << 16)
def shape_bucket(piece: str) -> int:
    return bucket("shape", piece)


def chunk_buckets(chunk: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Buckets of the words and of the pieces of the shape of a chunk."""
    low = chunk.lower()
    words = (low,) if low.isalpha() else _LETTERS.findall(low)
    body, sign = (chunk[:-1], chunk[-1:]) if chunk[-1:] in _SIGNS else (chunk, "")
    plain = "" if not body.isalpha() else "a" if body.islower() else "Aa" if body[0].isupper() and body[1:].islower() else ""
    return tuple([bucket("word", w) for w in words]), (shape_bucket(plain + sign),) if plain else tuple([shape_bucket(s) for s in shapes(chunk)])


def features(text: str | None, kept: Kept) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text: 1 for each word it has, SHARE times the share of pieces of tokens for each shape."""
    chunks = (text or "").split()
    words: set[int] = set()
    found_shapes: Counter = Counter()
    n = 0
    for chunk, count in Counter(chunks).items():
        found = kept.get(chunk)
        if found is None:
            found = chunk_buckets(chunk)
            if len(chunk) <= 64:
                kept.put(chunk, found)
        words.update(found[0])
        for piece in found[1]:
            found_shapes[piece] += count
        n += count * len(found[1])
    found_shapes[bucket("text", "repeats")] += sum(map(eq, chunks, chunks[1:]))
    at = np.fromiter((*words, *found_shapes), np.int64, len(words) + len(found_shapes))
    values = np.ones(len(at))
    values[len(words) :] = np.fromiter(found_shapes.values(), np.float64, len(found_shapes)) * (SHARE / max(1, n))
    return at, values


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class CumulativeLink:
    """Weights (for the buckets that the training rows use often enough) and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def score(self, at: np.ndarray, values: np.ndarray) -> float:
        return float(self.weights[at].astype(np.float64) @ values)

    def scores(self, texts: list, kept: Kept) -> np.ndarray:
        """:meth:`score` of the features of many texts: their chunks are found, and words counted once for each text, together."""
        codes, ends, chunks = chunked([t or "" for t in texts], cut_words)
        buckets = kept.values(chunks.to_pylist(), lambda fresh: list(map(chunk_buckets, fresh)))
        text = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        some = np.array([bool(s) for s in pc.binary_length(chunks).to_numpy()] or [False])
        if len(codes):
            codes, text = codes[some[codes]], text[some[codes]]
        if not len(codes):
            return np.zeros(len(texts))
        weights = self.weights.astype(np.float64)

        def laid_out(k: int):
            """All buckets of a kind, one chunk after the other, their number for each chunk, and where they begin."""
            sizes = np.fromiter((len(b[k]) for b in buckets), np.int64, len(buckets))
            return np.fromiter(chain.from_iterable(b[k] for b in buckets), np.int64, int(sizes.sum())), sizes, np.cumsum(sizes) - sizes

        flat, sizes, _ = laid_out(1)
        of_shapes = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights[flat], len(sizes))
        pieces, shapes_ = np.bincount(text, sizes[codes], len(texts)), np.bincount(text, of_shapes[codes], len(texts))
        again = text[1:][(codes[1:] == codes[:-1]) & (text[1:] == text[:-1])]
        shapes_ += np.bincount(again, minlength=len(texts)) * weights[bucket("text", "repeats")]
        flat, sizes, begin = laid_out(0)
        n = sizes[codes]
        at = np.repeat(begin[codes] - np.cumsum(n) + n, n) + np.arange(n.sum())
        words = np.repeat(text, n) * BUCKETS + flat[at]
        words = np.unique(words[weights[words % BUCKETS] != 0])
        return np.bincount(words // BUCKETS, weights[words % BUCKETS], len(texts)) + shapes_ * (SHARE / np.maximum(1, pieces))

    def tails(self, score):
        """P(grade >= k) for k = 1, 2, ..."""
        return logistic(np.asarray(score)[..., None] - self.thresholds)


def word_scales(at: np.ndarray, word: np.ndarray, row: np.ndarray, grades: np.ndarray, top: int, width: int = BUCKETS) -> np.ndarray:
    """For each bucket, the largest log ratio, over thresholds k, of the shares of rows below and from grade k that have the word; 1 at least, and for what is no word."""
    has = np.stack([np.bincount(at[word & (grades[row] == k)], minlength=width) for k in range(top + 1)])
    sizes = np.bincount(grades, minlength=top + 1)
    scale = np.ones(width)
    for k in range(1, top + 1):
        below = np.log((has[:k].sum(0) + 0.5) / (sizes[:k].sum() + 1))
        above = np.log((has[k:].sum(0) + 0.5) / (sizes[k:].sum() + 1))
        scale = np.maximum(scale, np.abs(below - above))
    scale[has.sum(0) == 0] = 1
    return scale


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, least: int = LEAST, steps: int = 120, rate: float = 0.08, ridge: float = 2e-4, spend: bool = False) -> CumulativeLink:
    """Maximum likelihood with a ridge, by Adam on the whole sample.

    least: rows that must share a bucket for it to get a weight, a small number
    however many rows there are, as words that tell a grade may be rare. Words
    that tell one are scaled up (``word_scales``), so that the ridge holds them
    back less than the many rare words that don't. ``spend`` empties ``rows`` once they
    are read, for callers that have no other use of them: beside them the fit holds
    four numbers for each feature.
    """
    top, n = int(grades.max()), len(rows)
    row = np.repeat(np.arange(n), [len(a) for a, _ in rows])
    at = np.concatenate([a for a, _ in rows])
    values = np.concatenate([v for _, v in rows])
    if spend:
        rows.clear()
    often = np.bincount(at, minlength=BUCKETS) >= least
    keep = often[at]
    places = np.cumsum(often, dtype=np.int32) - 1  # of the buckets that get a weight
    at, row, values = places[at[keep]].astype(np.int64), row[keep], values[keep].astype(np.float64)
    del keep, places
    w = np.zeros(int(often.sum()))
    scale = word_scales(at, values == 1, row, grades, top, len(w))
    part = np.empty_like(values)
    values *= np.take(scale, at, out=part)
    share = np.array([(grades >= k).mean() for k in range(1, top + 1)]).clip(1e-3, 1 - 1e-3)
    first = np.log((1 - share) / share)
    p = np.concatenate([w, first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, cuts = p[: len(w)], p[len(w) :]
        t = np.concatenate([[-np.inf], cuts[0] + np.concatenate([[0], np.cumsum(np.exp(cuts[1:]))]), [np.inf]])
        np.multiply(np.take(w, at, out=part), values, out=part)
        f = np.bincount(row, part, n)
        hi, lo = logistic(np.where(np.isinf(t[grades + 1]), 60, t[grades + 1]) - f), logistic(np.where(np.isinf(t[grades]), -60, t[grades]) - f)
        mass = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / mass, lo * (1 - lo) / mass
        g_f = (d_hi - d_lo) / n
        np.multiply(np.take(g_f, row, out=part), values, out=part)
        g_w = np.bincount(at, part, len(w)) + ridge * w
        g_t = np.array([(-(d_hi * (grades == k)) + d_lo * (grades == k + 1)).sum() / n for k in range(top)])
        g_c = np.array([g_t.sum(), *(g_t[k:].sum() * np.exp(cuts[k]) for k in range(1, top))])
        g = np.concatenate([g_w, g_c])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    weights = np.zeros(BUCKETS, np.float32)
    weights[often] = p[: len(w)] * scale
    cuts = p[len(w) :]
    return CumulativeLink(weights, cuts[0] + np.concatenate([[0], np.cumsum(np.exp(cuts[1:]))]))


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, grade) from labels: 0 for low quality, 1 for toxic text of good quality, 2 for good text. Rows with nulls are left out; of repeated ids the worst grade counts."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), "quality", "toxic").dropna()
    grade = F.when(F.col("quality") <= 0, 0).when(F.col("toxic") > 0, 1).otherwise(2)
    return known.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, widest: int = WIDEST, most: int = MOST_FEATURES) -> CumulativeLink | None:
    """Fit on the texts of the ``sample`` graded ids that hash lowest; None if they have fewer than two grades.

    Of these, rows are taken in that order as long as they have ``most`` features at most in all.

    Of rows that share an id, the one whose text hashes lowest is taken (a null
    text counts as empty); one with over ``widest`` features is left out of the fit.
    So the driver gets at most ``sample`` rows and ``most`` features, however often ids
    repeat and however long texts are. Empty tables have no grades.
    """
    spark = docs.sparkSession
    ship(spark)
    chosen = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # of a bounded size, so it may be broadcast

    def run(batches):
        kept = kept_chunks()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))
                found = [(d, g, *x) for d, t, g in rows if len((x := features(t, kept))[0]) <= widest]
                cols = [[f[0] for f in found], [f[1] for f in found], [f[2].astype("<i4").tobytes() for f in found], [f[3].astype("<f4").tobytes() for f in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["doc_id", "grade", "at", "values"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    once = rows.groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")).select("doc_id", "first.text", "grade")
    found = Scratch(spark, "fit").write(once.mapInArrow(run, "doc_id long, grade int, at binary, values binary"), "features")
    order = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")
    sizes = found.select(order.alias("place"), (F.octet_length("at") / 4).cast("long").alias("n")).orderBy("place").collect()  # at most ``sample`` small rows
    taken = int(np.searchsorted(np.cumsum([r.n for r in sizes]), most, side="right"))
    if taken == 0:
        return None
    last = sizes[taken - 1].place
    got = found.filter(order <= F.struct(F.lit(last.h).cast("long").alias("h"), F.lit(last.doc_id).cast("long").alias("doc_id"))).collect()
    del sizes
    got.sort(key=lambda r: (r.doc_id, r["at"], r["values"]))
    grades_ = np.array([r.grade for r in got])
    if len(set(grades_.tolist())) < 2:
        return None
    rows = [(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["values"], "<f4")) for r in got]
    del got
    return fit(rows, grades_, spend=True)


def score_quality(docs: DataFrame, model: CumulativeLink | None, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT, carry: str | None = None) -> DataFrame:
    """Score every whole text. Returns doc_id, expected_grade, tail_probability (of the top grade), kept.

    ``carry`` returns the columns of ``docs`` and of these only ``kept``, under that
    name, which no column of ``docs`` may have. A null or empty text is scored on
    what it has, nothing. Without a model (no labels) every row is kept and has null
    scores. Ids may be null or repeat; each row gives one row, copies too. Texts are
    read whole, however long. An empty table gives an empty result. No shuffle: rows
    stay where they are.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # of a fixed size
    made = pa.schema([("expected_grade", pa.float64()), ("tail_probability", pa.float64()), ("kept", pa.bool_())])

    def run(batches):
        model = shared.value
        kept = kept_chunks()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            if model is None:
                tails, top = [None] * len(texts), [None] * len(texts)
            else:
                found = model.tails(np.concatenate([np.zeros(0), *(model.scores(group, kept) for group in batches_by_size(texts, lambda t: len(t or ""), GROUP))]))
                tails, top = found.sum(1).tolist(), found[:, -1].tolist()
            keep = [p is None or p >= accept for p in top]
            own = [pa.array(keep)] if carry else [pa.array(x, f.type) for x, f in zip((tails, top, keep), made)]
            cols = batch.columns[: batch.num_columns - 1]
            yield pa.RecordBatch.from_arrays([*cols, *own], names=[*batch.schema.names[:-1], *([carry] if carry else made.names)])

    if carry:
        # by place: an Arrow operator reads names as they are written, dots and all
        plain = [T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(docs.schema.fields)]
        own = [F.col(quoted(c)).alias(f.name) for c, f in zip(docs.columns, plain)]
        scored = docs.select(*own, F.col(text_col).alias("text")).mapInArrow(run, T.StructType([*plain, T.StructField(carry, T.BooleanType())]))
        return scored.select(*[F.col(f.name).alias(c) for c, f in zip(docs.columns, plain)], carry)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """``docs`` without the rows that a model trained on them and ``labels`` rejects; all columns as they were, whatever their names."""
    model = train(docs, graded(labels), id_col, text_col)
    kept = fresh_name(docs, "__kept")
    return score_quality(docs, model, id_col, text_col, accept, carry=kept).filter(F.col(kept)).drop(kept)
