"""The manifest against a tree that is built whole in Python."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from noteloom.llm.merkle import fold, merkle_manifest, tampered

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def steps(tree, i, fanout):
    out = []
    for level in tree[:-1]:
        a = i - i % fanout
        out.append((level[a:i], level[i + 1 : a + fanout]))
        i //= fanout
    return out


def small(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def slow(rows, fanout):
    groups = {}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), leaf((*r[:4], small(r[4]))) if hit else leaf(r)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort()
        trees[s] = levels([x[2] for x in groups[s]], fanout)
    top = levels([trees[s][-1][0] for s in names], fanout)
    out = []
    for k, s in enumerate(names):
        for i, (there, doc, own, found) in enumerate(groups[s]):
            path = steps(trees[s], i, fanout) + steps(top, k, fanout)
            node = found
            for before, after in path:
                node = h(*before, node, *after)
            out.append((doc if there else None, own, trees[s][-1][0], top[-1][0], h(*(x for b, a in path for x in b + a)), node, node == top[-1][0]))
    return sorted(out, key=str)


def made(spark, rows, **kw):
    df = spark.createDataFrame(rows, COLUMNS)
    for c in ("grp", "idx", "node", "bucket", "proof"):  # names that clash with the operator's own
        df = df.withColumn(c, F.lit(7))
    found = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, tampered(F.col("text"))).otherwise(F.col("text"))
    return merkle_manifest(df, changed={"text": found}, **kw)


def some(n):
    rows = [(i, ["hot", f"s{i % 23}", None, "é"][i % 4 if i % 3 else 0], ["en", None][i % 2], i, [f"Text {i}", None, "", "NAÏVE ZÄHLER", "lower"][i % 5]) for i in range(n)]
    return rows


@pytest.mark.parametrize("fanout,depth", [(16, 2), (3, 1), (3, 2), (2, 3)])
def test_against_whole_trees(spark, fanout, depth):
    rows = some(700) + [(None, "hot", None, None, "null id"), (5, "hot", "en", 1, "twice"), (5, "hot", "en", 1, "twice"), (5, "hot", "en", 2, "Other"), (9**15, "big", "en", 3, "LONG " * 40_000)]
    got = sorted((tuple(r)[:7] for r in made(spark, rows, fanout=fanout, levels=depth).collect()), key=str)
    assert got == slow(rows, fanout)
    assert 0 < sum(not r[6] for r in got) < len(got)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 256, 257])
def test_one_source_of_each_size(spark, n):
    rows = [(i, "s", "en", i, f"T{i}") for i in range(n)]
    got = sorted((tuple(r) for r in made(spark, rows).collect()), key=str)
    assert got == slow(rows, 16) if n else got == []


def test_many_sources_and_proofs(spark):
    rows = [(i, f"s{i}", "en", i, "T") for i in range(300)]
    got = made(spark, rows, with_proof=True).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == slow(rows, 16)
    for r in got:
        assert (fold(r.leaf, list(r.proof)) == r.root) and h(*r.proof) == r.proof_sha256


def test_no_task_holds_a_source(spark):
    """A source of a third of the rows is dealt over many ranges and buckets."""
    from noteloom.llm import ordering
    from noteloom.runtime import Scratch

    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("source"), F.col("id").alias("doc_id"))
    was, ordering.RANGE_ROWS = ordering.RANGE_ROWS, 100
    try:
        scratch = Scratch(spark, "test")
        placed = ordering.ordered(rows, "source", ["doc_id"], scratch, "x")
        assert [r.idx for r in placed.filter("source = 'hot'").orderBy("doc_id").collect()] == list(range(1000))
        written = spark.read.parquet(f"{scratch.path}/x_ranges")
        assert written.groupBy("__range").count().agg(F.max("count")).first()[0] < 300
    finally:
        ordering.RANGE_ROWS = was
