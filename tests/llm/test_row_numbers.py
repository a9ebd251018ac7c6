"""Operators that read their input in several jobs, when these cut the scan differently."""

import pytest
from pyspark.sql import functions as F

from noteloom.llm import exact_dedup, line_align, simhash, warc
from noteloom.runtime import Scratch


@pytest.fixture
def changing_scans(spark, monkeypatch):
    """The number of partitions of a scan changes with each table that an operator writes."""
    count = iter(range(10_000))
    write = Scratch.write

    def turned(self, df, name):
        spark.conf.set("spark.sql.files.minPartitionNum", [1, 8, 3, 13][next(count) % 4])
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "write", turned)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    for key in ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


@pytest.fixture
def docs(spark, tmp_path):
    text = F.concat(F.lit("a text that some rows share "), F.md5((F.col("id") % 90).cast("string")), F.lit(chr(10)), F.expr("repeat('word ', 300)"), F.md5((F.col("id") % 90).cast("string")))
    made = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 45 != 7, text).alias("text"), F.col("id").alias("__uid"), F.lit("x").alias("uid"))
    made.repartition(8).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def texts_of(docs):
    return sorted(r.text or "" for r in docs.collect())


def test_drop_copies(docs, changing_scans):
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns and texts_of(out) == sorted(set(texts_of(docs)))
    last = {r.text or "": r.doc_id for r in sorted(docs.collect(), key=lambda r: r.doc_id)}
    assert sorted((r.doc_id, r["__uid"]) for r in out.collect()) == sorted((i, i) for i in last.values())


def test_drop_near_copies(docs, changing_scans):
    least = {}
    for r in simhash.near_groups(docs).collect():
        assert r.kept == (r.doc_id == r.component_id)
        least[r.component_id] = r.component_id
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(least)


def test_lines(docs, changing_scans):
    first = {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        first.setdefault(r.text or "", r.doc_id)
    got = line_align.delete_repeated_lines(docs, every=True).collect()
    assert len(got) == 400
    want = {r.doc_id for r in docs.collect() if r.text and first[r.text] != r.doc_id}
    assert {r.doc_id for r in got if r.n_deleted == 2} >= want


def test_archives(docs, changing_scans):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    last = {r.html: r.page_id for r in sorted(pages.collect(), key=lambda r: r.page_id)}
    got = warc.archive_round_trip(pages).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    assert len(got) == 400
    for r in got:
        copy = html[r.page_id] is not None and last[html[r.page_id]] != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", last[html[r.page_id]]) if copy else ("response", None))


# --- a path that is read twice, and a column named as Spark's own -----------------------------------------


@pytest.fixture(params=["twice", "_metadata"])
def doubled(spark, tmp_path, request):
    """Six rows with three texts, of which each is there four times; or the same twelve rows with a data column ``_metadata``."""
    path = str(tmp_path / "d")
    block = "a line of five good words here" + chr(10) + "and one more line of some words "
    made = spark.createDataFrame([(i, block + f"{i % 3} " * 300, "x") for i in range(6)], "doc_id long, text string, other string")
    if request.param == "twice":
        made.repartition(2).write.parquet(path)
        return spark.read.parquet(path, path)
    made.unionByName(made).withColumn("_metadata", F.lit("mine")).repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def test_doubled_copies(doubled):
    out = exact_dedup.drop_copies(doubled)
    assert out.columns == doubled.columns and sorted(r.doc_id for r in out.collect()) == [3, 4, 5]
    assert sorted((r.doc_id, r.kept) for r in exact_dedup.exact_groups(doubled).collect()).count((3, True)) == 1


def test_doubled_near_copies(doubled):
    groups = simhash.near_groups(doubled).collect()
    out = simhash.drop_near_copies(doubled)
    assert out.columns == doubled.columns and len(groups) == 12
    assert sorted(r.doc_id for r in out.collect()) == sorted({r.component_id for r in groups})


def test_doubled_archives(doubled):
    pages = doubled.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.concat("text", F.expr("repeat('word ', 400)")).alias("html"))
    got = sorted((r.page_id, r.record_type) for r in warc.archive_round_trip(pages).collect())
    assert len(got) == 12 and [x for x in got if x[1] == "response"] == [(3, "response"), (4, "response"), (5, "response")]


def test_doubled_lines(doubled):
    got = line_align.delete_repeated_lines(doubled, every=True).collect()
    assert len(got) == 12 and sum(r.n_deleted == 0 for r in got) == 1
