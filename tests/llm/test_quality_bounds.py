"""What reaches the driver, and names that clash."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteloom.llm import quality
from noteloom.llm.quality import graded, keep_good, score_quality, train

WORDS = [a + b for a in "ba be bi bo bu da de di do du".split() for b in "n r s t l m".split()]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    texts = [" ".join(w.upper() + "!!" if i % 4 == 0 else w for w in rng.choices(WORDS, k=40)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, __kept long, __text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    return docs, labels


def rows_of_fit(monkeypatch, docs, labels, **more):
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, grades, **how: seen.extend(rows) or fit(rows, grades, **how))
    model = train(docs, graded(labels), **more)
    return seen, model


def test_repeated_ids_reach_the_driver_once(monkeypatch, tables):
    docs, labels = tables
    copies = docs.unionByName(docs.filter("doc_id = 7").crossJoin(docs.sparkSession.range(5000)).select(docs.columns)).unionByName(docs.filter("doc_id = 7").withColumn("text", F.lit("other text of that id")))
    seen, model = rows_of_fit(monkeypatch, copies, labels)
    assert len(seen) == 200
    monkeypatch.undo()
    again = train(copies.repartition(13), graded(labels))
    assert np.array_equal(model.weights, again.weights) and np.array_equal(model.thresholds, again.thresholds)


def test_wide_rows_are_left_out_of_the_fit_only(monkeypatch, tables):
    docs, labels = tables
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(9000))
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 9, F.lit(long)).otherwise(F.col("text")))
    seen, model = rows_of_fit(monkeypatch, docs, labels)
    assert len(seen) == 199 and max(len(a) for a, _ in seen) <= quality.WIDEST
    assert score_quality(docs, model).filter("doc_id = 9 AND tail_probability IS NOT NULL").count() == 1


def test_clashing_names_stay(tables):
    docs, labels = tables
    kept = keep_good(docs, labels)
    assert kept.schema == docs.schema
    rows = kept.collect()
    assert 150 < len(rows) < 300 and all(r["__kept"] == r.doc_id and r["__text"] == "x" for r in rows)


def test_odd_names_come_back(spark, tables):
    docs, labels = tables
    odd = docs.withColumnsRenamed({"__kept": "a.b", "__text": "c`d"}).withColumn("_metadata", F.lit(1)).withColumn("c0", F.lit("own"))
    out = keep_good(odd, labels)
    assert out.columns == odd.columns and out.schema.fieldNames() == odd.schema.fieldNames()
    rows = out.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in keep_good(docs, labels).collect()}
    assert all((r["a.b"], r["c`d"], r["_metadata"], r.c0) == (r.doc_id, "x", 1, "own") for r in rows)


def test_features_of_all_rows_are_bounded(spark, monkeypatch, tables):
    docs, labels = tables
    seen, model = rows_of_fit(monkeypatch, docs, labels)
    every = sum(len(a) for a, _ in seen)
    assert len(seen) == 200 and model is not None
    monkeypatch.undo()
    seen, model = rows_of_fit(monkeypatch, docs, labels, most=every // 2)
    assert 60 < len(seen) < 140 and sum(len(a) for a, _ in seen) <= every // 2 and model is not None
    monkeypatch.undo()
    assert train(docs, graded(labels), most=3) is None
