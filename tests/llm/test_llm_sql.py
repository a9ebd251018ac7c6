"""Queries of this subpackage against their SQL in DuckDB, on tables that hold what the driver's may not: links, copies, nulls."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from noteloom.llm import queries


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("sql")
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    vectors = [(c + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.4])).astype("<f4").tolist() for c in centres for _ in range(rng.integers(1, 7))]
    vectors += vectors[:9] + [None, [0.0] * 24, [1.0, 2.0], [1.0, 2.1], [float("nan")] + [1.0] * 23, [None] + [1.0] * 23]
    ids = [int(i) for i in rng.permutation(len(vectors))]
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(ids), pa.int32())}), f"{d}/embeddings.parquet")
    big = "<p>" + "shared payload " * 90
    html = [big, None, "", big, "small", "small", big + "é", big, "x" * 1000, "x" * 1000, "x" * 999, "x" * 999]
    pq.write_table(pa.table({"page_id": pa.array(range(len(html)), pa.int64()), "url": pa.array(["u"] * len(html)), "html": pa.array(html)}), f"{d}/pages.parquet")
    texts = ["one", None, "", "two\n", "one", "two", "z" * 20_000, "z" * 20_000, "z" * 19_999]
    texts += [" ".join(f"T{chr(97 + int(k))}" for k in rng.zipf(1.5, 12) % 26) for _ in range(120)]
    n = range(len(texts))
    columns = {"text": texts, "lang": [("en", "fr", None)[i % 3 if i % 2 else 0] for i in n], "source": [(None, "a", "é", "b", "c")[i % 5 if i % 3 else 4] for i in n]}
    table = {"doc_id": pa.array(n, pa.int64()), **{k: pa.array(v) for k, v in columns.items()}, "n_chars": pa.array([i if i % 7 else None for i in n], pa.int64())}
    pq.write_table(pa.table(table), f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_same_rows(spark, sf_dir, name):
    db = duckdb.connect()
    for p in sf_dir.glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = db.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, str(sf_dir))
    rows = sorted(str(tuple(r[c] for c in want.columns)) for r in got.collect())
    assert rows == sorted(map(str, want.fetchall())) and len(rows) > 5


def test_hot_id_is_dealt_over_shards(spark, tmp_path):
    """One id that most rows share, with one text, doesn't go to one shard."""
    docs = spark.range(2000).selectExpr("CASE WHEN id % 10 = 0 THEN id ELSE 7 END AS doc_id", "'the same text' AS text")
    manifest = queries.write_token_files(docs, str(tmp_path / "t"), queries.tokenizer_path("word_bpe_49k.json"), shards=8)
    assert max(s["docs"] for s in manifest["shards"]) < 700
    found = queries.read_token_files(spark, str(tmp_path / "t"), manifest).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted(r.doc_id for r in found) and len(found) == 2000
