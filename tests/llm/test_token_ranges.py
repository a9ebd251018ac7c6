"""Shards that are read by ranges, from stores that can't be mapped, and how many shards there are."""

import numpy as np
import pyarrow.fs as pafs
import pytest

from noteloom.llm import token_files
from noteloom.llm.queries import tokenizer_path


@pytest.mark.parametrize("docs_at_once,ids_at_once", [(4096, 1 << 20), (3, 5), (1, 1), (7, 100)])
def test_ranges(spark, tmp_path, monkeypatch, docs_at_once, ids_at_once):
    docs = spark.createDataFrame([(i, None if i % 7 == 0 else "word " * (i * i % 50)) for i in range(40)] + [(None, "x")], "doc_id long, text string")
    folder = str(tmp_path / "t")
    manifest = token_files.write_token_files(docs, folder, tokenizer_path("word_bpe_49k.json"), shards=3)
    want = [(d, s, i.tolist()) for shard in manifest["shards"] for d, s, i in token_files.read_shard(f"file:{folder}", shard, manifest["width"])]
    assert len(want) == 41 and sum(len(i) for _, _, i in want) == manifest["total"]
    assert [s for _, s, _ in want] == [0, *np.cumsum([len(i) for _, _, i in want])[:-1].tolist()]
    asked = []

    class Far(pafs.FileSystem):
        """A store that gives ranges only."""

        def __init__(self):
            self.type_name_ = "far"

        type_name = "far"

        def open_input_file(self, path):
            class File:
                def read_at(self, n, at):
                    asked.append(n)
                    with open(path, "rb") as f:
                        f.seek(at)
                        return f.read(n)

            return File()

    monkeypatch.setattr(token_files, "_store", lambda folder: (Far.__new__(Far), folder.removeprefix("file:")))
    monkeypatch.setattr(token_files, "READ_DOCS", docs_at_once)
    monkeypatch.setattr(token_files, "READ_IDS", ids_at_once)
    got = [(d, s, i.tolist()) for shard in manifest["shards"] for d, s, i in token_files.read_shard(folder, shard, manifest["width"])]
    assert got == want
    longest = max(len(i) for _, _, i in want)
    assert max(asked) <= max(8 * (docs_at_once + 1), 4 * max(ids_at_once, longest))


def test_shards_follow_the_input(spark, tmp_path, monkeypatch):
    spark.range(2000).selectExpr("id AS doc_id", "repeat(md5(cast(id AS string)), 5) AS text").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    few = token_files.write_token_files(docs, str(tmp_path / "a"), tokenizer_path("word_bpe_49k.json"))
    monkeypatch.setattr(token_files, "SHARD_BYTES", 5_000)
    many = token_files.write_token_files(docs, str(tmp_path / "b"), tokenizer_path("word_bpe_49k.json"))
    assert len(few["shards"]) <= 4 < 10 < len(many["shards"]) and few["total"] == many["total"]
