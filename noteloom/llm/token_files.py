"""Token-id files: flat unsigned integers with 64-bit document offsets.

A data set is a folder with, for each shard,

* ``ids-NNNNN.bin``: the ids of its documents, one after another, little-endian
  unsigned 16-bit if the vocabulary fits, else 32-bit;
* ``offsets-NNNNN.bin``: n + 1 unsigned 64-bit offsets, in ids, from the shard's start;
* ``docs-NNNNN.bin``: n signed 64-bit document ids (-2**63 stands for null);

and ``manifest.json`` with the width, and each shard's documents, ids and base.
Shards hold ranges of ascending document ids. Bases are prefix sums over the
shards' totals, which are all that reaches the driver: one row for each shard.
A task writes under a name of its own and renames at the end, so a task that is
repeated or runs twice leaves the same files.
"""

from __future__ import annotations

import json
import mmap
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.word_ids import GROUP, Table, batches_by_size, cache, cut_lowered, keyed_ids, library_encoder, load_tokenizer
from noteloom.runtime import parquet_relation, qualified, ship

NO_ID = -(2**63)

_READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def _store(folder: str):
    """A pyarrow file system and the folder's path in it. The folder has a scheme (``runtime.qualified``)."""
    from pyarrow import fs

    scheme, _, rest = folder.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else folder)


def _writer(folder: str, vocabulary, end_id: int, width: int, cut):
    def run(batches):
        shard = TaskContext.get().partitionId()
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        own = uuid.uuid4().hex
        names = {k: f"{at}/{k}-{shard:05d}.bin" for k in ("ids", "offsets", "docs")}
        data = vocabulary.value
        kept, encode = cache(("chunks", zlib.crc32(data.encode())), lambda: (Table(), library_encoder(data)))
        end = np.array([end_id], "<u4").tobytes()
        kind = f"<u{width}"
        docs = total = 0
        out = {k: store.open_output_stream(f"{n}.{own}") for k, n in names.items()}
        out["offsets"].write(np.array([0], "<u8").tobytes())
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for group in batches_by_size(rows, lambda r: len(r[1] or ""), GROUP):
                coded = [np.frombuffer(x + end, "<u4") for x in keyed_ids([t or "" for _, t in group], cut, encode, kept)]
                ends = total + np.cumsum([len(x) for x in coded])
                out["ids"].write(np.concatenate(coded).astype(kind).tobytes())
                out["offsets"].write(ends.astype("<u8").tobytes())
                out["docs"].write(np.array([NO_ID if d is None else d for d, _ in group], "<i8").tobytes())
                docs, total = docs + len(group), int(ends[-1])
        for k, n in names.items():
            out[k].close()
            store.move(f"{n}.{own}", n) if docs else store.delete_file(f"{n}.{own}")
        if docs:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [docs], "ids": [total]}, schema=pa.schema([("shard", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())]))

    return run


#: Bytes of input files that make a shard.
SHARD_BYTES = 256 << 20


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, cut=cut_lowered) -> dict:
    """Encode every text, append ``end_id``, write the files in ascending id order; returns the manifest.

    A null text counts as empty (its end id is still written); a null id sorts
    first; rows with equal ids follow each other in the order of a hash of their
    texts, and stay rows of their own. Without ``shards`` a table of
    files gets one for every ``SHARD_BYTES`` at least. Texts are coded whole, however long. An empty
    table gives a manifest without shards. Columns other than those named aren't
    read, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = qualified(spark, folder)
    with open(tokenizer_path, encoding="utf-8") as f:
        data = f.read()
    width = 2 if max(load_tokenizer(data).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    vocabulary = spark.sparkContext.broadcast(data)  # one vocabulary file, whatever the corpus
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if shards is None:  # a shard is sorted and read by a task: as many as the files ask for, if the input is a table of files
        relation = parquet_relation(docs)
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(relation.sizeInBytes()) // SHARD_BYTES) if relation else 1)
    # of equal ids by text and place, so that one that many rows share is dealt over shards too
    placed = rows.withColumns({"text_hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    sorted_rows = placed.repartitionByRange(shards, "doc_id", "text_hash", "place").sortWithinPartitions("doc_id", "text_hash", "place").select("doc_id", "text")
    totals = sorted_rows.mapInArrow(_writer(folder, vocabulary, end_id, width, cut), "shard int, docs long, ids long").collect()
    made, base = [], 0
    for r in sorted(totals):
        made.append({"shard": r.shard, "docs": r.docs, "ids": r.ids, "base": base})
        base += r.ids
    manifest = {"width": width, "end_id": end_id, "total": base, "shards": made}
    store, at = _store(folder)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


class _Array:
    """A file of numbers of which ranges are read: mapped where it is local, asked for by range where it isn't."""

    def __init__(self, store, path: str, kind: str):
        self.kind, self.width, self.mapped, self.file = kind, np.dtype(kind).itemsize, None, None
        if store.type_name == "local":
            with open(path, "rb") as f:
                self.mapped = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.path.getsize(path) else b"", kind)
        else:
            self.file = store.open_input_file(path)

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[part]
        return np.frombuffer(self.file.read_at((part.stop - part.start) * self.width, part.start * self.width), self.kind)


#: Documents, and ids, that are read of a shard at a time (a document's ids always at once).
READ_DOCS, READ_IDS = 4096, 1 << 20


def read_shard(folder: str, shard: dict, width: int):
    """(doc_id, global start, ids as <u4 array) for each document of a shard."""
    store, at = _store(folder)
    ids, offsets, docs = (_Array(store, f"{at}/{k}-{shard['shard']:05d}.bin", kind) for k, kind in (("ids", f"<u{width}"), ("offsets", "<u8"), ("docs", "<i8")))
    for i in range(0, shard["docs"], READ_DOCS):
        end = min(i + READ_DOCS, shard["docs"])
        names, ends = docs[i:end].tolist(), offsets[i : end + 1].astype(np.int64)
        k = 0
        while k < len(names):
            # as many documents as hold READ_IDS ids, one at least
            upto = max(k + 1, int(np.searchsorted(ends, ends[k] + READ_IDS, side="right")) - 1)
            held, first = ids[int(ends[k]) : int(ends[upto])], int(ends[k])
            for j in range(k, upto):
                a, b = int(ends[j]), int(ends[j + 1])
                yield None if names[j] == NO_ID else names[j], shard["base"] + a, held[a - first : b - first].astype("<u4")
            k = upto


def read_token_files(spark: SparkSession, folder: str, manifest: dict | None = None, with_ids: bool = False) -> DataFrame:
    """The documents of a data set: doc_id, start, n_tokens, ids_crc32 and, if asked, ids (unsigned 32-bit)."""
    ship(spark)
    folder = qualified(spark, folder)
    if manifest is None:
        store, at = _store(folder)
        with store.open_input_stream(f"{at}/manifest.json") as f:
            manifest = json.loads(f.read())
    schema = _READ if with_ids else _READ.removesuffix(", ids binary")
    if not manifest["shards"]:
        return spark.createDataFrame([], schema)
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for group in batches_by_size(read_shard(folder, manifest["shards"][i], manifest["width"]), lambda r: 64 + len(r[2])):
                    raw = [ids.tobytes() for _, _, ids in group]
                    cols = [[d for d, _, _ in group], [s for _, s, _ in group], [len(x) for _, _, x in group], [zlib.crc32(x) for x in raw], raw]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    n = len(manifest["shards"])
    return spark.range(0, n, 1, n).mapInArrow(run, schema)
