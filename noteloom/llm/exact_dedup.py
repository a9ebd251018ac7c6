"""Exact de-duplication by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. Equal blocks get equal
integer names: blocks are dealt out by a hash of their bytes, sorted by the bytes
themselves, and numbered where neighbours differ, so a hash never decides
equality. Adjacent names are then paired, and pairs named again, until one name
is left; with the number of blocks it identifies the whole text.

Skew: a block's bytes travel once for each map task, however often they occur in
it (``_cut`` keeps the blocks it has seen, within a bound, and sends references
for the rest). Pair names come from a map-side aggregate. Joins read written
tables, so that adaptive execution can split a hot key.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.runtime import Scratch, fresh_name, numbered, ship

BLOCK_BYTES = 8192
SEEN_BYTES = 32 << 20

_CUT = "uid long, doc_id long, sha binary, pos int, n_blocks int, c_uid long, c_pos int, content binary"
_CUT_ARROW = pa.schema(
    [("uid", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.binary()), ("pos", pa.int32()), ("n_blocks", pa.int32()), ("c_uid", pa.int64()), ("c_pos", pa.int32()), ("content", pa.binary())]
)
_NAMED_ARROW = pa.schema([f for f in _CUT_ARROW if f.name != "content"] + [pa.field("name", pa.int64())])


class _Seen:
    """Blocks met in this task, within a bound; those met again outlive a purge."""

    def __init__(self, most: int):
        self.most, self.size, self.at = most, 0, {}

    def carrier(self, block: bytes, here: tuple[int, int]) -> tuple[int, int]:
        found = self.at.get(block)
        if found is not None:
            found[1] += 1
            return found[0]
        if self.size > self.most:
            self.at = {b: [c, 0] for b, (c, hits) in self.at.items() if hits}
            self.size = sum(map(len, self.at))
            if self.size > self.most // 2:
                self.at, self.size = {}, 0
        self.at[block] = [here, 0]
        self.size += len(block)
        return here


def _cut(block_bytes: int):
    def run(batches):
        seen = _Seen(SEEN_BYTES)
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                rows = [[] for _ in _CUT_ARROW]
                for uid, doc, text in zip(*(c.to_pylist() for c in batch.slice(part, 512).columns)):
                    data = (text or "").encode()
                    sha = hashlib.sha256(data).digest()
                    n = max(1, -(-len(data) // block_bytes))
                    for pos in range(n):
                        block = data[pos * block_bytes : (pos + 1) * block_bytes]
                        c_uid, c_pos = seen.carrier(block, (uid, pos))
                        own = (c_uid, c_pos) == (uid, pos)
                        for to, x in zip(rows, (uid, doc, None if pos else sha, pos, n, c_uid, c_pos, block if own else None)):
                            to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, _CUT_ARROW)], schema=_CUT_ARROW)

    return run


def _name(batches):
    """Number the sorted blocks of a partition where neighbours differ; rows without bytes pass."""
    name = TaskContext.get().partitionId() << 40
    last = None
    for batch in batches:
        names = []
        for block in batch.column("content"):
            block = block.as_py()
            if block is None:
                names.append(None)
                continue
            if last is not None and block != last:
                name += 1
            last = block
            names.append(name)
        cols = [batch.column(f.name) for f in _NAMED_ARROW if f.name != "name"]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.int64())], schema=_NAMED_ARROW)


def block_names(docs: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of each row of ``docs`` (uid, doc_id, text): its integer name."""
    cut = docs.select("uid", "doc_id", "text").mapInArrow(_cut(block_bytes), _CUT)
    dealt = cut.repartition(F.when(F.col("content").isNotNull(), F.xxhash64("content")).otherwise(F.xxhash64("uid", "pos"))).sortWithinPartitions("content")
    named = dealt.mapInArrow(_name, _CUT.replace("content binary", "name long"))
    by_carrier = Window.partitionBy("c_uid", "c_pos")
    return scratch.write(named.select("uid", "doc_id", "sha", "pos", "n_blocks", F.max("name").over(by_carrier).alias("name")), "blocks")


def fold_names(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """Pair adjacent names and name the pairs until each uid has one: (uid, name)."""
    done, level = [], 0
    now = blocks.filter("n_blocks > 1").select("uid", "pos", "name", F.col("n_blocks").alias("width"))
    while not now.isEmpty():
        level += 1
        even = F.col("pos") % 2 == 0
        pairs = scratch.write(
            now.groupBy("uid", F.shiftright("pos", 1).alias("pos")).agg(
                F.max(F.when(even, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
                F.shiftright(F.max("width") + 1, 1).alias("width"),
            ),
            f"pairs{level}",
        )
        # numbered as they are written, so that no two pairs share a name
        distinct = pairs.select("a", "b").distinct().sortWithinPartitions("a", "b")
        names = scratch.write(distinct.withColumn("name", F.monotonically_increasing_id()), f"names{level}")
        named = scratch.write(pairs.join(names, ["a", "b"]).select("uid", "pos", "name", "width"), f"level{level}")
        scratch.drop(f"pairs{level}", f"names{level}")
        done.append(named.filter("width = 1").select("uid", "name"))
        now = named.filter("width > 1")
    out = blocks.filter("false").select("uid", "name")
    for x in done:
        out = out.unionByName(x)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, uid_col: str | None = None) -> DataFrame:
    """Groups of rows with identical texts; of a group the row with the largest id stays.

    Returns one row per row of ``docs``: uid long (a number of the row, or what
    ``uid_col`` names), doc_id, keep_id (id of the row that stays), keep_uid,
    group_size, kept, text_sha256.

    A null text counts as empty. A null id sorts below all others. Of rows that
    share text and id, one stays. A text of any length is read whole and is as
    many blocks as it takes. An empty table gives an empty result. Other columns,
    whatever their names, are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "exact")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(uid_col).alias("uid")] if uid_col else []))
    blocks = block_names(docs if uid_col else numbered(docs, scratch), scratch, block_bytes)
    folded = fold_names(blocks, scratch)
    first = blocks.filter("pos = 0")
    short = first.filter("n_blocks = 1").select("uid", "doc_id", "sha", "n_blocks", "name")
    long = first.filter("n_blocks > 1").drop("name").join(folded, "uid").select("uid", "doc_id", "sha", "n_blocks", "name")
    texts = scratch.write(short.unionByName(long), "texts")
    best = F.max(F.struct("doc_id", (-F.col("uid")).alias("back"))).alias("best")
    groups = texts.groupBy("n_blocks", "name").agg(best, F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    groups = scratch.write(groups.select("n_blocks", "name", F.col("best.doc_id").alias("keep_id"), (-F.col("best.back")).alias("keep_uid"), "group_size"), "groups")
    scratch.drop("blocks")
    alone = F.col("group_size").isNull()
    return texts.join(groups, ["n_blocks", "name"], "left").select(
        "uid",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("keep_uid", "uid").alias("keep_uid"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_groups` drops; all columns as they were, whatever their names."""
    scratch = Scratch(docs.sparkSession, "copies")
    uid = fresh_name(docs, "__uid")
    rows = numbered(docs, scratch, uid)
    gone = exact_groups(rows, id_col, text_col, uid_col=uid).filter("not kept").select(F.col("uid").alias(uid))
    return rows.join(gone, uid, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
