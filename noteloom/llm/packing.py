"""Vector bin packing of token sequences.

An item has three sizes: tokens, segments (one) and loss-bearing tokens, which
are its last ones (a response behind its prompt); a sequence has a limit on each. An open sequence takes, of the items that fit into
what it has left, the one with the largest dot product of its sizes and the
space left, both as shares of the limits: large items while there is room, and
items that use what is plentiful. Items are kept in a window of bounded size, so
a task's memory doesn't grow with its rows, and each task packs its own rows:
there is no shuffle, and a repeated task packs alike.

Documents may be cut: what exceeds a sequence fills whole sequences, and if
nothing fits a gap, the best item is cut to fill it. A task's last open sequence
would be padded; its tokens are cut into sequences whose lengths are powers of
two, which need no padding. With ``cut=False`` (instruction data) an item is
never cut; one that exceeds a limit on its own gets a sequence of its own, and
its row says so (``over_limit``).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.word_ids import GROUP, Table, batches_by_size, cache, cut_before_spaces, keyed_ids, library_encoder
from noteloom.runtime import ship

TOKENS = 1024
WINDOW = 1024


class Packer:
    """Places items (any object) with sizes (tokens, loss-bearing tokens); yields (sequence, [(item, start, length, offset)])."""

    def __init__(self, tokens: int = TOKENS, segments: int | None = None, loss: int | None = None, cut: bool = True, window: int = WINDOW):
        self.limits = np.array([tokens, segments or tokens, loss or tokens], float)  # a segment has a token at least
        self.cut, self.window = cut, window
        self.items: list = [None] * (window + 1)
        self.sizes = np.zeros((window + 1, 3))  # a free place has no segment
        self.start = np.zeros(window + 1, np.int64)
        self.free = list(range(window, -1, -1))
        self.sequence = 0
        self.open: list = []
        self.left = self.limits.copy()

    def close(self):
        if self.open:
            yield self.sequence, self.open
            self.sequence, self.open, self.left = self.sequence + 1, [], self.limits.copy()

    def place(self, k: int, length: int) -> None:
        tokens, _, loss = self.sizes[k]
        part = np.array([length, 1, max(0, length - (tokens - loss))])
        self.open.append((self.items[k], int(self.start[k]), int(length), int(self.limits[0] - self.left[0])))
        self.left -= part
        if length < tokens:
            self.sizes[k] -= part * [1, 0, 1]
            self.start[k] += length
        else:
            self.sizes[k] = 0
            self.items[k] = None
            self.free.append(k)

    def step(self):
        """Place one item of the window, or close the open sequence."""
        held = self.sizes[:, 1] > 0
        fits = held & (self.sizes <= self.left).all(1)
        score = self.sizes @ (self.left / self.limits**2)
        if fits.any():
            k = int(np.where(fits, score, -1).argmax())
            self.place(k, int(self.sizes[k, 0]))
        elif self.cut and self.left[1] >= 1 and (room := np.where(held, np.minimum(self.left[0], self.sizes[:, 0] - self.sizes[:, 2] + self.left[2]), 0)).max() >= 1:
            k = int(np.where(room >= 1, score, -1).argmax())
            self.place(k, int(room[k]))
        elif not self.open:  # exceeds a limit on its own
            k = int(np.where(held, score, -1).argmax())
            self.place(k, int(self.sizes[k, 0]))
            yield from self.close()
        else:
            yield from self.close()
        if self.left[0] <= 0:
            yield from self.close()

    def add(self, item, tokens: int, loss: int | None = None):
        loss = tokens if loss is None else loss
        start = 0
        if self.cut and loss == tokens:
            whole = int(min(self.limits[0], self.limits[2]))
            while tokens - start > whole:
                yield self.sequence, [(item, start, whole, 0)]
                self.sequence += 1
                start += whole
        k = self.free.pop()
        self.items[k], self.start[k] = item, start
        self.sizes[k] = (tokens - start, 1, loss - start if loss == tokens else loss)
        while not self.free:
            yield from self.step()

    def finish(self):
        while len(self.free) <= self.window:
            yield from self.step()
        pieces, self.open = self.open, []
        if not self.cut:
            if pieces:
                yield self.sequence, pieces
                self.sequence += 1
            return
        room, at, out = 0, 0, []
        total = sum(length for _, _, length, _ in pieces)
        for item, start, length, _ in pieces:
            while length:
                if not room:
                    room, at = 1 << (total.bit_length() - 1), 0
                    total -= room
                n = min(room, length)
                out.append((item, start, n, at))
                start, length, room, at = start + n, length - n, room - n, at + n
                if not room:
                    yield self.sequence, out
                    self.sequence, out = self.sequence + 1, []


_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_texts(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 0,
    tokens: int = TOKENS,
    segments: int | None = None,
    loss: int | None = None,
    cut: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    loss_col: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Encode texts, append ``end_id`` to each, and pack them into sequences.

    Returns one row per piece: doc_id, start (ids of its document before it),
    length, ids_crc32, doc_tokens, sequence_id, offset in the sequence and, if
    asked, ids (little-endian unsigned 32-bit). ``loss_col`` names a column with
    the number of loss-bearing tokens, a document's last ones with its end id
    (all of them if not given; null: all). Without ``cut`` a column over_limit
    says whether a document exceeds a limit on its own. ``segments`` and ``loss``:
    no limit if None.

    A null text counts as empty and is a piece with the end id alone. Ids of
    documents may be null or repeat: every row is packed, copies too. A text of
    any length is cut over as many sequences as it fills; its ids are held by one
    task at a time. An empty table gives an empty result. Columns other than those
    named aren't read, whatever their names. ``docs`` must be a table or another
    plan that yields the same rows in the same order when a task is repeated.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # one vocabulary file, whatever the corpus
    schema = _OUT + ("" if cut else ", over_limit boolean") + (", ids binary" if with_ids else "")
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])

    def run(batches):
        base = TaskContext.get().partitionId() << 40
        data = vocabulary.value
        kept, encode = cache(("before spaces", zlib.crc32(data.encode())), lambda: (Table(), library_encoder(data)))
        end = np.array([end_id], "<u4").tobytes()
        packer = Packer(tokens, segments, loss, cut)
        rows: list[list] = [[] for _ in arrow]

        def take(sequences):
            for sequence, pieces in sequences:
                for (doc, data, borne), start, length, offset in pieces:
                    ids = data[4 * start : 4 * (start + length)]
                    over = () if cut else (length > tokens or borne > (loss or tokens),)
                    for to, x in zip(rows, (doc, start, length, zlib.crc32(ids), len(data) // 4, base + sequence, offset, *over, ids)):
                        to.append(x)

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, arrow)], schema=arrow)
            for x in rows:
                x.clear()
            return out

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for group in batches_by_size(zip(*cols), lambda r: len(r[1] or ""), GROUP):
                coded = keyed_ids([r[1] or "" for r in group], cut_before_spaces, encode, kept)
                for r, ids in zip(group, coded):
                    n = len(ids) // 4 + 1
                    borne = n if len(r) < 3 or r[2] is None else min(max(int(r[2]), 0), n)
                    take(packer.add((r[0], ids + end, borne), n, borne))
                yield flush()
        take(packer.finish())
        yield flush()

    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(loss_col).cast("long").alias("loss")] if loss_col else [])]
    return docs.select(*cols).mapInArrow(run, schema)
