"""Byte-pair encoding and decoding with a contiguous rank array.

A word's parts, from boundary to boundary, and the ranks of its adjacent pairs
are two short arrays. The least rank is looked for by a scan, the boundary between its two
parts is deleted, and the ranks on either side are looked up anew, until no pair
has a rank. Words of over ``SHORT`` symbols, for which scans would be slow, go by
a heap over the same pairs in the same order: least rank first, leftmost first.

The vocabulary file is read as data (normaliser, split pattern, merges); words
are encoded here, not by the library that the file belongs to. Supported: byte
level vocabularies with NFC, white space and lower-case normalisation, a split
pattern, an end-of-word suffix, and special tokens.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.word_ids import CACHE_CHUNKS, Kept, Table, batches_by_size, cache, chunked, cut_lowered, joined, little, load_tokenizer
from noteloom.runtime import ship

SHORT = 200
#: Bytes of the cache of words; characters coded at a time.
CACHE_BYTES = 64 << 20
GROUP = 3 << 20
SPAN = 1 << 20  # ids are below this
NO_RANK = 1 << 60


def byte_letters() -> list[str]:
    """Byte level alphabet: printable Latin-1 stands for itself, the rest for letters from U+0100 on."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, rest = {b: chr(b) for b in same}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b], rest = chr(rest), rest + 1
    return [letters[b] for b in range(256)]


def merge_scan(parts: list[int], pairs: dict) -> list[int]:
    """Parts of a short word: scan for the least rank, delete that boundary, refresh its neighbours.

    parts: the id of the part between each two boundaries. pairs: for left id *
    SPAN + right id, rank * SPAN + id of what they merge into.
    """
    rank = pairs.get
    near = [rank(a * SPAN + b, NO_RANK) for a, b in zip(parts, parts[1:])]
    while near:
        least = min(near)
        if least == NO_RANK:
            break
        i = near.index(least)
        part = parts[i] = least % SPAN
        del parts[i + 1], near[i]
        if i < len(near):
            near[i] = rank(part * SPAN + parts[i + 1], NO_RANK)
        if i:
            near[i - 1] = rank(parts[i - 1] * SPAN + part, NO_RANK)
    return parts


def merge_heap(parts: list, pairs: dict) -> list[int]:
    """The same parts for a long word."""
    n = len(parts)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i) for i in range(n - 1) if (r := pairs.get(parts[i] * SPAN + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j < 0 or pairs.get(parts[i] * SPAN + parts[j]) != r:
            continue
        parts[i] = r % SPAN
        parts[j] = None
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (x := pairs.get(parts[i] * SPAN + parts[k])) is not None:
                heapq.heappush(heap, (x, i))
        if (h := before[i]) >= 0 and (x := pairs.get(parts[h] * SPAN + parts[i])) is not None:
            heapq.heappush(heap, (x, h))
    return [p for p in parts if p is not None]


class RankBPE:
    """Encoder and decoder over a vocabulary file's text."""

    def __init__(self, data: str):
        spec = json.loads(data)
        model = spec["model"]
        if model["type"] != "BPE" or spec["decoder"] is not None or spec["normalizer"] is None:
            raise ValueError("not a vocabulary of the supported kind")
        self.vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.pairs = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pairs[self.vocab[a] * SPAN + self.vocab[b]] = r * SPAN + self.vocab[a + b]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.names = pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 1)], pa.large_string())
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.cut_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.first = [self.vocab[x] for x in byte_letters()]
        self.last = [self.vocab[x + self.suffix] for x in byte_letters()]
        self.bytes_of = {x: b for b, x in enumerate(byte_letters())}
        self.kept = Kept(CACHE_CHUNKS, CACHE_BYTES, lambda values: (88 + 8 * len(v) for v in values))
        self.data, self.library = data, None

    def word(self, data: bytes) -> list[int]:
        found = self.kept.get(data)
        if found is None:
            first = self.first
            parts = [first[b] for b in data]
            parts[-1] = self.last[data[-1]]
            found = (merge_scan if len(parts) <= SHORT else merge_heap)(parts, self.pairs)
            self.kept.put(data, found)
        return found

    def plain(self, text: str) -> list[int]:
        if text.isascii():
            return [i for w in self.pattern.findall(text.lower()) for i in self.word(w.encode())]
        if not unicodedata.is_normalized("NFC", text) or any(unicodedata.combining(c) or unicodedata.category(c) == "Cn" for c in text):
            # tables of marks and of new letters differ: ask the library how it normalises and splits
            if self.library is None:
                self.library = load_tokenizer(self.data)
            words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [i for w, _ in words for i in self.word(bytes(map(self.bytes_of.__getitem__, w)))]
        text = "".join(c.lower() for c in text)  # letter by letter: no rule for a final sigma
        return [i for w in self.pattern.findall(text) for i in self.word(w.encode())]

    def chunk(self, text: str) -> list[int]:
        """Ids of a text. Special tokens are found first, in the text as it is."""
        if self.cut_special is None or "<" not in text:
            return self.plain(text)
        out: list[int] = []
        for k, piece in enumerate(self.cut_special.split(text)):
            if k % 2:
                out.append(self.special[piece])
            else:
                out += self.plain(piece)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for c in cut_lowered(text) for i in self.chunk(c)]

    def decode(self, ids) -> str:
        return " ".join(self.tokens[int(i)] for i in ids)

    def decode_all(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """:meth:`decode` of many texts, whose ids stand one after the other."""
        return joined(self.names, ids, np.cumsum(sizes), " ")


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """Ids of every whole text and the text they decode to: doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded, and the SHA-256 of both.

    With ``full=False`` ids and decoded stay behind, for callers that need digests only.
    A null text counts as empty and has no ids. Ids of documents may be null or
    repeat; each row gives one row, copies too. Texts are coded whole, however
    long; a word of any length takes time in proportion, but for a logarithm. An
    empty table gives an empty result. Columns other than those named aren't read,
    whatever their names. No shuffle: rows stay where they are.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # one vocabulary file, whatever the corpus
    names = ["doc_id", "n_tokens", *(["ids", "decoded"] if full else []), "ids_sha256", "decoded_sha256"]
    kinds = {"doc_id": "long", "n_tokens": "long", "ids": "binary"}
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    arrow = pa.schema([arrow.field(n) for n in names])

    def run(batches):
        data = vocabulary.value
        bpe, kept = cache(("rank chunks", zlib.crc32(data.encode())), lambda: (RankBPE(data), Table()))

        def make(chunks):
            return pa.array([little(bpe.chunk(c)) for c in chunks.to_pylist()], pa.large_binary())

        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for group in batches_by_size(rows, lambda r: len(r[1] or ""), GROUP):
                codes, ends, chunks = chunked([text or "" for _, text in group], cut_lowered)
                ids = joined(kept.values(chunks, make), codes, ends, b"")
                sizes = pc.binary_length(ids).to_numpy() // 4
                flat = np.frombuffer(b"".join(ids.to_pylist()), "<u4")
                cols = {"doc_id": [d for d, _ in group], "n_tokens": sizes, "ids": ids.to_pylist(), "decoded": bpe.decode_all(flat, sizes).to_pylist()}
                cols["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in cols["ids"]]
                cols["decoded_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in cols["decoded"]]
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))
