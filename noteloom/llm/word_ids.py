"""Token ids of whole texts, built from the ids of their chunks.

A tokenizer that splits text before it merges gives a text the ids of its chunks
in order, if the chunks end where it always splits. Natural text repeats its
words, so ids of chunks are kept per Python worker, within a bound in bytes, as
little-endian bytes; only chunks not met before reach the tokenizer, in batches.
Arrow cuts many texts at a time, finds their distinct chunks, looks these up, and
joins what each text has of them.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

CACHE_CHUNKS = 4_000_000
CACHE_BYTES = 192 << 20
TABLE_BYTES = 48 << 20
#: Characters of text that are cut and coded at a time.
GROUP = 3 << 20
#: What a dictionary takes for an entry, beside key and value.
ENTRY_BYTES = 104
#: A key or value over this size is worked out anew each time.
LONGEST = 1 << 10

_loaded: dict = {}
_slot: dict = {}


def loaded(key, make):
    """One object per key and Python worker process."""
    if key not in _loaded:
        _loaded[key] = make()
    return _loaded[key]


def cache(key, make):
    """The caches of one operator: a worker process that turns to another one drops those of the last."""
    if key not in _slot:
        _slot.clear()
        pa.default_memory_pool().release_unused()
        _slot[key] = make()
    return _slot[key]


def load_tokenizer(data: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(data)


class Kept:
    """A dictionary in two generations, bounded by entries and by bytes: the older goes when the younger is full.

    weigh(values): bytes of each of them. An entry with a key or value of over
    ``LONGEST`` bytes isn't kept.
    """

    def __init__(self, most: int = CACHE_CHUNKS, most_bytes: int = CACHE_BYTES, weigh=lambda values: map(sys.getsizeof, values)):
        self.most, self.most_bytes, self.weigh = most // 2, most_bytes // 2, weigh
        self.new, self.old, self.bytes = {}, {}, 0

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        self.add([key], [value])

    def add(self, keys: list, values: list) -> None:
        for i in range(0, len(keys), 4096):
            some, theirs = keys[i : i + 4096], values[i : i + 4096]
            sizes = [a + b for a, b in zip(map(sys.getsizeof, some), self.weigh(theirs))]
            if max(sizes) > LONGEST:
                few = [k for k, n in enumerate(sizes) if n <= LONGEST]
                some, theirs, sizes = [some[k] for k in few], [theirs[k] for k in few], [sizes[k] for k in few]
            if len(self.new) + len(some) > self.most or self.bytes >= self.most_bytes:
                self.new, self.old, self.bytes = {}, self.new, 0
            self.new.update(zip(some, theirs))
            self.bytes += sum(sizes) + ENTRY_BYTES * len(some)

    def values(self, keys: list, make) -> list:
        """The value of each of ``keys`` (distinct); make(list of keys) gives those of keys not kept."""
        out = list(map(self.new.get, keys))
        missing = [i for i, v in enumerate(out) if v is None]
        if missing:
            asked = [keys[i] for i in missing]
            older = list(map(self.old.get, asked))
            fresh = [k for k, v in zip(asked, older) if v is None]
            made = iter(make(fresh) if fresh else ())
            found = [next(made) if v is None else v for v in older]
            for i, v in zip(missing, found):
                out[i] = v
            self.add(asked, found)
        return out


class Table:
    """A dictionary from strings to bytes in two Arrow arrays, bounded in bytes.

    Many keys are looked up at a time. When it is full, entries stay that have been
    looked up since the last time; if these fill more than half, none stays.
    """

    def __init__(self, most_bytes: int = TABLE_BYTES):
        self.most_bytes = most_bytes
        self.clear()

    def clear(self) -> None:
        self.keys, self.data, self.used = pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.zeros(0, bool)

    def nbytes(self) -> int:
        return self.keys.nbytes + self.data.nbytes + self.used.nbytes

    def add(self, keys: pa.Array, data: pa.Array) -> None:
        small = pc.less_equal(pc.add(pc.binary_length(keys), pc.binary_length(data)), LONGEST)
        if not pc.all(small).as_py():
            keys, data = keys.filter(small), data.filter(small)
        self.keys, self.data = pa.concat_arrays([self.keys, keys]), pa.concat_arrays([self.data, data])
        self.used = np.concatenate([self.used, np.zeros(len(keys), bool)])
        if self.nbytes() > self.most_bytes:
            used = pa.array(self.used)
            self.keys, self.data = self.keys.filter(used), self.data.filter(used)
            self.used = np.zeros(len(self.keys), bool)
            if self.nbytes() > self.most_bytes // 2:
                self.clear()

    def values(self, keys: pa.Array, make) -> pa.Array:
        """The value of each of ``keys`` (distinct); make(keys) gives those of keys not kept."""
        at = pc.index_in(keys, value_set=self.keys)
        there = at.is_valid().to_numpy(zero_copy_only=False)
        known = at.drop_null().to_numpy()
        self.used[known] = True
        old = self.data.take(pa.array(known))
        if there.all():
            return old
        fresh = keys.filter(pa.array(~there))
        made = make(fresh)
        self.add(fresh, made)
        place = np.empty(len(keys), np.int64)
        place[there], place[~there] = np.arange(len(old)), len(old) + np.arange(len(made))
        return pa.concat_arrays([old, made]).take(pa.array(place))


def chunked(texts, cut):
    """(codes, ends, chunks): the distinct chunks of all texts, and the places of each text's chunks among them, up to its end.

    A ``cut`` in ``MARKS`` is made for many texts at a time, by marks that Arrow
    puts between chunks; texts that its marks can't cut, one by one.
    """
    if cut in MARKS:
        odd, ready, begins = MARKS[cut]
        texts = list(map(ready, texts))
        whole = pa.array(texts, pa.large_string())
        skip = pc.match_substring_regex(whole, odd)
        lists = [cut(t) if x else None for t, x in zip(texts, skip.to_pylist())]
        whole = pc.if_else(skip, pa.scalar(None, pa.large_string()), whole)
        for old, new in begins:
            whole = pc.replace_substring(whole, old, new)
    else:
        lists = [cut(t) for t in texts]
        whole = pa.nulls(len(texts), pa.large_string())
    split = pc.split_pattern(whole, MARK)
    values, sizes = split.values, np.diff(split.offsets.to_numpy())
    alone = [i for i, x in enumerate(lists) if x is not None]
    if alone:
        parts, start, pieces = np.concatenate([[0], np.cumsum(sizes)]), 0, []
        for i in alone:
            pieces += [values.slice(parts[start], parts[i] - parts[start]), pa.array(lists[i], pa.large_string())]
            sizes[i], start = len(lists[i]), i
        values = pa.concat_arrays([*pieces, values.slice(parts[start])])
    known = values.dictionary_encode()
    return known.indices.to_numpy(), np.cumsum(sizes), known.dictionary


def joined(values: pa.Array, codes, ends, between) -> pa.Array:
    """For each text the values (bytes or strings, one for each chunk) of its chunks, with ``between`` between them."""
    return pc.binary_join(pa.LargeListArray.from_arrays(np.concatenate([[0], ends]), values.take(pa.array(codes))), pa.scalar(between, values.type))


def keyed_ids(texts, cut, encode, kept):
    """For each text its ids as bytes. cut(text): its chunks; encode: a :class:`Library`; kept: a :class:`Table` or :class:`Kept`."""
    codes, ends, chunks = chunked(texts, cut)
    if isinstance(kept, Table):
        found = kept.values(chunks, lambda fresh: encode.coded(fresh, kept))
    else:
        found = pa.array(kept.values(chunks.to_pylist(), encode), pa.large_binary())
    return joined(found, codes, ends, b"").to_pylist()


def little(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


# Split patterns of the two kinds of vocabulary. \p{L} and \p{N} are taken for Latin text only, on which all tables agree.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOWERED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks that are one piece, in lower case already.
WHOLE_BYTE_LEVEL = r"\A ?(\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)\z"
WHOLE_LOWERED = r"\A(\p{Ll}+|\p{N}|[^\s\p{L}\p{N}]+)\z"
NOT_LATIN = r"[^\x00-\x{24f}]|[\x{1c}-\x{1f}\x{85}\x{a0}]|<\|"


class Library:
    """Ids of chunks, by the library.

    A chunk of Latin letters and ASCII signs is cut into the pieces that the
    vocabulary's split pattern makes of it; pieces repeat more than chunks do. New
    pieces are sent to the library in one text for many, which spares it the making
    of a result for each: byte level pieces between line breaks, each of which is
    one id, and lower-case words between spaces, as their last ids carry the end of
    word. All other chunks are sent one by one.
    """

    def __init__(self, data: str):
        spec = json.loads(data)
        self.full = self.inner = load_tokenizer(data)
        self.pieces = self.last = self.line = None
        self.lower = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        suffix = spec["model"].get("end_of_word_suffix")
        if self.lower and suffix and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == LOWERED:
            spec["normalizer"] = None  # NFC leaves Latin letters as they are; they are lower-cased here
            self.inner = load_tokenizer(json.dumps(spec))
            self.last = np.zeros(self.inner.get_vocab_size(), bool)
            self.last[[i for t, i in self.inner.get_vocab().items() if t.endswith(suffix)]] = True
            self.pieces, self.whole = regex.compile(LOWERED).findall, WHOLE_LOWERED
        elif spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and spec["pre_tokenizer"]["use_regex"]:
            line = self.full.encode("\n", add_special_tokens=False).ids
            if len(line) == 1:
                self.line = line[0]
                self.pieces, self.whole = regex.compile(BYTE_LEVEL).findall, WHOLE_BYTE_LEVEL

    def single(self, tokenizer, chunks: list[str]) -> pa.Array:
        ids = (little(e.ids) for i in range(0, len(chunks), 2000) for e in tokenizer.encode_batch_fast(chunks[i : i + 2000], add_special_tokens=False))
        return pa.array(ids, pa.large_binary())

    def together(self, pieces: pa.Array) -> pa.Array:
        """Ids of pieces from one text that holds them all."""
        text = joined(pieces, np.arange(len(pieces)), [len(pieces)], " " if self.line is None else "\n")[0].as_py()
        ids = np.array(self.inner.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        if self.line is None:
            ends = np.flatnonzero(self.last[ids]) + 1
            whole = len(ends) == len(pieces) and ends[-1] == len(ids)
        else:
            between = np.flatnonzero(ids == self.line)
            whole = len(between) == len(pieces) - 1
            ends = np.concatenate([between - np.arange(len(between)), [len(ids) - len(between)]])
            ids = np.delete(ids, between)
        if not whole:
            return self.single(self.inner, pieces.to_pylist())
        offsets = np.concatenate([[0], 4 * ends]).astype("<i8")
        return pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())])

    def of_pieces(self, pieces: pa.Array) -> pa.Array:
        parts = [self.together(pieces.slice(i, 1000)) for i in range(0, len(pieces), 1000)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.large_binary())

    def of_several(self, chunks: list[str], kept: Table) -> pa.Array:
        """Ids of chunks of several pieces, or of white space."""
        cut = [self.pieces(c.lower() if self.lower else c) for c in chunks]
        flat = pa.array([p for x in cut for p in x], pa.large_string()).dictionary_encode()
        blank = pc.utf8_is_space(flat.dictionary)

        def make(fresh):
            spaces = pc.utf8_is_space(fresh)
            order = np.argsort(np.concatenate([np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (pc.invert(spaces), spaces)]))
            return pa.concat_arrays([self.of_pieces(fresh.filter(pc.invert(spaces))), self.single(self.inner, fresh.filter(spaces).to_pylist())]).take(pa.array(order))

        found = kept.values(flat.dictionary, make) if len(blank) else pa.array([], pa.large_binary())
        return joined(found, flat.indices.to_numpy(), np.cumsum([len(x) for x in cut], dtype=np.int64), b"")

    def coded(self, chunks: pa.Array, kept: Table) -> pa.Array:
        if self.pieces is None:
            return self.single(self.full, chunks.to_pylist())
        fine = pc.invert(pc.match_substring_regex(chunks, NOT_LATIN))
        one = pc.and_(fine, pc.match_substring_regex(chunks, self.whole))
        kinds = [x.to_numpy(zero_copy_only=False) for x in (one, pc.and_not(fine, one), pc.invert(fine))]
        parts = [
            self.of_pieces(chunks.filter(pa.array(kinds[0]))),
            self.of_several(chunks.filter(pa.array(kinds[1])).to_pylist(), kept),
            self.single(self.full, chunks.filter(pa.array(kinds[2])).to_pylist()),
        ]
        order = np.argsort(np.concatenate([np.flatnonzero(k) for k in kinds]))
        return pa.concat_arrays(parts).take(pa.array(order))

    def __call__(self, chunks: list[str]) -> list[bytes]:
        return self.coded(pa.array(chunks, pa.large_string()), Table()).to_pylist()


def library_encoder(data: str) -> Library:
    return Library(data)


_NOT_LATIN = re.compile(r"[^\x00-\u024f]|[\x1c-\x1f\x85\xa0]|<\|")


def latin(text: str) -> bool:
    """Whether a text has Latin letters and ASCII or Latin-1 signs only, no rare white space, and nothing like a special token."""
    return _NOT_LATIN.search(text) is None


def lowered(text: str) -> str:
    """In lower case, if that is the library's lower case."""
    return text.lower() if ("<|" not in text if text.isascii() else latin(text)) else text


def cut_lowered(text: str) -> list[str]:
    """As :func:`cut_at_spaces`, for tokenizers that lower-case; words that differ in case only become one chunk."""
    return cut_at_spaces(lowered(text))


_RARE_SPACE = re.compile(r"[\t\x0b\x0c\r]")


def cut_at_spaces(text: str) -> list[str]:
    """For tokenizers that drop white space and never look across it. Chunks may be empty."""
    text = text.replace("\n", " ")
    if _RARE_SPACE.search(text):
        text = _RARE_SPACE.sub(" ", text)
    return text.split(" ")


def cut_words(text: str) -> list[str]:
    """What stands between white space, as Python has it."""
    return text.split()


#: White space of Unicode, which the tokenizers' \s means.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(rf"[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]?[^{_SPACE}]+")
_WITH_SPECIAL = re.compile(rf"[{_SPACE}]*[^{_SPACE}]*?<\|[^{_SPACE}]*|" + _CHUNK.pattern)


def cut_before_spaces(text: str) -> list[str]:
    """For byte-level tokenizers, whose tokens never hold a space behind another character.

    Words keep the one sign of white space before them; what comes before that in
    a longer stretch is a chunk of its own, as is white space at the end. What may
    be a special token, before which white space ends, keeps all that is before it.
    """
    return (_WITH_SPECIAL if "<|" in text else _CHUNK).findall(text)


#: Stands between chunks of texts that Arrow cuts; a text that holds it is cut alone.
MARK = "\x01"
#: For a way to cut: what in a text calls for cutting it alone, what is done to a text first, and where marks go.
MARKS = {
    cut_before_spaces: (
        r"[ \n][ \n][ \n]|[ \n][ \n]\z|[\x01\t\r\x0b\x0c\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\|",
        str,
        ((" ", MARK + " "), ("\n", MARK + "\n")),
    ),
    cut_words: (r"[\x01\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]", str, ((" ", MARK), ("\n", MARK))),
    cut_lowered: (r"[\x01\t\r\x0b\x0c]", lowered, ((" ", MARK), ("\n", MARK))),
}


def batches_by_size(rows, size, most: int = 1 << 19):
    """Lists of rows whose sizes add up to about ``most``."""
    group, total = [], 0
    for r in rows:
        group.append(r)
        total += size(r)
        if total >= most:
            yield group
            group, total = [], 0
    if group:
        yield group
