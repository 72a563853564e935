"""Byte-level BPE by forced boundaries: encoding of fragments, and decoding.

A pair of bytes that stands in no token of the vocabulary can never be merged over, so a text may be cut there. Not
every such cut is safe for the split into words that comes before the merges (a contraction or the last space of a
run look at what stands around them), so cuts are made where that split cannot notice: before ASCII white space, and
between ASCII letters, digits and marks, but at no apostrophe. Each different fragment of a slice is encoded once and
remembered; a text's ids are those of its fragments one after the other. A fragment of letters is one word, so its
bytes are merged directly; other ASCII fragments are split into words first, and what holds special tokens or other
characters goes through the tokenizers library.

Vocabularies are given by the path of a tokenizers file, which is read on the driver (a megabyte or two) and
sent along with the tasks.

Defined cases: a null or empty text has no ids; strings of special tokens in a text become their ids, as the library
does by default; ids outside the vocabulary decode to nothing; bytes that are no UTF-8 decode to U+FFFD; a column
named as the result is replaced; a very long text is a slice of its own; repeated rows are encoded one by one; no documents give no rows.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import words as W

#: Parameters: what a task remembers is dropped when it exceeds one of these.
MAX_FRAGMENTS = 200_000
MAX_FRAGMENT_BYTES = 8 << 20

_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LETTERS = [c for c in range(128) if chr(c).isalpha()]
_DIGITS = [c for c in range(128) if chr(c).isdigit()]
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]

#: The split into words of byte-level vocabularies.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# Bytes of letters up to U+024F: ASCII letters, lead bytes from C3 to C9 and what follows them; of these only U+00D7
# and U+00F7 are none.
_LETTER = np.zeros(256, bool)
_LETTER[[*_LETTERS, *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = True
_NO_LETTER = np.zeros(1 << 16, bool)
_NO_LETTER[[0xC397, 0xC3B7]] = True


def _byte_of_char() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _pair(merge: str | list[str]) -> list[str]:
    return merge.split(" ") if isinstance(merge, str) else merge


def read_vocabulary(path: str) -> str:
    """The text of a tokenizers file; checks that it is byte-level BPE without changes to the text before."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    held = json.loads(text)
    before = held.get("pre_tokenizer") or {}
    if held["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or held.get("normalizer"):
        raise ValueError("byte-level BPE without a normalizer is needed")
    ids = [held["model"]["vocab"]["".join(pair)] for pair in map(_pair, held["model"]["merges"])]
    if ids != sorted(ids):
        raise ValueError("ids must follow the order of merges")
    if before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("the split into words must be the usual one, without a space put in front")
    return text


class Codec:
    """Encoder and decoder of one vocabulary, with the fragments seen so far."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        import tiktoken

        byte_of = _byte_of_char()
        added = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        tokens = {i: bytes(byte_of[c] for c in t) for t, i in self.tokenizer.get_vocab(False).items() if i not in added}
        ranks = {t: i for i, t in tokens.items()}
        self.merger = tiktoken.Encoding("merges", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.special = list(added.values())
        tokens |= added
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        lengths = np.array([len(t) for t in self.tokens])
        self.token_end = np.concatenate([[0], np.cumsum(lengths)])
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.cuts = self._cut_table()
        self.forget()

    def _cut_table(self) -> np.ndarray:
        """For each pair of bytes, whether a text may be cut between them."""
        met = np.zeros((256, 256), bool)
        for token in self.tokens:
            held = np.frombuffer(token, np.uint8)
            met[held[:-1], held[1:]] = True
        safe = np.zeros((256, 256), bool)
        safe[:, list(W.SPACE_BYTES)] = True
        safe[np.ix_(_LETTERS + _DIGITS + _MARKS, _LETTERS + _DIGITS + _MARKS)] = True
        return (safe & ~met).reshape(-1)

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ends = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.held_bytes = 0

    def _encode_mixed(self, fragment: bytes) -> list[int]:
        """Ids of a fragment that is more than one word of plain letters."""
        text = fragment.decode("utf-8", "replace")
        if fragment.isascii() and not any(special in fragment for special in self.special):
            return self.merger.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, fragments: dict[bytes, bool]) -> None:
        if len(self.index) + len(fragments) > MAX_FRAGMENTS or self.held_bytes > MAX_FRAGMENT_BYTES:
            self.forget()
        merge = self.merger._core_bpe.encode_single_piece
        ids = [merge(f) if word else self._encode_mixed(f) for f, word in fragments.items()]
        self.index.update(zip(fragments, range(len(self.index), len(self.index) + len(fragments))))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))])
        self.held_bytes += sum(map(len, fragments))

    def _places(self, fragments: list[bytes], words: list[bool]) -> np.ndarray:
        """Where the ids of the fragments stand; new ones are encoded."""
        held = list(map(self.index.get, fragments))
        if None in held:
            new = {f: word for f, word, at in zip(fragments, words, held) if at is None}
            if len(self.index) + len(new) > MAX_FRAGMENTS or self.held_bytes > MAX_FRAGMENT_BYTES:
                new = dict(zip(fragments, words))
            self._learn(new)
            held = list(map(self.index.__getitem__, fragments))
        return np.array(held, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and where each text's ids begin."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        pair = (data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = self.cuts[pair]
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        chosen, same_as = _different(data, edges)
        start, end = edges[chosen], edges[chosen + 1]
        other = np.zeros(len(data) + 1, np.int32)
        np.cumsum(~_LETTER[data] | np.append(_NO_LETTER[pair], False), out=other[1:])
        first = start + (data[start] == 32)
        word = (other[end] == other[first]) & (end > first)
        whole = data.tobytes()
        fragments = [whole[a:b] for a, b in zip(start.tolist(), end.tolist())]
        at = self._places(fragments, word.tolist())[same_as]
        begin = self.ends[at]
        out_end = np.concatenate([[0], np.cumsum(self.ends[at + 1] - begin)])
        return self.ids[spread(begin, out_end)], out_end[np.searchsorted(edges, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        ids = np.where((ids >= 0) & (ids < len(self.tokens)), ids, len(self.tokens)).astype(np.int64)
        starts = np.append(self.token_end[:-1], 0)
        lengths = np.append(np.diff(self.token_end), 0)
        out_end = np.concatenate([[0], np.cumsum(lengths[ids])])
        whole = self.token_bytes[spread(starts[ids], out_end)].tobytes()
        at = out_end[offsets].tolist()
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


def _different(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each different fragment, and for every fragment which of them it equals.

    Fragments up to 16 bytes are told apart by their bytes as two numbers and their length; longer ones are all kept.
    """
    start, length = edges[:-1], np.diff(edges)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    low = eight[start] & _FIRST_BYTES[np.minimum(length, 8)]
    high = eight[np.minimum(start + 8, len(data))] & _FIRST_BYTES[np.clip(length - 8, 0, 8)]
    key = W.mix(low + W.mix(high + W.mix(length.astype(np.uint64))))
    key = np.where(length > 16, W.mix(start.astype(np.uint64)), key)
    _, chosen, same_as = np.unique(key, return_index=True, return_inverse=True)
    of = chosen[same_as]
    if np.any((low != low[of]) | (high != high[of]) | (length != length[of]) | ((length > 16) & (start != start[of]))):
        return np.arange(len(start)), np.arange(len(start))  # two keys fell together: keep all fragments
    return chosen, same_as


def spread(begin: np.ndarray, out_end: np.ndarray) -> np.ndarray:
    """Indices begin[k], begin[k] + 1, … of all pieces one after the other."""
    return np.repeat(begin - out_end[:-1], np.diff(out_end)) + np.arange(out_end[-1])


@functools.lru_cache(maxsize=2)
def codec(vocabulary: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    return Codec(vocabulary)


def encode(docs: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """``docs`` with the ids of the whole text as an array of integers."""
    vocabulary = read_vocabulary(path)
    docs = docs.drop(column)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            for row, end, data, offsets in W.text_slices(batch.column("text")):
                ids, at = own.encode(data, offsets)
                made = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, column])

    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``docs`` with the ids of the text and the text that these ids decode to, in one pass and by one codec per task."""
    vocabulary = read_vocabulary(path)
    docs = docs.drop(ids, column)
    more = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(column, T.StringType())]
    schema = T.StructType([*docs.schema.fields, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            for row, end, data, offsets in W.text_slices(batch.column("text")):
                found, at = own.encode(data, offsets)
                made = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found)), pa.array(own.decode(found, at), pa.string())]
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, ids, column])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``tokens`` with the text of the array ``ids``; a null array is an empty text."""
    vocabulary = read_vocabulary(path)
    tokens = tokens.drop(column)
    schema = T.StructType([*tokens.schema.fields, T.StructField(column, T.StringType())])
    step = 1 << 18

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            held = batch.column(ids)
            if held.null_count:
                held = pa.array([x or [] for x in held.to_pylist()], held.type)
            offsets = np.asarray(held.offsets, np.int64)
            values = held.values.fill_null(-1).to_numpy()
            row = 0
            while row < len(batch):
                end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + step, "right")) - 1)
                texts = own.decode(values[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, column])
                row = end

    return tokens.mapInArrow(run, schema)
