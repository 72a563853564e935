"""Fill-in-middle: every text is cut at two drawn unit boundaries and put together in another order.

The bytes of a slice of texts are mapped to eight character classes and held as a wavelet matrix of three bit vectors.
The number of unit boundaries before a place is the sum of the rank queries of the classes that begin a unit, so the
number of units of a text is a difference of two such counts, and the byte of the k-th boundary is found by bisection on
them. All texts of a slice are asked at once. A unit is a code point (``chars``) or a line break with what follows it
(``lines``; what stands before the first break belongs to the prefix).

A document's draws are the first four groups of eight hexadecimal digits of the SHA-256 of ``seed:doc_id``, so they do not
depend on the order of rows. The text can be rebuilt from the output alone (``restored``), as texts that hold one of
the marks stay plain.

Defined cases: a null text counts as empty and, like any empty text, is plain; a null ``doc_id`` draws from ``seed:`` without
an id; repeated rows, and rows of one id, are transformed one by one with the same draws; a very long text is a slice
of its own; without rows the result is empty; a column named ``llm_fim`` in the input is replaced. Names that begin with
``__llm`` are not for the input's columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

#: Parameters: the marks, the share of texts that is cut, the share of these that is written suffix first (percent).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUT_PERCENT = 90
SUFFIX_FIRST_PERCENT = 20
SEED = 1

RESULT = "llm_fim"
DRAWS = "__llm_draws"

CLASS_BITS = 3
INSIDE, BREAK, SPACE, WORD, OTHER, LEAD2, LEAD3, LEAD4 = range(1 << CLASS_BITS)
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[[c for c in range(128) if chr(c).isalnum()]] = WORD
CLASSES[list(W.SPACE_BYTES)] = SPACE
CLASSES[ord("\n")] = BREAK
CLASSES[0x80:0xC0] = INSIDE
CLASSES[0xC0:0xE0] = LEAD2
CLASSES[0xE0:0xF0] = LEAD3
CLASSES[0xF0:] = LEAD4
#: Classes whose bytes begin a unit.
UNITS = {"chars": (BREAK, SPACE, WORD, OTHER, LEAD2, LEAD3, LEAD4), "lines": (BREAK,)}

KIND = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_units", T.LongType()),
        T.StructField("middle_units", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)


class BitVector:
    """Ones before a place, from 64-bit words and the running count of their ones: two bits a bit."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, inside = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << inside) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    """A sequence of values of ``bits`` bits: how often a value stands before a place, in ``bits`` steps."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels: list[tuple[int, BitVector, int]] = []
        for shift in reversed(range(bits)):
            ones = (values >> shift & 1).astype(bool)
            self.levels.append((shift, BitVector(ones), len(ones) - int(ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        low = np.zeros_like(at)
        for shift, vector, zeros in self.levels:
            ones, low_ones = vector.rank(at), vector.rank(low)
            at, low = (zeros + ones, zeros + low_ones) if value >> shift & 1 else (at - ones, low - low_ones)
        return at - low


class Boundaries:
    """The unit boundaries of the texts of a slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str):
        self.matrix, self.begins = WaveletMatrix(CLASSES[data], CLASS_BITS), UNITS[unit]
        self.start, self.end = offsets[:-1], offsets[1:]
        counts = self.count(offsets)
        self.before, self.units = counts[:-1], np.diff(counts)

    def count(self, at: np.ndarray) -> np.ndarray:
        """Units that begin before each byte."""
        total = np.zeros(len(at), np.int64)
        for value in self.begins:
            total += self.matrix.rank(value, at)
        return total

    def place(self, unit: np.ndarray) -> np.ndarray:
        """The byte at which this unit of each text begins; the text's end for the one behind the last."""
        low, high, wanted = self.start.copy(), self.end.copy(), self.before + unit + 1
        while np.any(low < high):  # the first place with that many units before it
            middle = (low + high) >> 1
            enough = self.count(middle) >= wanted
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        return np.where(unit >= self.units, self.end, low - 1)


def draws(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """Four unsigned 32-bit numbers of each id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    digits = F.sha2(name, 256)
    return F.array(*[F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def _strings(pieces: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(pieces) + 1, np.int32)
    np.cumsum([len(p) for p in pieces], out=offsets[1:])
    return pa.StringArray.from_buffers(len(pieces), pa.py_buffer(offsets), pa.py_buffer(b"".join(pieces)))


def _transformed(column: pa.Array, data: np.ndarray, offsets: np.ndarray, drawn: np.ndarray, unit: str, marks: Sequence[str]) -> pa.StructArray:
    bounds = Boundaries(data, offsets, unit)
    n = bounds.units
    plain = (offsets[1:] == offsets[:-1]) | (drawn[:, 2] % 100 >= CUT_PERCENT)
    for mark in marks:
        plain |= pc.match_substring(column, mark).fill_null(False).to_numpy(zero_copy_only=False)
    spm = drawn[:, 3] % 100 < SUFFIX_FIRST_PERCENT
    one, two = drawn[:, 0] % (n + 1), drawn[:, 1] % (n + 1)
    first, second = np.minimum(one, two), np.maximum(one, two)
    at, to = bounds.place(first), bounds.place(second)
    prefix, suffix, middle = (m.encode() for m in marks)
    raw, outputs = data.tobytes(), []
    for k in range(len(n)):
        low, high = offsets[k], offsets[k + 1]
        if plain[k]:
            outputs.append(raw[low:high])
            continue
        head, tail = (prefix, raw[low : at[k]]), (suffix, raw[to[k] : high])
        outputs.append(b"".join([*((*tail, *head) if spm[k] else (*head, *tail)), middle, raw[at[k] : to[k]]]))
    forms = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    held = [pa.array(n), pa.array(forms.tolist(), pa.string()), pa.array(first, mask=plain), pa.array(second - first, mask=plain), _strings(outputs)]
    return pa.StructArray.from_arrays(held, [f.name for f in KIND.fields])


def fill_in_middle(docs: DataFrame, unit: str = "chars", seed: int = SEED, marks: Sequence[str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """``docs`` with the struct ``llm_fim``: units, form, units of prefix and middle (null if plain), and the output.

    No mark may hold the first character of a mark but at its own beginning.
    """
    given = docs.drop(RESULT)
    schema = T.StructType([*given.schema.fields, T.StructField(RESULT, KIND)])

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            drawn = batch.column(DRAWS).flatten().to_numpy().reshape(-1, 4)
            for row, end, data, offsets in W.text_slices(texts):
                made = _transformed(texts.slice(row, end - row), data, offsets, drawn[row:end], unit, marks)
                own = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], made], [*own.schema.names[:-1], RESULT])

    return given.withColumn(DRAWS, draws(seed=seed)).mapInArrow(transform, schema)


def restored(output: Column, form: Column, marks: Sequence[str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text, from the output and its form."""
    prefix, suffix, middle = marks

    def parts(opening: str, between: str) -> tuple[Column, Column, Column]:
        inner = F.substr(output, F.lit(len(opening) + 1))
        one = F.substring_index(inner, between, 1)
        rest = F.substr(inner, F.length(one) + len(between) + 1)
        two = F.substring_index(rest, middle, 1)
        return one, two, F.substr(rest, F.length(two) + len(middle) + 1)

    head, tail, inside = parts(prefix, suffix)
    late_tail, late_head, late_inside = parts(suffix, prefix)
    return (
        F.when(form == "psm", F.concat(head, inside, tail))
        .when(form == "spm", F.concat(late_head, late_inside, late_tail))
        .otherwise(output)
    )
