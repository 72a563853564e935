"""Quality rules: counting rules first, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word and word-pair buckets are counted: one from every document of the corpus, one
from the documents that labels call good. A document's score is the mean over its n-grams of
``log p(bucket | trusted) - log p(bucket | corpus)``; documents whose score is under a fixed threshold are rejected.
The trusted multinomial is smoothed towards the corpus (``PRIOR`` n-grams dealt as the corpus deals its own), so few
labels pull every ratio to 0 and none give exactly 0. A document is scored as held out: its own n-grams are taken off
the corpus and, if it is trusted, off the trusted ones.
The mean takes out the length, so short and long documents meet the same threshold, and a document is judged alike
in every run.

Defined cases: a null or empty text has no words and fails the base rules; a null ``doc_id`` is kept as a row and is
never trusted; repeated rows are judged one by one, each with one copy of itself taken off; without good labels every
score is 0 and only the base rules decide; a bucket that no other document uses has ratio 0; a column named
``llm_quality`` in the input is replaced; a very long text is a slice of its own; no documents give no rows. Names that begin with ``__llm`` are not for the input's columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import small_side
from . import words as W

#: Parameters of the method.
BUCKET_BITS = 16
MIN_SCORE = -0.25
#: Weight in n-grams of the corpus in the trusted multinomial, as much as one n-gram a bucket.
PRIOR = 1 << BUCKET_BITS
#: Parameters of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

RESULT = "llm_quality"
TRUSTED = "__llm_trusted"
FIELDS = (
    ("n_words", T.LongType(), pa.int64()),
    ("word_chars", T.LongType(), pa.int64()),
    ("n_symbols", T.LongType(), pa.int64()),
    ("n_dup_lines", T.LongType(), pa.int64()),
    ("n_repeat_words", T.LongType(), pa.int64()),
    ("base_failed", T.BooleanType(), pa.bool_()),
    ("score", T.DoubleType(), pa.float64()),
    ("kept", T.BooleanType(), pa.bool_()),
)

# Tokens of the n-grams: runs of letters, digits and other characters are one kind, runs of marks another.
_TOKEN = W.WORD.copy()
_TOKEN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 2
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(SYMBOLS)] = 1


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each token and each pair of tokens."""
    starts, ends, first = W.spans(data, offsets, _TOKEN)
    h, text = W.span_hashes(data, starts, ends), W.text_of(first)
    inside = text[1:] == text[:-1]
    pairs = W.sequence_hashes(h, 2)[inside]
    shift = np.uint64(64 - BUCKET_BITS)
    return (np.concatenate([h, pairs]) >> shift).astype(np.int64), np.concatenate([text, text[:-1][inside]])


def _flags(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(TRUSTED).fill_null(False).to_numpy(zero_copy_only=False)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids that labels call good."""
    return labels.filter(F.col("quality") == 1).select("doc_id").filter("doc_id is not null").distinct()


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with a last column that is true for trusted rows and else null."""
    trusted = small_side(trusted_ids(labels).withColumn(TRUSTED, F.lit(True)))
    return docs.join(trusted, "doc_id", "left").select(*docs.columns, TRUSTED)


def gram_counts(flagged: DataFrame) -> DataFrame:
    """(bucket, corpus, trusted): n-grams of all documents and of the trusted ones.

    Each task counts into two arrays of fixed size and emits the buckets that it has met.
    """
    read = flagged.select("text", TRUSTED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << BUCKET_BITS
        corpus, good = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            flags = _flags(batch)
            for row, end, data, offsets in W.text_slices(batch.column("text")):
                bucket, text = _grams(data, offsets)
                corpus += np.bincount(bucket, minlength=size)
                good += np.bincount(bucket[flags[row:end][text]], minlength=size)
        met = np.flatnonzero(corpus)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met), pa.array(corpus[met]), pa.array(good[met])], ["bucket", "corpus", "trusted"]
        )

    counted = read.mapInArrow(count, "bucket long, corpus long, trusted long")
    return counted.groupBy("bucket").agg(F.sum("corpus").alias("corpus"), F.sum("trusted").alias("trusted"))


def bucket_table(counts: DataFrame) -> np.ndarray:
    """Corpus and trusted counts per bucket: at most 2^16 rows come to the driver."""
    held = np.zeros((2, 1 << BUCKET_BITS))
    for bucket, corpus, trusted in counts.collect():
        held[:, bucket] = corpus, trusted
    return held


def _scores(bucket: np.ndarray, text: np.ndarray, flags: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Mean log ratio of each text's n-grams against what the other rows hold."""
    key, own = np.unique(text << BUCKET_BITS | bucket, return_counts=True)
    text, bucket = key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1)
    size = np.bincount(text, own, len(flags))
    corpus = np.maximum(held[0][bucket] - own, 0)
    trusted = np.maximum(held[1][bucket] - own * flags[text], 0)
    all_corpus, all_trusted = (held.sum(axis=1)[:, None] - [size, size * flags])[:, text]
    expected = np.divide(trusted * all_corpus, corpus, out=np.zeros(len(key)), where=corpus > 0)
    ratio = np.where(corpus > 0, np.log((expected + PRIOR) / (all_trusted + PRIOR)), 0.0)
    return np.bincount(text, own * ratio, len(flags)) / np.maximum(1, size)


def _measures(data: np.ndarray, offsets: np.ndarray, flags: np.ndarray, table: np.ndarray, min_score: float) -> list[np.ndarray]:
    starts, ends, first = W.spans(data, offsets, W.WORD)
    text, n = W.text_of(first), len(offsets) - 1
    n_words = np.diff(first)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])

    h = W.span_hashes(data, starts, ends)
    triples = W.sequence_hashes(h, 3)
    inside = np.flatnonzero(text[2:] == text[:-2])
    again, _ = W.repeated(triples[inside], text[inside])
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[inside[again] + k] = True

    line_starts, line_ends, line_first = W.spans(data, offsets, W.LINE)
    with_word = np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends)
    line_text = W.text_of(line_first)[with_word]
    _, earlier = W.repeated(W.span_hashes(data, line_starts[with_word], line_ends[with_word]), line_text)

    repeat_words = W.per_text(covered, first)
    failed = (n_words < MIN_WORDS) | (100 * repeat_words > MAX_REPEAT_PERCENT * n_words)
    score = _scores(*_grams(data, offsets), flags, table)
    return [
        n_words,
        W.per_text(chars[ends] - chars[starts], first),
        symbols[offsets[1:]] - symbols[offsets[:-1]],
        np.bincount(line_text[earlier], minlength=n),
        repeat_words,
        failed,
        score,
        ~failed & (score >= min_score),
    ]


def judge(flagged: DataFrame, table: np.ndarray, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``with_trust`` with the struct ``llm_quality`` in place of the flag: the measures, the score and the verdict."""
    kind = T.StructType([T.StructField(name, t) for name, t, _ in FIELDS])
    schema = T.StructType([*flagged.drop(TRUSTED).schema.fields, T.StructField(RESULT, kind)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = _flags(batch)
            for row, end, data, offsets in W.text_slices(batch.column("text")):
                found = _measures(data, offsets, flags[row:end], table, min_score)
                made = pa.StructArray.from_arrays(
                    [pa.array(x, t) for x, (_, _, t) in zip(found, FIELDS)], [name for name, _, _ in FIELDS]
                )
                own = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], made], [*own.schema.names[:-1], RESULT])

    return flagged.mapInArrow(measure, schema)


def quality_rules(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Counts both multinomials over all documents, then judges every document."""
    flagged = with_trust(docs.drop(RESULT), labels)
    return judge(flagged, bucket_table(gram_counts(flagged)), min_score)
