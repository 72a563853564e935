"""Document quality from a linear-chain conditional random field over lines.

Every line that is not blank is a place of a chain with the labels bad and good. Its features are shares of kinds of characters and
words of the line, how much of it the document repeats, and its length, all cut into steps, together with the same features of the
line before and of the line after. Transition weights tie neighbouring labels. Forward and backward products of the
chain give each line's marginal probability of being good, and the mean of these, weighted by the lines' characters, is
the document's score.

The field is fitted by its likelihood on labelled documents, each of whose lines carries the document's label. They are
a bounded sample: at most ``TRAIN_DOCS`` documents, chosen by hash among those that ``learns`` lets in, of at most
``TRAIN_DOC_LINES`` lines and ``TRAIN_LINES`` lines together. Only features of these lines come to the driver. All documents are scored.

Chains are multiplied out by doubling: after k rounds every line holds the product of the 2^k steps up to it, so a text of
a million lines takes 20 rounds over arrays and no loop over lines.

Defined cases: a null or empty text, and one of blank lines, has score 0, as no line is good; a null ``doc_id`` is scored and
never teaches; repeated rows are scored alike; an id whose labels disagree does not teach, nor does a null label; without labels to learn from, or with labels of one
kind only, every line's probability is that of the kind, or one half; a very long text is a slice of its own; columns named
``llm_lines`` are replaced. Names that begin with ``__llm`` are not for the input's columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

#: Parameters: bounds of the sample that the field is fitted on.
TRAIN_DOCS, TRAIN_DOC_LINES, TRAIN_LINES = 4_000, 2_000, 40_000
#: Parameters of the fit.
ROUNDS, RATE, RIDGE = 300, 0.05, 1e-3
#: Parameter: score from which a document is called good.
GOOD_SCORE = 0.7

RESULT = "llm_lines"

#: Steps that a share is cut into, and a length (bytes).
SHARES = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.8])
LENGTHS = np.array([8, 16, 32, 64, 128, 256, 512, 1024])


def _table(kind: str) -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in kind]).astype(np.uint8)


_UPPER = np.isin(np.arange(256), np.arange(65, 91)).astype(np.uint8)
_LETTER = (_UPPER > 0) | np.isin(np.arange(256), np.arange(97, 123)) | (np.arange(256) >= 128)
_KINDS = [_UPPER, _table("0123456789"), _table("!?"), _table("|"), _table("#*$%&<>"), _table("=+~^_\\/@{}[]()"), _table(".,;:'\"-")]
#: Features of a line before they are cut: the kinds, then shares of words (see ``_line_values``).
N_SHARES = len(_KINDS) + 6
N_OWN = N_SHARES * len(SHARES) + len(LENGTHS)


class Field(NamedTuple):
    """Weights of the fitted field: features, and the log weights of steps between labels (bad, good)."""

    weights: np.ndarray
    bias: float
    steps: np.ndarray


def _prefix(values: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines with a word: step numbers of their own values (a row a line), their characters, and each text's first line."""
    starts, ends, first = W.spans(data, offsets, W.LINE)
    words, word_ends, word_first = W.spans(data, offsets, W.WORD)
    low, high = np.searchsorted(words, starts), np.searchsorted(words, ends)
    held = high > low
    text = W.text_of(first)[held]
    starts, ends, low, high = starts[held], ends[held], low[held], high[held]
    first = np.searchsorted(text, np.arange(len(offsets)))
    size, n_words = ends - starts, high - low

    chars = _prefix((data & 0xC0) != 0x80)
    counts = []
    for kind in _KINDS:
        total = _prefix(kind[data])
        counts.append((total[ends] - total[starts]) / size)
    letters = _prefix(_LETTER[data])
    in_word = letters[word_ends] - letters[words]
    upper = _prefix(_UPPER[data])
    h = W.span_hashes(data, words, word_ends)
    word_text = W.text_of(word_first)
    triples = W.sequence_hashes(h, 3)
    inside = np.flatnonzero(word_text[2:] == word_text[:-2])
    again, _ = W.repeated(triples[inside], word_text[inside])
    repeated = np.zeros(len(h), bool)
    for k in range(3):
        repeated[inside[again] + k] = True
    twice = np.zeros(len(h), bool)
    twice[1:] = (h[1:] == h[:-1]) & (word_text[1:] == word_text[:-1])
    line_again, _ = W.repeated(W.span_hashes(data, starts, ends), text)
    shown = np.bincount(word_text[repeated], minlength=len(offsets) - 1) / np.maximum(1, np.diff(word_first))
    for flag in (in_word == 0, in_word > 24, (in_word > 1) & (upper[word_ends] - upper[words] == in_word), repeated | twice):
        total = _prefix(flag)
        counts.append((total[high] - total[low]) / n_words)
    counts += [line_again.astype(float), shown[text]]
    steps = np.stack([np.searchsorted(SHARES, c, "left") for c in counts] + [np.searchsorted(LENGTHS, size, "left")], axis=1)
    return steps.astype(np.uint8), chars[ends] - chars[starts], first


def _own_columns(steps: np.ndarray) -> np.ndarray:
    """One column per step and value: whether the value is beyond the step."""
    out = np.empty((len(steps), N_OWN), np.float32)
    for k in range(N_SHARES):
        out[:, k * len(SHARES) : (k + 1) * len(SHARES)] = steps[:, k : k + 1] > np.arange(len(SHARES))
    out[:, N_SHARES * len(SHARES) :] = steps[:, N_SHARES:] > np.arange(len(LENGTHS))
    return out


def _neighbours(own: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the lines before and after, zeros beyond the text's ends."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    held = first[:-1][np.diff(first) > 0]
    before[held] = 0
    after[first[1:][np.diff(first) > 0] - 1] = 0
    return before, after


def columns(steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    own = _own_columns(steps)
    return np.concatenate([own, *_neighbours(own, first)], axis=1)


def _products(step: np.ndarray, since: np.ndarray) -> np.ndarray:
    """For each line the product of the 2 x 2 steps from its text's first line to it, scaled to a largest entry of 1.

    ``since`` is the number of lines of the text before each line.
    """
    held, reach, longest = step.copy(), 1, int(since.max(initial=0))
    while reach <= longest:
        at = np.flatnonzero(since >= reach)
        joined = held[at - reach] @ held[at]
        held[at] = joined / joined.max(axis=(1, 2), keepdims=True)
        reach *= 2
    return held


def marginals(unary: np.ndarray, steps: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each line the probability of being good, and the 2 x 2 probabilities of the step into it (zeros for first lines)."""
    n = len(unary)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    size = np.diff(first)
    since = np.arange(n) - np.repeat(first[:-1], size)
    left = np.repeat(first[1:], size) - 1 - np.arange(n)
    weight = np.stack([-np.abs(unary), np.zeros(n)], axis=1)  # log weights of the less and the more likely label
    weight = np.exp(np.where((unary > 0)[:, None], weight, weight[:, ::-1]))
    step = np.exp(steps)[None] * weight[:, None, :]
    step[since == 0] = weight[since == 0][:, None, :]
    forward = _products(step, since)[:, 0, :]
    # Backward: products of the steps after each line, over the lines in reverse order.
    back = np.exp(steps).T[None] * np.ones((n, 1, 1))
    inner = np.flatnonzero(left > 0)
    back[:] = 0.5
    back[inner] = np.exp(steps).T[None] * weight[inner + 1][:, :, None]
    turned = _products(back[::-1], left[::-1])[::-1]
    behind = turned.sum(axis=1)
    both = forward * behind
    good = both[:, 1] / both.sum(axis=1)
    pair = np.zeros((n, 2, 2))
    at = np.flatnonzero(since > 0)
    joined = forward[at - 1][:, :, None] * step[at] * behind[at][:, None, :]
    pair[at] = joined / joined.sum(axis=(1, 2), keepdims=True)
    return good, pair


def fit(x: np.ndarray, good: np.ndarray, first: np.ndarray) -> Field:
    """Maximum of the likelihood with a ridge, by ``ROUNDS`` steps of Adam from zero."""
    n, width = x.shape if len(x) else (0, 3 * N_OWN)
    share = (good.sum() + 1) / (n + 2)
    start = float(np.log(share / (1 - share))) if n else 0.0
    if not n or good.all() or not good.any():
        return Field(np.zeros(width), start, np.zeros((2, 2)))
    since = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    seen = np.zeros((2, 2))
    at = np.flatnonzero(since > 0)
    np.add.at(seen, (good[at - 1].astype(int), good[at].astype(int)), 1)
    theta = np.zeros(width + 5)
    theta[width] = start
    speed, power = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, ROUNDS + 1):
        steps = theta[width + 1 :].reshape(2, 2)
        p, pair = marginals(x @ theta[:width] + theta[width], steps, first)
        miss = good - p
        slope = np.concatenate([x.T @ miss, [miss.sum()], (seen - pair.sum(axis=0)).ravel()]) / n - RIDGE * theta
        speed, power = 0.9 * speed + 0.1 * slope, 0.999 * power + 0.001 * slope**2
        theta = theta + RATE * (speed / (1 - 0.9**k)) / (np.sqrt(power / (1 - 0.999**k)) + 1e-8)
    return Field(theta[:width], float(theta[width]), theta[width + 1 :].reshape(2, 2))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that must not teach: every fourth id by its checksum; a null id is not among them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def training_lines(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(draw, doc_id, quality, steps, lines): features of the lines of the sampled documents, one row a document."""
    told = labels.filter("doc_id is not null and quality is not null").filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("__llm_most"))
    told = told.filter(F.col("quality") == F.col("__llm_most")).select("doc_id", "quality", F.xxhash64("doc_id").alias("draw"))
    drawn = F.broadcast(told.orderBy("draw", "doc_id").limit(TRAIN_DOCS))
    read = docs.select("doc_id", "text").join(drawn, "doc_id").select("draw", "doc_id", "quality", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in W.text_slices(batch.column("text")):
                steps, _, first = line_features(data, offsets)
                lines = np.diff(first)
                held = [steps[a:b].tobytes() if b - a <= TRAIN_DOC_LINES else b"" for a, b in zip(first[:-1], first[1:])]
                lines[lines > TRAIN_DOC_LINES] = 0
                own = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(held, pa.binary()), pa.array(lines)], ["draw", "doc_id", "quality", "steps", "lines"])

    return read.mapInArrow(measure, "draw long, doc_id long, quality int, steps binary, lines long").filter("lines > 0").dropDuplicates(["doc_id", "steps"])


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """The field of the sample; the same tables give the same field."""
    # At most TRAIN_DOCS ids with at most TRAIN_DOC_LINES lines each; cut to TRAIN_LINES before the fit.
    width = N_SHARES + 1
    rows = sorted(training_lines(docs, labels).orderBy("draw", "doc_id", "steps").limit(TRAIN_DOCS).collect(), key=lambda r: (r.draw, r.doc_id, bytes(r.steps)))
    steps, good, sizes = [], [], []
    for row in rows:
        if sum(sizes) + row.lines > TRAIN_LINES:
            break
        steps.append(np.frombuffer(bytes(row.steps), np.uint8).reshape(-1, width))
        good += [row.quality == 1] * row.lines
        sizes.append(row.lines)
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    x = columns(np.concatenate(steps), first) if steps else np.zeros((0, 3 * N_OWN), np.float32)
    return fit(x, np.array(good, bool), first)


def document_scores(data: np.ndarray, offsets: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of lines of each text."""
    steps, chars, first = line_features(data, offsets)
    own = _own_columns(steps)
    parts = field.weights.reshape(3, N_OWN).astype(np.float64)
    # The neighbours' part of the sum is that of their own columns under other weights.
    alone = own @ parts.T
    unary = alone[:, 0] + field.bias
    before, after = _neighbours(alone, first)
    good, _ = marginals(unary + before[:, 1] + after[:, 2], field.steps, first)
    total = W.per_text(chars.astype(np.float64), first)
    # Summed text by text, so that a score does not depend on the slice.
    text = W.text_of(first)
    score = np.bincount(text, good * chars, len(offsets) - 1) / np.maximum(1.0, total)
    return np.clip(score, 0.0, 1.0), np.diff(first)


KIND = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("lines", T.LongType())])


def score(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with the struct ``llm_lines``: the score and the number of lines with a word."""
    given = docs.drop(RESULT)
    schema = T.StructType([*given.schema.fields, T.StructField(RESULT, KIND)])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in W.text_slices(batch.column("text")):
                found, lines = document_scores(data, offsets, field)
                made = pa.StructArray.from_arrays([pa.array(found), pa.array(lines)], [f.name for f in KIND.fields])
                own = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*own.columns, made], [*own.schema.names, RESULT])

    return given.mapInArrow(compute, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits the field on the sample and scores every document."""
    return score(docs, train(docs, labels))
