"""Repeated passages by relative Lempel-Ziv parsing: the corpus is its own reference, indexed in blocks.

Documents are parsed into phrases: neighbouring windows of 20 words whose smallest hashed 8-gram, the anchor, is the same.
Equal windows have equal anchors at equal places, so the phrases that can share a window always meet in one block:
phrases are dealt by the hash of the anchor, and a block's index holds its phrases sorted by content and place. A
phrase that stands earlier in the reference is a factor as a whole; neighbouring factors grow into one as the parse
goes on. Where a factor ends inside phrases that share an anchor but not all words, the windows over the boundary
are looked up one by one. A factor has at least one window, and its words are a duplicate span.

Equal phrases of a slice are reduced to one before they are dealt, so a passage or a copy that a large part of the
corpus shares reaches its block about once per slice of a million bytes. What is equal is told by 128 bits of
hashes: of anchor and phrase, and two of each window.

Defined cases: a null text has no words; a null ``doc_id`` stands behind all others; rows of one id and one text are
one document, and rows of one id with different texts follow the hash of the text; texts under 20 words lose
nothing; a column named ``llm_substrings`` in the input is replaced, and names that begin with ``__llm`` are not for the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import pin
from . import words as W

WINDOW_WORDS = 20
ANCHOR_WORDS = 8
RESULT = "llm_substrings"
LAST_ID = (1 << 63) - 1
PLACE = ("id", "tie", "start")


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest value of each run of ``width`` stands, the first of equals."""
    held, at, step = values, np.arange(len(values)), 1
    while step < width:
        ahead = min(step, width - step)
        size = len(held) - ahead
        later = held[ahead:] < held[:size]
        at = np.where(later, at[ahead:], at[:size])
        held = np.where(later, held[ahead:], held[:size])
        step += ahead
    return at


def _run_hashes(h: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each run of words, from one prefix sum."""
    prefix = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * W._power("up", W._P, len(h))[: len(h)], out=prefix[1:])
    return W.mix((prefix[starts + lengths] - prefix[starts]) * W._power("down", W._P_INVERSE, len(h) + 1)[starts])


def _phrases(data: np.ndarray, offsets: np.ndarray):
    """Of each phrase: anchor, hash, text, first window counted from the text's start, and number of windows."""
    starts, ends, first = W.spans(data, offsets, W.WORD)
    h, text = W.span_hashes(data, starts, ends), W.text_of(first)
    if len(h) < WINDOW_WORDS:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    grams = W.sequence_hashes(h, ANCHOR_WORDS)
    anchor = _smallest(grams, WINDOW_WORDS - ANCHOR_WORDS + 1)
    window = np.flatnonzero(text[WINDOW_WORDS - 1 :] == text[: len(h) - WINDOW_WORDS + 1])
    anchor = anchor[window]
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(window)))
    at, anchor = window[begin], anchor[begin]
    shape = (count * WINDOW_WORDS + anchor - at).astype(np.uint64)
    content = W.mix(_run_hashes(h, at, count + WINDOW_WORDS - 1) + shape)
    return grams[anchor].view(np.int64), content.view(np.int64), text[at], at - first[text[at]], count


def phrases(docs: DataFrame) -> DataFrame:
    """The phrases of (id, tie, text): anchor, content, place, windows; ``known`` if an equal one stands earlier in its slice."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = batch.column("id").to_numpy(), batch.column("tie").to_numpy()
            for row, end, data, offsets in W.text_slices(batch.column("text")):
                anchor, content, text, start, count = _phrases(data, offsets)
                own_id, own_tie = ids[row:end][text], ties[row:end][text]
                order = np.lexsort((start, own_tie, own_id, content, anchor))
                same = np.zeros(len(order), bool)
                a, c = anchor[order], content[order]
                same[1:] = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
                place = (own_id[order], own_tie[order], start[order].astype(np.int32))
                once = np.ones(len(order), bool)  # rows that are given twice are one document
                once[1:] = ~same[1:] | np.any([p[1:] != p[:-1] for p in place], axis=0)
                # A known phrase needs no index; it is dealt by its own place, so that a hot passage stays spread.
                a = np.where(same, W.mix((place[0] ^ place[1] ^ (place[2].astype(np.int64) << 32)).astype(np.uint64)).view(np.int64), a)
                columns = (a, c, *place, count[order].astype(np.int32), same)
                names = ["anchor", "content", *PLACE, "windows", "known"]
                yield pa.RecordBatch.from_arrays([pa.array(x[once]) for x in columns], names)

    return docs.mapInArrow(
        parse, "anchor long, content long, id long, tie long, start int, windows int, known boolean"
    )


def look_up(parsed: DataFrame) -> DataFrame:
    """Phrases that stand earlier in the reference (``found``), and first ones whose anchor has other phrases too."""
    phrase = Window.partitionBy("anchor", "content", "known").orderBy(*PLACE)
    block = Window.partitionBy("anchor")
    dealt = parsed.repartition("anchor")
    first = F.struct(*[F.first(c).over(phrase).alias(c) for c in PLACE])
    marked = dealt.withColumn("found", F.col("known") | (F.struct(*PLACE) != first))
    marked = marked.withColumn("mixed", F.min("content").over(block) != F.max("content").over(block))
    return marked.filter("found or mixed").select(*PLACE, "windows", "found")


def by_document(rows: DataFrame) -> DataFrame:
    """(id, tie, runs): what a document's rows say, at most one entry for each of its words."""
    return rows.groupBy("id", "tie").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))


def _run_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and windows of each entry of a column of runs."""
    counts = column.value_lengths().fill_null(0).to_numpy()
    held = column.flatten()
    return (
        np.repeat(np.arange(len(column)), counts),
        held.field("start").to_numpy().astype(np.int64),
        held.field("windows").to_numpy().astype(np.int64),
    )


def boundary_windows(docs: DataFrame, undecided: DataFrame) -> DataFrame:
    """Every window of the phrases that wait for a closer look, by two hashes, with its place."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = batch.column("id").to_numpy(), batch.column("tie").to_numpy()
            for row, end, data, offsets in W.text_slices(batch.column("text")):
                text, start, windows = _run_arrays(batch.column("runs").slice(row, end - row))
                starts, ends, first = W.spans(data, offsets, W.WORD)
                h = W.span_hashes(data, starts, ends)
                text = np.repeat(text, windows)
                before = np.cumsum(windows) - windows
                start = np.repeat(start - before, windows) + np.arange(windows.sum())
                at = first[text] + start
                length = np.full(len(at), WINDOW_WORDS)
                one, two = _run_hashes(h, at, length), _run_hashes(W.mix(h + np.uint64(1)), at, length)
                columns = (one.view(np.int64), two.view(np.int64), ids[row:end][text], ties[row:end][text], start.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["one", "two", *PLACE])

    held = docs.join(by_document(undecided), ["id", "tie"]).select("id", "tie", "text", "runs")
    return held.mapInArrow(cut, "one long, two long, id long, tie long, start int")


def factors(docs: DataFrame) -> DataFrame:
    """(id, tie, start, windows): the windows of (id, tie, text) whose words stand earlier in the reference."""
    looked_up = pin(look_up(phrases(docs)), "phrases")
    window = Window.partitionBy("one", "two").orderBy(*PLACE)
    cut = boundary_windows(docs, looked_up.filter("not found")).distinct()
    again = cut.withColumn("nth", F.row_number().over(window)).filter("nth > 1")
    found = looked_up.filter("found").select(*PLACE, "windows")
    return found.union(again.select(*PLACE, F.lit(1).alias("windows")))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the struct ``llm_substrings``: n_words, n_removed, and the kept words joined by one space."""
    docs = docs.drop(RESULT)
    keyed = docs.withColumns({"__llm_id": F.coalesce("doc_id", F.lit(LAST_ID)), "__llm_tie": F.xxhash64("text")})
    plain = keyed.select(F.col("__llm_id").alias("id"), F.col("__llm_tie").alias("tie"), "text")
    runs = by_document(factors(plain)).select(F.col("id").alias("__llm_id"), F.col("tie").alias("__llm_tie"), F.col("runs").alias("__llm_runs"))
    names = docs.columns
    joined = keyed.join(runs, ["__llm_id", "__llm_tie"], "left").select(*names, "__llm_runs")
    kind = T.StructType(
        [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    )
    schema = T.StructType([*docs.schema.fields, T.StructField(RESULT, kind)])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in W.text_slices(batch.column("text")):
                own = batch.slice(row, end - row)
                text, start, windows = _run_arrays(own.column("__llm_runs"))
                starts, _, first = W.spans(data, offsets, W.WORD)
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, first[text] + start, 1)
                np.add.at(edge, first[text] + start + windows + WINDOW_WORDS - 1, -1)
                keep = np.cumsum(edge[:-1]) == 0
                whole, kept = data.tobytes(), []
                for k in range(end - row):
                    words = whole[offsets[k] : offsets[k + 1]].split()
                    kept.append(b" ".join(compress(words, keep[first[k] : first[k + 1]].tolist())))
                made = pa.StructArray.from_arrays(
                    [pa.array(np.diff(first)), pa.array(W.per_text(~keep, first)), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["n_words", "n_removed", "kept"],
                )
                yield pa.RecordBatch.from_arrays(
                    [*[own.column(c) for c in names], made], [*names, RESULT]
                )

    return joined.mapInArrow(remove, schema)
