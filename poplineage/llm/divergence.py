"""Audit of how sources differ in their use of words, over the frequent terms of each language.

The frequent terms are found by iceberg prefix refinement. A term's byte prefixes are extended level by level (``LEVELS``
bytes); at each level the documents with a term of that prefix are counted, prefixes in fewer than ``min_docs`` documents of
their language are discarded, and with them all their terms, until whole terms remain and are counted themselves. Only
these terms are grouped by their text, so the long tail of rare terms is never shuffled.

One pass over the texts makes the counts additive: a task sorts the different terms of each document, and a term *leads* a
prefix in the documents in which it is the first one with that prefix. The documents of a prefix are then the sum of the
leads of its terms. A kept prefix keeps all its terms, so the sums of the next level are those over all documents. Rows
are summed by language and term in the task before they leave it, in tables of bounded size.

A second pass counts the kept terms by source. Tasks hold ``FILTER_BITS`` hashed flags of them, a fixed size, to leave most other
terms out early; a join with the kept terms then leaves out the rest, so the counts are exact at any number of terms.

Sources are compared by dense blocks: kept terms are dealt to blocks by hash, each block is a matrix of its terms and the
sources of its language, and the blocks' sums of absolute differences are added up. Terms that neither source of a block
uses are one constant difference, as are all absent terms of a source. All numbers are whole.

Defined cases: null ``text``, ``lang`` and ``source`` count as empty strings; a document is a row, so repeated rows, and rows of
one or of no id, count one by one; a group without terms still takes part, and a language without kept terms gives differences of
0; ties follow the bytes of the item; a very long text is a slice of its own; without rows the result is empty; other
columns are not read, whatever their names. Names that begin with ``__llm`` are not for the input's columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import pin, small_table
from . import words as W

#: Parameters: documents that a kept term has in its language, ranks of part ``term``, and the smoothing of the shares.
MIN_DOCS = 30
TOP_TERMS = 50
SCALE, PRIOR = 1_000_000_000, 5
#: Parameters: prefix lengths of the levels in bytes, flags of kept terms as a power of two, and bounds of a task's table and of a block.
LEVELS = (2, 4, 8, 16, 32)
FILTER_BITS = 22
HELD_ROWS = 400_000
BLOCK_TERMS = 4_096
BLOCK_CELLS = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, np.uint8)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = 1

GROUP = ["lang", "source"]
SUMS = ["docs", *[f"lead_{k}" for k in range(len(LEVELS))]]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in GROUP], "text")


def _slice_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different terms of a slice in order; of each text's different terms, in order, the text, the term's number and its occurrences."""
    starts, ends, first = W.spans(data, offsets, _TERM)
    low = _LOWER[data]
    size = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=size[1:])
    held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(size), pa.py_buffer(low[_TERM[low] > 0])])
    coded = held.cast(pa.binary()).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    key, n = np.unique(W.text_of(first) * max(1, len(order)) + place[coded.indices.to_numpy()], return_counts=True)
    doc, term = np.divmod(key, max(1, len(order)))
    return coded.dictionary.take(pa.array(order)), doc, term, n


def _summed(keys: list[pa.Array], names: list[str], terms: pa.Array, owner: np.ndarray, term: np.ndarray, sums: dict[str, np.ndarray]) -> pa.Table:
    """Sums by owner and term; ``keys`` are the columns of an owner."""
    different, inverse = np.unique(owner * len(terms) + term, return_inverse=True)
    owner, term = np.divmod(different, len(terms))
    columns = [k.take(pa.array(owner)) for k in keys] + [terms.take(pa.array(term))]
    columns += [pa.array(np.bincount(inverse, s, len(different)).astype(np.int64)) for s in sums.values()]
    return pa.table(columns, [*names, "term", *sums])


def _numbers(columns: list[pa.Array]) -> np.ndarray:
    """For each row the number of the first row with the same values."""
    key = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        coded = column.dictionary_encode()
        key = key * len(coded.dictionary) + coded.indices.to_numpy()
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    return first[inverse]


def _in_tables(made: Iterator[pa.Table], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The tables summed by their keys, in tables of about ``HELD_ROWS`` rows."""

    def summed(tables: list[pa.Table]) -> pa.Table:
        held = pa.concat_tables(tables)
        sums = [c for c in held.column_names if c not in keys]
        out = held.group_by(keys).aggregate([(c, "sum") for c in sums])
        return out.select([*keys, *[f"{c}_sum" for c in sums]]).rename_columns(held.column_names)

    tables, rows = [], 0
    for table in made:
        tables.append(table)
        rows += len(table)
        if rows > HELD_ROWS:
            tables = [summed(tables)]
            rows = len(tables[0])
            if 2 * rows > HELD_ROWS:
                yield from tables[0].combine_chunks().to_batches()
                tables, rows = [], 0
    if tables:
        yield from summed(tables).combine_chunks().to_batches()


def term_rows(docs: DataFrame) -> DataFrame:
    """``lang, term`` (bytes) with documents and led documents of each level, summed in part."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            for row, end, data, offsets in W.text_slices(batch.column("text")):
                terms, doc, term, _ = _slice_terms(data, offsets)
                if not len(term):
                    continue
                sums = {"docs": np.ones(len(term), np.int64)}
                for k, length in enumerate(LEVELS):
                    prefix = pc.binary_slice(terms, 0, length).dictionary_encode().indices.to_numpy()[term]
                    leads = sums[f"lead_{k}"] = np.ones(len(term), np.int64)
                    leads[1:] = (prefix[1:] != prefix[:-1]) | (doc[1:] != doc[:-1])
                langs = batch.slice(row, end - row).column("lang")
                yield _summed([langs], ["lang"], terms, _numbers([langs])[doc], term, sums)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_tables(slices(batches), ["lang", "term"])

    sums = ", ".join(f"{s} long" for s in SUMS)
    return _keyed(docs).select("lang", "text").mapInArrow(count, f"lang string, term binary, {sums}")


def _flags_of(terms: pa.Array) -> np.ndarray:
    """The hashed flag of each term."""
    offsets = np.frombuffer(terms.buffers()[1], np.int32)[: len(terms) + 1].astype(np.int64)
    data = np.frombuffer(terms.buffers()[2] or b"", np.uint8)
    return (W.span_hashes(data, offsets[:-1], offsets[1:]) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def term_flags(kept: DataFrame) -> np.ndarray:
    """Which hashed flags the kept terms set: at most 2^FILTER_BITS numbers come to the driver."""

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = pa.concat_arrays([batch.column("term")]).take(pa.array(np.arange(len(batch))))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_flags_of(terms)))], ["flag"])

    out = np.zeros(1 << FILTER_BITS, bool)
    out[kept.select("term").mapInArrow(flag, "flag long").distinct().toArrow().column("flag").to_numpy()] = True
    return out


def counts_by_source(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, source, term, n``: occurrences of the kept terms; a source without a term has no row for it."""
    flags = np.packbits(term_flags(kept))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        wanted = np.unpackbits(flags).astype(bool)
        for batch in batches:
            for row, end, data, offsets in W.text_slices(batch.column("text")):
                terms, doc, term, n = _slice_terms(data, offsets)
                if not len(term):
                    continue
                held = wanted[_flags_of(terms)][term]
                own = [batch.slice(row, end - row).column(c) for c in GROUP]
                yield _summed(own, GROUP, terms, _numbers(own)[doc[held]], term[held], {"n": n[held]})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_tables(slices(batches), [*GROUP, "term"])

    counted = _keyed(docs).mapInArrow(count, "lang string, source string, term binary, n long")
    exact = counted.join(kept, ["lang", "term"], "left_semi")
    return exact.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"))


def _prefix(length: int) -> Column:
    return F.substring("term", 1, length)


def kept_terms(rows: DataFrame, min_docs: int = MIN_DOCS, levels: Sequence[int] = LEVELS) -> DataFrame:
    """``lang, term``: terms in at least ``min_docs`` documents of their language, refined level by level.

    Kept prefixes are broadcast where they are counted to be few, and joined by shuffle beyond that. A term shorter than
    a level is the only one with its prefix there, so that level has counted it whole and the next ones leave it out.
    """
    live, whole = rows, []
    for k, length in enumerate(levels):
        counted = live.groupBy("lang", _prefix(length).alias("__llm_prefix")).agg(F.sum(f"lead_{k}").alias("docs"))
        kept = small_table(counted.filter(F.col("docs") >= min_docs).select("lang", "__llm_prefix"), "prefixes")
        size = F.length("__llm_prefix")
        whole.append(kept.filter(size < length).select("lang", F.col("__llm_prefix").alias("term")))
        longer = live.filter(F.length("term") >= length).withColumn("__llm_prefix", _prefix(length))
        live = longer.join(kept.filter(size == length), ["lang", "__llm_prefix"], "left_semi").drop("__llm_prefix")
    counted = live.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))
    whole.append(counted.filter(F.col("docs") >= min_docs).select("lang", "term"))
    return functools.reduce(DataFrame.union, whole)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), in whole numbers of 38 digits."""
    whole = lambda c: c.cast("decimal(20,0)")
    above = (whole(count) + F.lit(PRIOR)) * F.lit(SCALE).cast("decimal(11,0)")
    below = whole(total) + F.lit(PRIOR) * whole(terms)
    return F.call_function("div", above, below) + F.lit(1).cast("long")


def _block_sums(cells: DataFrame, sources: DataFrame, terms: int) -> DataFrame:
    """(lang, a, b, value), a < b: summed absolute differences of two sources over the kept terms of their language.

    ``cells`` has ``lang, term, s, p`` of occurring terms, ``sources`` has ``lang, s, z`` where z is the share of an absent term.
    """
    n_blocks = max(1, -(-terms // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("term"), F.lit(n_blocks))
    dealt = cells.select("lang", block.alias("block"), F.col("term"), "s", "p")
    blocks = cells.select("lang", block.alias("block")).distinct()
    constant = blocks.join(sources, "lang").select("lang", "block", F.lit(None).cast("binary").alias("term"), "s", F.col("z").alias("p"))

    def difference(table: pa.Table) -> pa.Table:
        s, p, term = table.column("s").to_numpy(), table.column("p").to_numpy(), table.column("term")
        absent = term.is_null().to_numpy()
        order = np.argsort(s[absent])
        names, base = s[absent][order], p[absent][order]
        at = np.searchsorted(names, s[~absent])
        coded = term.filter(pa.array(~absent)).combine_chunks().dictionary_encode()
        column, p, size = coded.indices.to_numpy(), p[~absent], len(names)
        order = np.argsort(column, kind="stable")
        at, column, p = at[order], column[order], p[order]
        a, b = np.triu_indices(size, 1)
        total, width = np.zeros(len(a), np.int64), max(1, BLOCK_CELLS // max(1, size))
        for low in range(0, len(coded.dictionary), width):
            high = min(low + width, len(coded.dictionary))
            own = slice(*np.searchsorted(column, [low, high]))
            matrix = np.repeat(base[:, None], high - low, axis=1)
            matrix[at[own], column[own] - low] = p[own]
            total += np.concatenate([np.abs(matrix[k + 1 :] - matrix[k]).sum(axis=1) for k in range(size)])
        lang = pa.array([table.column("lang")[0].as_py()] * len(a), pa.string())
        return pa.table([lang, pa.array(names[a]), pa.array(names[b]), pa.array(total)], ["lang", "a", "b", "value"])

    made = dealt.unionByName(constant).groupBy("lang", "block").applyInArrow(difference, "lang string, a long, b long, value long")
    return made.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to the other sources, and the terms a source favours."""
    rows = pin(term_rows(docs), "terms")
    vocabulary = small_table(kept_terms(rows, min_docs), "vocabulary")
    counted = pin(counts_by_source(docs, vocabulary), "counts")
    # A row each per language, per group and per kept term; the groups of a language are numbered in order.
    sizes = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = counted.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    groups = _keyed(docs).select(*GROUP).distinct().join(totals, GROUP, "left").join(sizes, "lang", "left").na.fill(0, ["total", "v"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")
    absent = F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.greatest("v", F.lit(1)))).otherwise(F.lit(0).cast("long"))
    groups = small_table(groups.withColumns({"s": number, "z": absent}), "groups")
    whole = counted.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    overall = groups.groupBy("lang").agg(F.sum("total").alias("all"))
    cells = counted.join(groups, GROUP).withColumn("p", _share(F.col("n"), F.col("total"), F.col("v")))
    cells = pin(cells.select(*GROUP, "term", "s", "p"), "cells")

    sums = _block_sums(cells, groups.select("lang", "s", "z"), vocabulary.count())
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    one, two = groups.select("lang", "source", F.col("s").alias("a")), groups.select("lang", F.col("source").alias("item"), F.col("s").alias("b"))
    # All pairs of sources are the result itself.
    pairs = one.join(two, "lang").filter("a <> b").join(both, ["lang", "a", "b"], "left")
    pairs = pairs.select(*GROUP, F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    average = whole.join(overall, "lang").join(sizes, "lang").select("lang", "term", _share(F.col("n"), F.col("all"), F.col("v")).alias("q"))
    favoured = cells.join(small_table(average, "average"), ["lang", "term"]).filter("p > q")
    favoured = favoured.select(*GROUP, F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    favoured = favoured.withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(favoured)
