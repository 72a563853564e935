"""LM scoring: stupid backoff over token pairs, as relations.

N-grams are single tokens and pairs of tokens of one byte-level BPE vocabulary. Documents are encoded once and written in
blocks of about ``BLOCK_BYTES`` of text. Every block is exploded into its different n-grams with their counts; the count
table is their sum by n-gram, partitioned by its hash, and is joined back to the exploded n-grams, so each block
gets the counts of its own n-grams from the whole corpus. In the block every document then sums its tokens.

A document is scored against all others: its own counts are taken off first. With c the counts that are left, a token b
after a scores log(c(ab) / c(a)) if c(ab) > 0, else log(BACKOFF * (c(b) + 1) / (N + V)), and so does a first token without
the factor. The score is the mean over tokens, so lengths compare.

An n-gram that every block holds has one row per block and is summed before the shuffle, so no key is hot beyond that.

Defined cases: a null or empty text has no tokens, score 0; a null ``doc_id`` and repeated rows are rows of their
own; copies know each other, so a copied document scores high; a text longer than a block is a block of its own; no documents give
no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import pin
from . import bpe
from . import words as W

#: Parameters: the factor of a step back, and bytes of text in a block.
BACKOFF = 0.4
BLOCK_BYTES = 16 << 20


def token_blocks(docs: DataFrame, path: str) -> DataFrame:
    """(block, doc_id, ids): every document's ids, packed; a block is a run of rows that one task has read."""
    vocabulary = bpe.read_vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block, held = bpe.codec(vocabulary), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for row, end, data, offsets in W.text_slices(batch.column("text")):
                ids, at = own.encode(data, offsets)
                packed = [zlib.compress(ids[a:b].astype("<i4").tobytes(), 1) for a, b in zip(at.tolist(), at[1:].tolist())]
                if held + len(data) > BLOCK_BYTES:
                    block, held = block + 1, 0
                held += len(data)
                columns = [pa.array(np.full(end - row, block)), batch.column("doc_id").slice(row, end - row), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "block long, doc_id long, ids binary")


def _unpacked(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after the other, and where each document begins."""
    held = [np.frombuffer(zlib.decompress(x), "<i4") for x in ids]
    return np.concatenate([np.zeros(0, "<i4"), *held]).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in held], dtype=np.int64)])


def _pairs(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of the pair that ends at each token, and whether there is one: a token is not the first of its document.

    Keys are (a + 1) * 2^32 + b for pairs and the token itself for single tokens.
    """
    key = np.zeros(len(ids), np.int64)
    key[1:] = ((ids[:-1] + 1) << 32) + ids[1:]
    inner = np.ones(len(ids), bool)
    inner[at[:-1][at[:-1] < len(ids)]] = False
    return key, inner


def exploded(blocks: DataFrame) -> DataFrame:
    """(block, ngram, count): the different n-grams of each block; at most one row per n-gram and task's share of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, grams, counts, held = None, [], [], 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal grams, counts, held
            if not grams:
                return
            every, same_as = np.unique(np.concatenate(grams), return_inverse=True)
            total = np.bincount(same_as, np.concatenate(counts), len(every)).astype(np.int64)
            grams, counts, held = [], [], 0
            for k in range(0, len(every), 1 << 16):
                e, t = every[k : k + (1 << 16)], total[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), block)), pa.array(e), pa.array(t)], ["block", "ngram", "count"])

        for batch in batches:
            of = batch.column("block").to_numpy()
            packed = batch.column("ids").to_pylist()
            cuts = np.flatnonzero(np.diff(of)) + 1
            parts = sorted({0, len(of), *cuts.tolist(), *range(0, len(of), 512)})
            for a, b in zip(parts, parts[1:]):
                if of[a] != block or held > 4_000_000:
                    yield from send()
                    block = of[a]
                ids, at = _unpacked(packed[a:b])
                key, inner = _pairs(ids, at)
                g, c = np.unique(np.concatenate([ids, key[inner]]), return_counts=True)
                grams.append(g)
                counts.append(c)
                held += len(g)
        yield from send()

    return blocks.select("block", "ids").mapInArrow(run, "block long, ngram long, count long")


def _sum_documents(docs: pd.DataFrame, grams: np.ndarray, counts: np.ndarray, total: int, kinds: int) -> pd.DataFrame:
    """Scores of the documents of one block, whose n-grams are sorted beside their counts in the corpus."""
    n, hits, score = [], [], []
    for at0 in range(0, len(docs), 512):
        part = docs.iloc[at0 : at0 + 512]
        ids, at = _unpacked(part["ids"].tolist())
        key, inner = _pairs(ids, at)
        text = np.repeat(np.arange(len(part)), np.diff(at))
        length = np.diff(at)

        def left(values: np.ndarray, of: np.ndarray) -> np.ndarray:
            """Counts in all other documents: those of the corpus less those of the value's own document."""
            place = np.searchsorted(grams, values)
            own = place + of * len(grams)
            _, same_as, times = np.unique(own, return_inverse=True, return_counts=True)
            return counts[place] - times[same_as]

        single = left(ids, text)
        # the token before the pair is counted wherever it stands, the last place of a document included
        score_of = np.log((single + 1) / (total - length[text] + kinds))
        score_of[inner] += np.log(BACKOFF)
        pair = np.zeros(len(ids), np.int64)
        pair[inner] = left(key[inner], text[inner])
        met = pair > 0
        before = np.zeros(len(ids), np.int64)
        before[1:] = single[:-1]
        score_of[met] = np.log(pair[met] / before[met])
        n += length.tolist()
        hits += np.bincount(text[met], minlength=len(part)).tolist()
        score += (np.bincount(text, score_of, len(part)) / np.maximum(1, length)).tolist()
    return pd.DataFrame({"doc_id": docs["doc_id"], "n_tokens": n, "n_pairs_met": hits, "score": score})


def scores(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_pairs_met`` (scored without a step back) and ``score`` of every document."""
    blocks = pin(token_blocks(docs, path), "tokens")
    grams = pin(exploded(blocks), "ngrams")
    counts = grams.groupBy("ngram").agg(F.sum("count").alias("count"))
    singles = grams.filter(F.col("ngram") < 1 << 32)
    total = singles.agg(F.coalesce(F.sum("count"), F.lit(0)), F.countDistinct("ngram")).first()
    answers = grams.select("block", "ngram").join(counts, "ngram").select("block", "ngram", "count")

    def meet(docs: pa.Table, table: pa.Table) -> pa.Table:
        found, times = table.column("ngram").to_numpy(), table.column("count").to_numpy()
        found, order = np.unique(found, return_index=True)  # a block that two tasks read has asked twice
        held = docs.select(["doc_id", "ids"]).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        made = _sum_documents(held, found, times[order], total[0], total[1])
        return pa.Table.from_pandas(made, preserve_index=False).cast(schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_pairs_met", pa.int64()), ("score", pa.float64())])
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    return scored.applyInArrow(meet, "doc_id long, n_tokens long, n_pairs_met long, score double")
