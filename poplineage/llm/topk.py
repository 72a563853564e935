"""Exact top-k by inner product, a block of vectors at a time.

Vectors are cut into blocks of a document range with a forward index (the vectors themselves as integers) and the largest and
smallest value of each term, that is of each component. For a query, the sum over terms of query weight times the
block's best value bounds every score in the block. A query takes the blocks in the order of their bounds and stops
when the next bound falls below its k-th score, so results are exact.

Queries come in groups and blocks in shards; each pair of a group and a shard is one task of bounded size, and the
best k of a query and shard meet in a ranking at the end.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id; shorter vectors count
as zero in the components they lack; rows with the same id are candidates and queries of their own, ranked in
the order of their blocks; ties go to the smaller id; no vectors, or no queries among them, give no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import pin

#: Parameters: vectors in a block, blocks in a shard, queries in a group.
BLOCK_ROWS = 512
SHARD_BLOCKS = 8
GROUP_QUERIES = 1024
SCALE = 64

BLOCK_SCHEMA = "block long, width int, ids binary, vectors binary, largest binary, smallest binary"


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, values): floor(64 x) of every component of the vectors that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    held = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return held.select(F.col("vec_id").cast("long"), F.transform(x, lambda v: F.floor(v * SCALE).cast("long")).alias("values"))


def blocks(vectors: DataFrame) -> DataFrame:
    """Blocks of ``BLOCK_ROWS`` neighbouring rows of (vec_id, values), each sorted by id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                ids, lists = part.column("vec_id").to_numpy(), part.column("values")
                lengths = lists.value_lengths().to_numpy()
                held = np.zeros((len(part), max(1, int(lengths.max()))), "<i8")
                held[np.arange(held.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
                order = np.argsort(ids, kind="stable")
                ids, held = ids[order], held[order]
                binary = [x.astype("<i8").tobytes() for x in (ids, held, held.max(axis=0), held.min(axis=0))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([held.shape[1]], pa.int32()), *[pa.array([x], pa.binary()) for x in binary]],
                    ["block", "width", "ids", "vectors", "largest", "smallest"],
                )
                number += 1

    return vectors.mapInArrow(cut, BLOCK_SCHEMA)


def queries_of(held: DataFrame, every: int) -> DataFrame:
    """(block, place, query_id, vector) of the rows of blocks whose id is divisible by ``every``."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                vectors = np.frombuffer(row["vectors"], "<i8").reshape(len(ids), -1)
                at = np.flatnonzero(ids % every == 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), row["block"])),
                        pa.array(at),
                        pa.array(ids[at]),
                        pa.array([vectors[k].tobytes() for k in at], pa.binary()),
                    ],
                    ["block", "place", "query_id", "vector"],
                )

    return held.mapInArrow(pick, "block long, place long, query_id long, vector binary")


def _padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of all rows; by floating point where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 1 << 53 else a @ b.T


class _Best:
    """The best k of every query so far, sorted by score and id."""

    def __init__(self, queries: int, k: int):
        self.k, lowest = k, np.iinfo(np.int64)
        self.score = np.full((queries, k), lowest.min + 1)
        self.id = np.full((queries, k), lowest.max)

    def take(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of the queries, as three parallel arrays."""
        enters = (score > self.score[query, -1]) | ((score == self.score[query, -1]) & (ids < self.id[query, -1]))
        query, score, ids = query[enters], score[enters], ids[enters]
        met = np.unique(query)
        query = np.concatenate([query, np.repeat(met, self.k)])
        score = np.concatenate([score, self.score[met].ravel()])
        ids = np.concatenate([ids, self.id[met].ravel()])
        order = np.lexsort((ids, -score, query))
        first = np.searchsorted(query[order], met)
        pick = order[first[:, None] + np.arange(self.k)]
        self.score[met], self.id[met] = score[pick], ids[pick]


def search(queries: pd.DataFrame, shard: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k of each query among the blocks of one shard."""
    width = int(max(shard["width"].max(), max(len(v) // 8 for v in queries["vector"])))
    asked = _padded([np.frombuffer(v, "<i8") for v in queries["vector"]], width)
    largest = _padded([np.frombuffer(v, "<i8") for v in shard["largest"]], width)
    smallest = _padded([np.frombuffer(v, "<i8") for v in shard["smallest"]], width)
    bound = _products(np.maximum(asked, 0), largest) + _products(np.minimum(asked, 0), smallest)
    order = np.argsort(-bound, axis=1, kind="stable")
    best, numbers = _Best(len(asked), k), shard["block"].to_numpy()
    own_block, own_place = queries["block"].to_numpy(), queries["place"].to_numpy()
    active = np.arange(len(asked))
    for turn in range(len(shard)):
        # a bound equal to the k-th score may still bring a smaller id
        active = active[bound[active, order[active, turn]] >= best.score[active, -1]]
        for b in np.unique(order[active, turn]):
            now = active[order[active, turn] == b]
            ids = np.frombuffer(shard["ids"].iloc[b], "<i8")
            held = np.frombuffer(shard["vectors"].iloc[b], "<i8").reshape(len(ids), -1)
            score = _products(asked[now][:, : held.shape[1]], held)
            fits = score >= best.score[now, -1][:, None]
            own = own_block[now] == numbers[b]
            fits[np.flatnonzero(own), own_place[now][own]] = False
            row, column = np.nonzero(fits)
            best.take(now[row], score[row, column], ids[column])
    row, column = np.nonzero(best.id != np.iinfo(np.int64).max)
    return pd.DataFrame(
        {
            "block": own_block[row],
            "place": own_place[row],
            "query_id": queries["query_id"].to_numpy()[row],
            "vec_id": best.id[row, column],
            "score": best.score[row, column],
        }
    )


def top_k(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the best k of all other rows for each query."""
    held = pin(blocks(integer_vectors(vectors)), "blocks")
    asked = pin(queries_of(held, every), "queries")
    shards, groups = -(-held.count() // SHARD_BLOCKS), -(-asked.count() // GROUP_QUERIES)
    of_shard = F.pmod(F.xxhash64("block"), F.lit(max(1, shards))).cast("int")
    of_group = F.pmod(F.xxhash64("block", "place"), F.lit(max(1, groups))).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
    left = asked.withColumn("group", of_group).withColumn("shard", every_of(shards))
    right = held.withColumn("shard", of_shard).withColumn("group", every_of(groups))

    def meet(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or shard.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("block", "place", "query_id", "vec_id", "score")})
        return search(queries, shard, k)

    found = left.groupBy("group", "shard").cogroup(right.groupBy("group", "shard"))
    found = found.applyInPandas(meet, "block long, place long, query_id long, vec_id long, score long")
    ranking = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
