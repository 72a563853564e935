"""Near-duplicates by SimHash: ball hashing around every fingerprint, then connected components.

A fingerprint emits itself and its 64 neighbours at one differing bit, which is half of the radius of two. Two
fingerprints at two bits or fewer share such a variant, so the shuffle on variants meets every linked pair; a bucket
holds at most 65 different fingerprints, however many documents carry them, as only distinct fingerprints are dealt.
Within a bucket each fingerprint is linked to its neighbour in sorted order: all of them lie within two bits of each
other, so the chain keeps what is connected without writing out the pairs.

Components come from rounds of minimum labels: every fingerprint takes the smallest label around it, then labels are
followed one step. Links between fingerprints of one label are dropped from round to round. Rounds are cut by tables
in the shared folder.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; a null ``doc_id`` takes part
and gets the smallest id of its component, null if the component has no other; repeated rows are rows of their own
in one component, of which ``one_of_each`` keeps one; among rows of one id the smaller hash of the text stays; bits of a very long text are
summed in pieces; no documents give no rows. Names
that begin with ``__llm`` are not for the input's columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import pin

SHINGLE_WORDS = 3
SEED = 42
BITS = 64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _fingerprint(text: str | None) -> int:
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    size = min(SHINGLE_WORDS, len(words))
    digest = xxhash.xxh64_intdigest
    held = np.fromiter(
        (digest(b" ".join(words[i : i + size]), SEED) for i in range(len(words) - size + 1)), "<u8", len(words) - size + 1
    )
    # Bits are summed in pieces, so that a very long text needs no long bit table.
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(held), 1 << 14):
        piece = held[at : at + (1 << 14)]
        total += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(held), bitorder="little").view("<u8")[0])


def of_texts(texts: pa.Array) -> pa.Array:
    """Fingerprints of the whole texts of a column as signed longs."""
    made = np.fromiter((_fingerprint(text.as_py()) for text in texts), np.uint64, len(texts))
    return pa.array(made.view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``tie`` (a hash of the text) and ``fp``, the fingerprint of the whole text as a signed long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [batch.column("doc_id"), batch.column("tie"), of_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(held, ["doc_id", "tie", "fp"])

    read = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return read.mapInArrow(compute, "doc_id long, tie long, fp long")


def variants(fp: str = "fp") -> Column:
    """The fingerprint and all that differ from it in one bit."""
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), k) for k in range(BITS)])
    return F.transform(flips, lambda x: F.col(fp).bitwiseXOR(x))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: verified links at two bits or fewer that connect all that the radius connects."""
    dealt = distinct.select("fp", F.explode(variants()).alias("variant"))
    met = dealt.withColumn("a", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")))
    pairs = met.filter("a is not null").select("a", F.col("fp").alias("b")).distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes in ``edges``; label is the smallest node of the component.

    Each round works on the links between components found so far: every component hooks to the smallest component
    beside it, the forest of hooks is flattened by doubling, and links are renamed to its roots. Only components
    smaller than all beside them stay, so few rounds are needed.
    """
    edges = pin(edges.select("a", "b"), "links")
    labels: DataFrame | None = None
    while edges.head(1):
        both = edges.union(edges.select("b", "a"))
        hooks = pin(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("up")), "hooks")
        while True:  # flatten: up = up of up
            over = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            step = hooks.join(over, "up").select("node", "up", "top")
            step = pin(step, "hooks")
            hooks = step.select("node", F.col("top").alias("up"))
            if not step.filter("up <> top").head(1):
                break
        root = hooks.select("node", F.col("up").alias("root"))
        left = edges.join(root.withColumnRenamed("node", "a").withColumnRenamed("root", "ra"), "a")
        left = left.join(root.withColumnRenamed("node", "b").withColumnRenamed("root", "rb"), "b")
        left = left.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = pin(left.distinct(), "links")
        if labels is None:
            labels = root.select("node", F.col("root").alias("label"))
        else:
            moved = labels.join(root.select(F.col("node").alias("label"), "root"), "label", "left")
            labels = pin(moved.select("node", F.coalesce("root", "label").alias("label")), "labels")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def families(distinct: DataFrame) -> DataFrame:
    """``distinct`` with the ``label`` of each ``fp``: the smallest fingerprint reachable over links."""
    found = components(links(distinct)).withColumnRenamed("node", "fp")
    return distinct.join(found, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``tie``, ``fp``, ``component_id``: the smallest id reachable over links, and ``first``: whether the row stays."""
    marked = pin(fingerprints(docs), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tie")
    distinct = pin(marked.groupBy("fp").agg(F.min(rank).alias("rank")), "distinct")
    return ranked(marked, pin(families(distinct), "linked"), "fp")


def ranked(marked: DataFrame, linked: DataFrame, node: str) -> DataFrame:
    """Rows of ``marked`` with the smallest id of their component; ``linked`` has label and smallest rank of each node."""
    smallest = linked.groupBy("label").agg(F.min("rank").alias("rank"))
    named = linked.select(node, "label").join(smallest, "label").select(node, "rank")
    first = F.col("doc_id").eqNullSafe(F.col("rank.doc_id")) & (F.col("tie") == F.col("rank.tie"))
    joined = marked.join(named, node)
    return joined.select("doc_id", "tie", node, F.col("rank.doc_id").alias("component_id"), first.alias("first"))


def one_of_each(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``docs`` with the row of the smallest id of each component; ``found`` has the components if not SimHash's."""
    found = near_duplicates(docs) if found is None else found
    stays = found.filter("first").select(F.col("doc_id").alias("__llm_id"), F.col("tie").alias("__llm_tie")).distinct()
    keyed = docs.withColumn("__llm_tie", F.xxhash64("text"))
    kept = keyed.join(stays.withColumnRenamed("__llm_tie", "__llm_first"), F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.col("__llm_tie") == F.col("__llm_first")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__llm_tie"]).drop("__llm_tie")


def hex_digits(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
