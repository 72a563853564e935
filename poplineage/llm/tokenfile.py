"""Token ids in binary shards: one zstandard frame per document, one dictionary for all.

A folder holds ``dictionary-<sha256>`` and shards. A shard is a header (magic, dictionary hash, bytes per id), the frames,
the index (document ids, token counts and frame offsets, eight bytes each) and a footer (place of the index, number
of documents, magic). A single document is read by its index entry alone. Shards follow ascending ``doc_id``, nulls
first; documents of one id follow the hash of their text, so a hot id is spread over shards.

A task writes a shard under a name of its own and moves it into place when it is whole, and the manifest names the
files of the attempts that counted; a lost executor leaves at most an unnamed file behind.

The dictionary is trained on a bounded sample: about ``SAMPLE_DOCS`` different documents, chosen by their hash, and
at most ``SAMPLE_CHARS`` characters of each. Every document is written whole.

Defined cases: a null or empty text has the end id alone; a null ``doc_id`` is written as the smallest long and read back as null; with too few
documents to train on, the sample itself is the dictionary; no documents give no shard; a very long text is one frame;
repeated rows are written one by one; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import pin, scratch_path
from . import bpe
from . import words as W

#: Parameters: bounds of the sample that the dictionary is trained on, its size, and the level of compression.
SAMPLE_DOCS = 2_000
SAMPLE_CHARS = 4_096
DICTIONARY_BYTES = 64 << 10
LEVEL = 3

MAGIC = b"PLTOKZ01"
HEADER = "<8s32sQ"
FOOTER = "<QQ8s"
NO_ID = -(1 << 63)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if ":/" in path:
        return fs.FileSystem.from_uri(path if "://" in path else path.replace(":/", ":///", 1))
    return fs.LocalFileSystem(), path


def sampled(rows: DataFrame, size: int) -> DataFrame:
    """About ``size`` rows, the same ones in every run: those whose hash lies in that share of all hashes."""
    share = F.lit(size / max(1, rows.count()))
    return rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 31)) < share * (1 << 31))


def train_dictionary(docs: DataFrame, vocabulary: str, kind: np.dtype) -> bytes:
    """A dictionary for serialized ids from the bounded sample; the same sample gives the same dictionary."""
    drawn = sampled(docs.select("doc_id", "text"), SAMPLE_DOCS)
    chosen = drawn.select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text")).filter("length(text) > 0")
    rows = sorted(chosen.distinct().collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.text))
    own = bpe.codec(vocabulary)
    samples = []
    for row in rows:
        data = np.frombuffer(row.text.encode(), np.uint8)
        samples.append(own.encode(data, np.array([0, len(data)]))[0].astype(kind).tobytes())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def write_tokens(docs: DataFrame, path: str, end_id: int, folder: str) -> DataFrame:
    """Writes all documents; the manifest: one row per shard, with the ids of all shards before it."""
    vocabulary = bpe.read_vocabulary(path)
    size = len(bpe.codec(vocabulary).tokens)
    kind = np.dtype("<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4")
    dictionary = train_dictionary(docs, vocabulary, kind)
    digest = hashlib.sha256(dictionary).digest()
    at, base = _place(folder)
    at.create_dir(base, recursive=True)
    with at.open_output_stream(f"{base}/dictionary-{digest.hex()}") as out:
        out.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.codec(vocabulary)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        at, base = _place(folder)
        number = TaskContext.get().partitionId()
        name = f"shard-{number:06d}-{uuid.uuid4().hex}"
        ids_of, counts, offsets_of, written, out = [], [], [], struct.calcsize(HEADER), None
        for batch in batches:
            doc_ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            for row, end, data, offsets in W.text_slices(batch.column("text")):
                if out is None:
                    out = at.open_output_stream(f"{base}/.{name}")
                    out.write(struct.pack(HEADER, MAGIC, digest, kind.itemsize))
                ids, begin = own.encode(data, offsets)
                ids = np.insert(ids.astype(kind), begin[1:], end_id)
                begin = begin + np.arange(len(begin))
                for k in range(end - row):
                    frame = packer.compress(ids[begin[k] : begin[k + 1]].tobytes())
                    out.write(frame)
                    offsets_of.append(written)
                    written += len(frame)
                ids_of.append(doc_ids[row:end])
                counts.append(np.diff(begin))
        if out is None:
            return
        counts = np.concatenate(counts)
        for part in (np.concatenate(ids_of), counts, np.array(offsets_of)):
            out.write(part.astype("<i8").tobytes())
        out.write(struct.pack(FOOTER, written, len(counts), MAGIC))
        out.close()
        at.move(f"{base}/.{name}", f"{base}/{name}")
        yield pa.RecordBatch.from_pydict(
            {"shard": [number], "file": [name], "n_docs": [len(counts)], "n_tokens": [int(counts.sum())]}
        )

    spread = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie")
    ordered = spread.sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    shards = pin(ordered.mapInArrow(write, "shard long, file string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Shard:
    """One shard: its index, and single documents by their place in it."""

    def __init__(self, folder: str, name: str):
        at, base = _place(folder)
        self.file = at.open_input_file(f"{base}/{name}")
        magic, self.digest, self.width = struct.unpack(HEADER, self.file.read_at(struct.calcsize(HEADER), 0))
        size = self.file.size()
        self.end, count, tail = struct.unpack(FOOTER, self.file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError(f"{name} is no whole shard")
        index = np.frombuffer(self.file.read_at(3 * 8 * count, self.end), "<i8").reshape(3, count)
        self.doc_ids, self.counts = index[0], index[1]
        self.offsets = np.append(index[2], self.end)
        with at.open_input_file(f"{base}/dictionary-{self.digest.hex()}") as held:
            dictionary = held.read()
        if hashlib.sha256(dictionary).digest() != self.digest:
            raise ValueError("the dictionary is another than the one written with")
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def ids(self, k: int) -> np.ndarray:
        frame = self.file.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k]))
        held = self.unpacker.decompress(frame, max_output_size=int(self.counts[k]) * self.width)
        return np.frombuffer(held, f"<u{self.width}").astype("<u4")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids`` (little-endian 32-bit integers) of every document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                shard = Shard(folder, name)
                starts = base + np.cumsum(shard.counts) - shard.counts
                row = 0
                while row < len(starts):
                    # about a million ids in one batch, and one document at least
                    end = max(row + 1, int(np.searchsorted(starts, starts[row] + (1 << 20))))
                    ids = [shard.ids(k).tobytes() for k in range(row, end)]
                    doc_ids = shard.doc_ids[row:end]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc_ids, mask=doc_ids == NO_ID),
                            pa.array(starts[row:end]),
                            pa.array(shard.counts[row:end]),
                            pa.array(ids, pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )
                    row = end
                shard.file.close()

    # As many tasks as shards: a number that is asked for is not made smaller at run time.
    files = manifest.select("shard", "file", "start").repartitionByRange(max(1, manifest.count()), "shard")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def scratch_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "tokens")
