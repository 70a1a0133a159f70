"""Binary token store: a shared zstandard dictionary, one frame per document, an offset index.

A store is a folder: ``dictionary.zdict`` (trained on serialized id arrays of a bounded sample
of short documents), one ``.ids`` file per range of ``doc_id``, and ``manifest`` (Parquet),
which names the files that count - a file left by a lost or repeated task attempt is never
read.  One file:

    header   4s magic, u16 bytes per id, 32s SHA-256 of the dictionary (zeros: none)
    frames   one zstandard frame per document, each compressed by itself
    index    INDEX records: doc_id, null flag, ids before it in this file, frame place, ids
    footer   u64 index place, u64 documents, 4s magic

The index lets a reader fetch one document with one short read.  The folder must lie in a
store that pyarrow's file systems reach from every executor.

Results: rows are written in ascending (doc_id, text hash) order, nulls first; null and empty
texts hold the end id alone; repeated rows are kept; other columns are ignored; an empty table
gives a store without files; a very long text is a slice and a frame of its own.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import bounded_sample, encoded

MAGIC = b"TWZ1"
HEADER, FOOTER = "<4sH32s", "<QQ4s"
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("start", "<u8"), ("at", "<u8"), ("size", "<u8"), ("ids", "<u8")])
NO_DICTIONARY = bytes(32)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[a-z0-9]+:/", path):
        return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, samples: int = 2000,
                     sample_chars: int = 4000, size: int = 64 << 10) -> bytes:
    """A dictionary from about ``samples`` whole documents of at most ``sample_chars``
    characters: short documents are the ones that need it.  Empty if there are too few."""
    short = docs.where(F.length("text").between(1, sample_chars))
    rows = bounded_sample(short.select("doc_id", "text"), samples, "doc_id", "text").sort("doc_id", "text").collect()
    batch = pa.RecordBatch.from_pydict({"text": pa.array([r.text for r in rows], pa.string())})
    arrays = [ids.tobytes() for _, part in encoded([batch], tokenizer, end_id) for ids in part]
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _compression(dictionary: bytes) -> tuple[dict, bytes]:
    if not dictionary:
        return {}, NO_DICTIONARY
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)}, hashlib.sha256(dictionary).digest()


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, level: int = 3) -> None:
    """Encode every whole text and write the store.  One shuffle of the texts by ranges of
    doc_id; ids exist only inside the tasks that write them."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dictionary = train_dictionary(rows, tokenizer, end_id)
    where, folder = filesystem(path)
    where.create_dir(folder, recursive=True)
    with where.open_output_stream(f"{folder}/dictionary.zdict") as out:
        out.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        where, folder = filesystem(path)
        options, digest = _compression(dictionary)
        press = zstandard.ZstdCompressor(level=level, write_content_size=True, write_dict_id=False, **options)
        out, index, at, start = None, [], struct.calcsize(HEADER), 0
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
        for part, arrays in encoded(batches, tokenizer, end_id):
            if out is None:
                out = where.open_output_stream(f"{folder}/{name}", buffer_size=1 << 20)
                out.write(struct.pack(HEADER, MAGIC, arrays[0].dtype.itemsize, digest))
            records = np.zeros(len(arrays), INDEX)
            for k, (doc_id, ids) in enumerate(zip(part.column("doc_id").to_pylist(), arrays)):
                frame = press.compress(ids.tobytes())
                out.write(frame)
                records[k] = (doc_id or 0, doc_id is None, start, at, len(frame), len(ids))
                at, start = at + len(frame), start + len(ids)
            index.append(records)
        if out is not None:
            records = np.concatenate(index)
            out.write(records.tobytes())
            out.write(struct.pack(FOOTER, at, len(records), MAGIC))
            out.close()
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [name],
                "docs": pa.array([len(records)], pa.int64()), "tokens": pa.array([start], pa.int64())})

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    (rows.repartitionByRange(*order).sortWithinPartitions(*order)
     .mapInArrow(write, "shard int, file string, docs long, tokens long")
     .write.parquet(f"{path}/manifest"))


class Shard:
    """One file of a store: its index, and any document by its position."""

    def __init__(self, where: fs.FileSystem, folder: str, name: str, dictionary: bytes):
        options, digest = _compression(dictionary)
        self.file = where.open_input_file(f"{folder}/{name}")
        magic, width, wanted = struct.unpack(HEADER, self.file.read_at(struct.calcsize(HEADER), 0))
        end = self.file.size() - struct.calcsize(FOOTER)
        at, count, tail = struct.unpack(FOOTER, self.file.read_at(struct.calcsize(FOOTER), end))
        if magic != MAGIC or tail != MAGIC or wanted != digest:
            raise ValueError(f"{name}: not a token file of this dictionary")
        self.ids = np.dtype(f"<u{width}")
        self.index = np.frombuffer(self.file.read_at(end - at, at), INDEX, count)
        self.press = zstandard.ZstdDecompressor(**options)

    def document(self, k: int) -> np.ndarray:
        _, _, _, at, size, _ = self.index[k].tolist()
        return np.frombuffer(self.press.decompress(self.file.read_at(size, at)), self.ids)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (binary,
    little-endian unsigned 32-bit) of every document, read back from the files."""
    files = spark.read.parquet(f"{path}/manifest")
    # one row per file: bounded by the number of shuffle partitions
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = filesystem(path)
        dictionary = None
        for row in (r for batch in batches for r in batch.to_pylist()):
            if dictionary is None:
                with where.open_input_stream(f"{folder}/dictionary.zdict") as f:
                    dictionary = f.read()
            shard = Shard(where, folder, row["file"], dictionary)
            at = 0
            while at < len(shard.index):
                ends = np.cumsum(shard.index["ids"][at:])
                to = at + max(1, int(np.searchsorted(ends, 1 << 20, side="right")))
                part = shard.index[at:to]
                yield pa.RecordBatch.from_arrays([
                    pa.array(part["doc_id"], pa.int64(), mask=part["null"] > 0),
                    pa.array(part["start"].astype(np.int64) + row["base"]),
                    pa.array(part["ids"].astype(np.int64)),
                    pa.array([shard.document(k).astype("<u4").tobytes() for k in range(at, to)], pa.binary()),
                ], ["doc_id", "start", "n_tokens", "ids"])
                at = to

    spread = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
