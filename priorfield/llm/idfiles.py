"""Token-id files: bit-plane shuffled, compressed blocks with a chunk index.

A file holds the ids of documents in ascending order of their id. Ids are cut into blocks of a
fixed number; a block is transposed into byte planes (all lowest bytes, then all next bytes, ...)
or bit planes, and each plane is compressed on its own with zstandard: the upper planes of token
ids are nearly constant and shrink to almost nothing. Layout of a file:

    magic (8 bytes)
    planes of block 0, planes of block 1, ...
    index: sizes of all planes (uint32), then per document its id (int64), whether the id is
           null (uint8) and its number of ids (int64); compressed as a whole
    footer: blocks, documents, ids, ids per block, planes per block, bits per plane, index size (int64 each), magic

Files are written to shared storage through pyarrow's file systems under a name of the task
attempt; only files named in the manifest count, so a lost or repeated attempt does no harm.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import shared_dir
from .tokens import encoder

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
_FOOTER = 7


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The byte planes (bits = 8) or bit planes (bits = 1) of unsigned 32-bit ids, lowest first."""
    by_byte = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    if bits == 8:
        return [np.ascontiguousarray(p).tobytes() for p in by_byte]
    return [np.packbits((p >> k) & 1).tobytes() for p in by_byte for k in range(8)]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    if bits == 8:
        by_byte = [np.frombuffer(p, dtype=np.uint8) for p in planes]
    else:
        flat = [np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n) for p in planes]
        by_byte = [sum((flat[8 * b + k] << k for k in range(8)), np.zeros(n, dtype=np.uint8)) for b in range(4)]
    return np.ascontiguousarray(np.stack(by_byte, axis=1)).view("<u4").reshape(-1)


class _File:
    """Writes one file block by block; at most one block of ids and the index stay in memory."""

    def __init__(self, path: str, block: int, bits: int):
        import zstandard

        where, name = open_folder(path)
        self.out, self.block, self.bits = where.open_output_stream(name), block, bits
        self.pack = zstandard.ZstdCompressor(level=3)
        self.rest, self.waiting, self.sizes, self.ids = [], 0, [], 0
        self.docs: list[tuple[int, int, int]] = []
        self.out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray):
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            every = np.concatenate(self.rest)
            for i in range(0, len(every) - self.block + 1, self.block):
                self._write(every[i:i + self.block])
            self.rest = [every[len(every) // self.block * self.block:]]
            self.waiting = len(self.rest[0])

    def _write(self, ids: np.ndarray):
        self.ids += len(ids)
        for plane in to_planes(ids, self.bits):
            small = self.pack.compress(plane)
            self.sizes.append(len(small))
            self.out.write(small)

    def close(self) -> tuple[int, int]:
        if self.waiting:
            self._write(np.concatenate(self.rest))
        docs = np.array(self.docs, dtype=np.int64).reshape(-1, 3)
        index = self.pack.compress(np.array(self.sizes, dtype="<u4").tobytes() + docs[:, 0].astype("<i8").tobytes()
                                   + docs[:, 1].astype(np.uint8).tobytes() + docs[:, 2].astype("<i8").tobytes())
        planes = 32 // self.bits
        self.out.write(index)
        self.out.write(np.array([len(self.sizes) // planes, len(docs), self.ids, self.block, planes, self.bits, len(index)], dtype="<i8").tobytes() + MAGIC)
        self.out.close()
        return len(docs), self.ids


def read_file(path: str):
    """The (id, ids) of each document of a file in turn; blocks are read one at a time."""
    import zstandard

    where, name = open_folder(path)
    with where.open_input_file(name) as source:
        size, tail = source.size(), 8 * _FOOTER + 8
        source.seek(size - tail)
        end = source.read(tail)
        if end[-8:] != MAGIC:
            raise ValueError(f"{path} is not a complete token-id file")
        blocks, n_docs, n_ids, block, planes, bits, index_size = np.frombuffer(end[:-8], dtype="<i8").tolist()
        unpack = zstandard.ZstdDecompressor()
        source.seek(size - tail - index_size)
        index = unpack.decompress(source.read(index_size))
        cut = np.cumsum([0, 4 * blocks * planes, 8 * n_docs, n_docs, 8 * n_docs])
        sizes, keys, nulls, counts = (np.frombuffer(index[a:b], dtype=t) for a, b, t in zip(cut[:-1], cut[1:], ("<u4", "<i8", "u1", "<i8")))
        source.seek(len(MAGIC))
        have, at = [], 0

        def more():
            nonlocal at
            n = min(block, n_ids - at * block)
            parts = [unpack.decompress(source.read(int(s))) for s in sizes[at * planes:(at + 1) * planes]]
            at += 1
            return from_planes(parts, n, bits)

        rest = np.empty(0, dtype="<u4")
        for key, null, count in zip(keys.tolist(), nulls.tolist(), counts.tolist()):
            have, got = [rest], len(rest)
            while got < count:
                have.append(more())
                got += len(have[-1])
            every = np.concatenate(have) if len(have) > 1 else rest
            yield (None if null else key), every[:count]
            rest = every[count:]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
              block: int = BLOCK, bits: int = 8) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each, and write files in ascending order of the id.

    Returns the manifest, also written below ``path``: file, part, docs, ids and start (ids in all
    files before). Null texts count as empty, so they have the end id only; null ids come first;
    rows of one id follow each other in an order fixed by their text; repeated rows are all
    written. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), tie.alias("tie"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text")
    where, folder = open_folder(path)
    where.create_dir(folder, recursive=True)

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        encode, out, name = encoder(tokenizer).encode_column, None, f"part-{task.partitionId():06d}-{uuid.uuid4().hex[:12]}"
        for batch in batches:
            for doc_id, ids in zip(batch.column(0), encode(batch.column(1))):
                out = out or _File(f"{path}/{name}", block, bits)
                out.add(doc_id.as_py(), np.append(ids, np.uint32(end_id)))
        if out:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "part": [task.partitionId()], "docs": [n_docs], "ids": [n_ids]},
                                             schema=pa.schema([("file", pa.string()), ("part", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]))

    ordered.mapInArrow(write, "file string, part long, docs long, ids long").write.parquet(f"{path}/_files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    manifest = spark.read.parquet(f"{path}/_files").withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    manifest.write.parquet(f"{path}/_manifest")
    return spark.read.parquet(f"{path}/_manifest")


def read_ids(spark: SparkSession, path: str, batch_bytes: int = 4 << 20) -> DataFrame:
    """The documents of the files below ``path``: doc_id, start (ids of all documents before),
    n_tokens and ids (unsigned 32-bit, little-endian). One task reads a file at a time."""
    manifest = spark.read.parquet(f"{path}/_manifest").select("file", "start")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches):
        rows, size = [], 0
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for doc_id, ids in read_file(f"{path}/{file}"):
                    rows.append((doc_id, start, len(ids), ids.tobytes()))
                    start += len(ids)
                    size += 4 * len(ids)
                    if size >= batch_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    files = spark.sparkContext.defaultParallelism * 4
    return manifest.repartition(files, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
