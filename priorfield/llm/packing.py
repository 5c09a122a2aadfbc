"""Packing along a space-filling curve.

A document's hashed word vector is projected to a few dimensions; the Hilbert key of that point
orders documents so that neighbours on the curve are alike. Documents are sorted by range of the
key, and each range lays the ids of its documents end to end and cuts them into sequences, so a
sequence holds neighbouring documents. What a range has left over is cut at powers of two, which
need no padding; so no sequence is padded at all.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .hashing import mix, word_groups
from .tokens import VAST, encoder

DIMENSIONS, BITS = 4, 12
BUCKETS = 1024
PIECE_COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def projection(buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A fixed matrix of signs, from hashes of its places."""
    cell = np.arange(buckets * dimensions, dtype=np.uint64) + np.uint64(1)
    return np.where(mix(cell) >> np.uint64(63), 1.0, -1.0).reshape(buckets, dimensions)


def document_point(words: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Hash words to signed buckets, damp counts by their square root, scale to length one, project."""
    n = np.bincount((words % np.uint64(len(matrix))).astype(np.int64), minlength=len(matrix))
    vector = np.sqrt(n)
    length = np.sqrt((vector * vector).sum())
    return vector @ matrix / length if length else np.zeros(matrix.shape[1])


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (rows), by the public transpose algorithm
    (Skilling, 2004): undo excess rotations from the top bit down, Gray-encode, interleave."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[n - 1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Squeeze unbounded coordinates into a grid (tanh spreads them evenly enough) and take the key."""
    grid = np.floor((np.tanh(points) + 1) / 2 * ((1 << bits) - 1)).astype(np.int64)
    return hilbert_key(grid, bits)


def curve_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and curve key of every row."""
    matrix = projection()

    @F.arrow_udf("long")
    def key(texts: pa.Array) -> pa.Array:
        points = np.zeros((len(texts), DIMENSIONS))
        for first, starts, words in word_groups([t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]):
            for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                points[first + i] = document_point(words[a:b], matrix)
        return pa.array(curve_keys(points), pa.int64())

    # only the text goes to Python, and no text comes back
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.withColumn("key", key("text"))


def tail_sizes(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class _Packer:
    """Lays documents end to end; holds the ids of one document and of the sequence being filled."""

    def __init__(self, part: int, size: int):
        self.size, self.sequence = size, part << 40
        self.open: list[tuple] = []  # pieces of the open sequence: id, start, ids, doc_tokens
        self.filled = 0

    def add(self, doc_id, ids: np.ndarray):
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, self.size - self.filled)
            self.open.append((doc_id, at, ids[at:at + n], len(ids)))
            self.filled += n
            at += n
            if self.filled == self.size:
                yield from self._close(self.open)
                self.open, self.filled = [], 0

    def _close(self, pieces):
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset
            offset += len(ids)
        self.sequence += 1

    def finish(self):
        """Cut what is left into sequences whose lengths are powers of two."""
        for size in tail_sizes(self.filled):
            taken, room = [], size
            while room:
                doc_id, start, ids, total = self.open.pop(0)
                taken.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    self.open.insert(0, (doc_id, start + room, ids[room:], total))
                room -= len(taken[-1][2])
            yield from self._close(taken)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 4096, id_col: str = "doc_id", text_col: str = "text",
                   cache: tuple[int, int] = (VAST, 1_000_000)) -> DataFrame:
    """Pack whole documents into sequences of at most ``size`` tokens; one row per piece.

    Every id of a document (its tokens and ``end_id``) lies in exactly one piece. A sequence is
    full, or its length is a power of two. ``sequence_id`` has the range in its upper bits; it is
    unique, not gapless. Null texts count as empty (end id only) and lie together on the curve,
    null ids stay null, repeated rows are all packed, and an empty table gives no pieces. Equal
    texts share a key and are spread over ranges by a hash of their id. ``cache`` bounds the words and pieces
    whose ids a worker keeps: fewer take less memory and more time.
    """
    tie = F.xxhash64("doc_id")
    # the ranges are taken from all keys, so without a copy the keys would be computed twice
    keyed = materialize(curve_order(docs, id_col, text_col).withColumn("tie", tie))
    ordered = keyed.repartitionByRange("key", "tie").sortWithinPartitions(
        "key", "tie", "doc_id", "text").select("doc_id", "text")
    names = [c.split()[0] for c in PIECE_COLUMNS.split(", ")]

    def pack(batches):
        from pyspark import TaskContext

        encode, packer = encoder(tokenizer, cache).encode_column, _Packer(TaskContext.get().partitionId(), size)

        def frame(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

        rows = []
        for batch in batches:
            for doc_id, ids in zip(batch.column(0), encode(batch.column(1))):
                rows += packer.add(doc_id.as_py(), np.append(ids, np.uint32(end_id)))
                if len(rows) >= 10_000:
                    yield frame(rows)
                    rows = []
        rows += packer.finish()
        if rows:
            yield frame(rows)

    return ordered.mapInArrow(pack, PIECE_COLUMNS)
