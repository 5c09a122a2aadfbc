"""Counts of 64-bit keys in Spark, kept as sorted arrays that tasks map into memory.

Tasks count the keys of what they read in sorted arrays and cut these by key range ("shards").
One row holds one shard of one array, compressed: sorted keys as differences in byte planes. So
the shuffle moves few, dense rows. A shard is merged in one task; the number of shards grows with
the data. A merged shard is a file in the shared folder: plain little-endian arrays, which tasks
map into memory where the folder is a local path, and read shard by shard elsewhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir
from .idfiles import open_folder

#: Keys a task holds before it counts and hands them on; keys per shard to aim at.
BUFFER, PER_SHARD = 2_000_000, 2_500_000


def pack(values: np.ndarray) -> bytes:
    """An ascending array of unsigned 64-bit integers, as differences in compressed byte planes."""
    return pack_any(np.diff(values, prepend=np.uint64(0)))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_any(data), dtype=np.uint64)


def pack_any(values: np.ndarray) -> bytes:
    """Unsigned 64-bit integers in compressed byte planes, as many as the largest value needs."""
    import zstandard

    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_any(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :data[0]] = planes.T
    return out.view("<u8").reshape(-1)


def shard_edges(shards: int) -> np.ndarray:
    """The first key of each shard but the first."""
    return np.array([(i << 64) // shards for i in range(1, shards)], dtype=np.uint64)


def count_sorted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")  # merges the sorted runs it is made of
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def shards_for(docs: DataFrame, text_col: str) -> int:
    """As many shards as the words of all texts need (six bytes a word), at least the shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (6 * PER_SHARD)))


def count_keys(rows: DataFrame, keys_of: Callable[[Iterable[pa.RecordBatch]], Iterable[np.ndarray]], shards: int) -> DataFrame:
    """(shard, keys, counts) rows of all key arrays that ``keys_of`` makes of the batches of a task."""
    edges = shard_edges(shards)

    def count(batches):
        held, size = [], 0

        def flush():
            keys, counts = count_sorted(np.concatenate(held))
            cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
            used = np.flatnonzero(np.diff(cut)).tolist()
            parts = [(pack(keys[cut[i]:cut[i + 1]]), pack_any(counts[cut[i]:cut[i + 1]].astype(np.uint64))) for i in used]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([p[0] for p in parts], pa.binary()),
                                               pa.array([p[1] for p in parts], pa.binary())], names=["shard", "keys", "counts"])

        for keys in keys_of(batches):
            held.append(keys)
            size += len(keys)
            if size >= BUFFER:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return rows.mapInArrow(count, "shard int, keys binary, counts binary")


def merged(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """Shard number, keys and counts of all rows of one shard."""
    keys = np.concatenate([unpack(x.as_py()) for x in table.column("keys")])
    counts = np.concatenate([unpack_any(x.as_py()) for x in table.column("counts")])
    return table.column("shard")[0].as_py(), *count_sorted(keys, counts)


def new_store(spark: SparkSession) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/arrays-{uuid.uuid4().hex}"
    where, folder = open_folder(path)
    where.create_dir(folder, recursive=True)
    return path


def write_arrays(store: str, **arrays: np.ndarray) -> str:
    """Write one file per array under a name of its own attempt; returns that name."""
    where, folder = open_folder(store)
    name = uuid.uuid4().hex
    for kind, values in arrays.items():
        with where.open_output_stream(f"{folder}/{name}.{kind}") as out:
            out.write(np.ascontiguousarray(values).tobytes())
    return name


def read_array(store: str, name: str, kind: str, dtype) -> np.ndarray:
    where, folder = open_folder(store)
    path = f"{folder}/{name}.{kind}"
    if where.type_name == "local":
        import os

        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype=dtype)
    with where.open_input_file(path) as source:
        return np.frombuffer(source.read(), dtype=dtype)


class Arrays:
    """The shards of a store. ``files`` has the file name of each shard (None: no keys), and
    ``sizes`` its number of keys; the rank of a key counts all keys of earlier shards too."""

    def __init__(self, store: str, files: list[str | None], sizes: list[int], key: str = "keys"):
        self.store, self.files, self.key = store, files, key
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.edges, self.open = shard_edges(len(files)), {}

    def get(self, shard: int, kind: str, dtype) -> np.ndarray:
        at = (shard, kind)
        if at not in self.open:
            if len(self.open) > 4096:
                self.open.clear()
            self.open[at] = read_array(self.store, self.files[shard], kind, dtype)
        return self.open[at]

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def look_up(self, ascending: np.ndarray, **values) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The rank of each of some ascending keys (-1: absent), and the values beside it (0)."""
        rank = np.full(len(ascending), -1, dtype=np.int64)
        got = {k: np.zeros(len(ascending), dtype=t) for k, t in values.items()}
        cut = np.concatenate([[0], np.searchsorted(ascending, self.edges), [len(ascending)]])
        for shard in np.flatnonzero(np.diff(cut)).tolist():
            if self.files[shard] is None:
                continue
            keys, a, b = self.get(shard, self.key, np.uint64), cut[shard], cut[shard + 1]
            own = ascending[a:b]
            at = np.searchsorted(keys, own)
            at[at == len(keys)] = 0
            hit = np.asarray(keys[at]) == own if len(keys) else np.zeros(len(own), dtype=bool)
            rank[a:b] = np.where(hit, at + self.first[shard], -1)
            for kind, dtype in values.items():
                if len(keys):
                    got[kind][a:b] = np.where(hit, self.get(shard, kind, dtype)[at], 0)
        return rank, got


def store_of(store: str, rows, shards: int) -> Arrays:
    """Arrays from (shard, file, n) rows, one per shard."""
    files: list[str | None] = [None] * shards
    sizes = [0] * shards
    for shard, file, n in rows:
        files[shard], sizes[shard] = file, n
    return Arrays(store, files, sizes)
