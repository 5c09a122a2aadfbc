"""Exact top-k by inner product: vectors by descending length, rotated partial sums, residual bounds.

Vectors are dealt by range of their length, longest first, and packed into blocks. The singular
vectors of all data (from the sum of their products, a matrix of fixed size) rotate the space so
that the first coordinates carry most of an inner product. For each block a task bounds the inner
products of all queries: first by the two lengths, then by the partial sum over the first
coordinates plus the product of the lengths of the rest (Cauchy-Schwarz). Only vectors whose bound
reaches the query's k-th score so far are scored, in integers. Queries come in groups of a bounded
size, so what is sent to the tasks never grows with the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize

BLOCK, GROUP, HEAD = 1024, 1024, 16
#: Above this size of a sum of products, 64-bit integers could overflow.
LARGEST = 2.0 ** 62


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, ints: floor(256 x) of each component as double; rows without id, vector, components, or with a null or non-finite component are left out."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter(
        F.col("id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return rows.select("id", F.transform("x", lambda v: F.floor(v * 256.0)).alias("ints"))


def pack_blocks(rows: DataFrame, width: int) -> DataFrame:
    """Blocks in descending order of length: block number, ids and matrix as bytes; short vectors are filled up with zeros."""
    length = F.aggregate("ints", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    ordered = rows.withColumn("length", length).repartitionByRange(F.desc("length"), F.xxhash64("id")).sortWithinPartitions(F.desc("length"), "id")

    def pack(batches):
        from pyspark import TaskContext

        part, number, ids, vectors = TaskContext.get().partitionId(), 0, [], []

        def block():
            m = np.zeros((len(ids), width), dtype="<i8")
            for i, v in enumerate(vectors):
                m[i, :len(v)] = v
            if (m.astype(float) ** 2).sum(axis=1).max() > LARGEST:
                raise OverflowError("inner products of these vectors do not fit 64-bit integers")
            return pa.RecordBatch.from_arrays([pa.array([part << 23 | number]), pa.array([np.array(ids, dtype="<i8").tobytes()]), pa.array([m.tobytes()])],
                                              names=["block", "ids", "matrix"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                vectors.append(v.values.to_numpy(zero_copy_only=False))
                if len(ids) == BLOCK:
                    yield block()
                    number, ids, vectors = number + 1, [], []
        if ids:
            yield block()

    return ordered.select("id", "ints").mapInArrow(pack, "block long, ids binary, matrix binary")


def rotation(blocks: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of all vectors, by the eigenvectors of the sum of their products (width x width numbers)."""

    def products(batches):
        total = np.zeros((width, width))
        for batch in batches:
            for m in batch.column(0).to_pylist():
                x = np.frombuffer(m, dtype="<i8").reshape(-1, width).astype(float)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["cell", "x"])

    cells = blocks.select("matrix").mapInArrow(products, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(width * width)
    for r in cells:
        total[r["cell"]] = r["x"]
    values, vectors = np.linalg.eigh(total.reshape(width, width))
    return vectors[:, np.argsort(-values)]


def best_scores(blocks: DataFrame, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, turn: np.ndarray, k: int) -> DataFrame:
    """Each task's best k vectors of a group of queries: query number, vector id, score."""
    width = queries.shape[1]
    shared = blocks.sparkSession.sparkContext.broadcast((ids, rows, queries, turn))  # at most GROUP queries

    def search(batches):
        ids, rows, queries, turn = shared.value
        turned = queries @ turn
        head = min(HEAD, width)
        q_head, q_rest = turned[:, :head], np.sqrt((turned[:, head:] ** 2).sum(axis=1))
        q_length = np.sqrt((turned ** 2).sum(axis=1))
        exact = queries.astype(np.int64)
        least = np.full(len(ids), -np.inf)
        best_s = [np.empty(0, dtype=np.int64) for _ in ids]
        best_i = [np.empty(0, dtype=np.int64) for _ in ids]
        for batch in batches:
            for number, own, matrix in zip(*(c.to_pylist() for c in batch.columns)):
                x_id = np.frombuffer(own, dtype="<i8")
                m = np.frombuffer(matrix, dtype="<i8").reshape(-1, width)
                x = m @ turn
                length = np.sqrt((x ** 2).sum(axis=1))
                slack = 1e-9 * (1 + length.max() * (q_length.max() if len(q_length) else 0))  # rounding of the bounds
                open_ = np.flatnonzero(q_length * length.max() + slack >= least)
                if not len(open_):
                    continue
                rest = np.sqrt((x[:, head:] ** 2).sum(axis=1))
                bound = q_head[open_] @ x[:, :head].T + np.outer(q_rest[open_], rest) + slack
                place = (number << 20) + np.arange(len(x_id))
                for at, q in enumerate(open_):
                    near = np.flatnonzero(bound[at] >= least[q])
                    near = near[place[near] != rows[q]]  # every row but the query's own
                    if not len(near):
                        continue
                    s = np.concatenate([best_s[q], m[near] @ exact[q]])
                    i = np.concatenate([best_i[q], x_id[near]])
                    order = np.lexsort((i, -s))[:k]
                    best_s[q], best_i[q] = s[order], i[order]
                    if len(order) == k:
                        least[q] = s[order[-1]]
        n = [len(s) for s in best_s]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, n)), pa.array(np.repeat(ids, n)), pa.array(np.concatenate(best_i)), pa.array(np.concatenate(best_s))],
                                             names=["row", "query_id", "vec_id", "score"])

    return blocks.mapInArrow(search, "row long, query_id long, vec_id long, score long")


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``: the k other rows with the highest inner product.

    Components are floor(256 x) and scores whole numbers. Returns query_id, rank (from 1), vec_id
    and score; ties go to the smaller id; all rows if there are fewer. Rows without id and vectors
    that are null, empty or hold null or non-finite components take no part; shorter vectors count
    as filled up with zeros. Rows that repeat an id are separate candidates and separate queries.
    An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    rows = whole_numbers(vectors, id_col, vector_col)
    width = rows.agg(F.max(F.size("ints"))).first()[0]
    if not width:
        return spark.createDataFrame([], result)
    blocks = materialize(pack_blocks(rows, width))
    turn = rotation(blocks, width)

    def pick(batches):
        for batch in batches:
            for number, own, matrix in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(own, dtype="<i8")
                at = np.flatnonzero(ids % every == 0)
                m = np.frombuffer(matrix, dtype="<i8").reshape(-1, width)[at]
                yield pa.RecordBatch.from_arrays([pa.array((number << 20) + at), pa.array(ids[at]), pa.array([v.tobytes() for v in m], pa.binary())], names=["row", "id", "vector"])

    queries = materialize(blocks.mapInArrow(pick, "row long, id long, vector binary"))
    groups = -(-queries.count() // GROUP)
    found = None
    for g in range(groups):
        own = queries.filter(F.pmod(F.xxhash64("row"), F.lit(groups)) == g).collect()  # about GROUP rows
        if own:
            q = np.stack([np.frombuffer(r["vector"], dtype="<i8") for r in own]).astype(float)
            part = best_scores(blocks, np.array([r["id"] for r in own]), np.array([r["row"] for r in own]), q, turn, k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], result)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
