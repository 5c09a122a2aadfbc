"""Hard negatives by anchor spanning-tree bounds.

Anchors are dealt by a code of projections, so that near ones share a group of bounded size, and
each group gets a minimum spanning tree. If p is an anchor's parent, d the length of the edge between them
and |x| the length of a candidate, then its score with x lies within d |x| of the parent's
score. So a task scores a block of candidates exactly with the root, walks the tree, and carries
for each anchor bounds of its scores; a candidate is scored anew, exactly, only where its bounds
overlap the window in which the anchor still looks for results.

Two passes over the blocks: the first finds the positives (the window: scores from the k-th best
so far), the second the negatives (the windows below each positive's score, which close from below
as results come in). Groups meet parts of the candidates by a join on the part; nothing of the
vectors passes through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .hashing import mix

#: Vectors of a block, anchors of a group, blocks of a part that one join key holds.
BLOCK, GROUP, PART = 2048, 512, 32
#: Projections of the code that deals anchors to groups; groups a task keeps results of at a time.
BITS, OPEN_GROUPS = 10, 16
#: Above this product of lengths, doubles do not hold inner products exactly; above the second one, 64-bit integers do not.
EXACT, LARGEST = 2.0 ** 53, 2.0 ** 62
ROW_BITS = 20


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, shift_every: int, classes: int) -> DataFrame:
    """id, label, ints: floor(256 x) of each component as double; labels of every ``shift_every``-th id move on by one."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("own"), x.alias("x")).filter(
        F.col("id").isNotNull() & F.col("own").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    label = F.when(F.col("id") % shift_every == 0, (F.col("own") + 1) % classes).otherwise(F.col("own"))
    return rows.select("id", label.alias("label"), F.transform("x", lambda v: F.floor(v * 256.0)).alias("ints"))


def narrow(m: np.ndarray) -> bytes:
    """A matrix of integers in the narrowest of 2, 4 and 8 bytes, with that number in front."""
    most = int(np.abs(m).max()) if m.size else 0
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([width]) + m.astype(f"<i{width}").tobytes()


def widen(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{data[0]}", offset=1).reshape(-1, columns).astype(np.int64)


def stacked(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Vectors as rows, short ones filled up with zeros."""
    m = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        m[i, :len(v)] = v
    if len(m) and (m.astype(float) ** 2).sum(axis=1).max() > LARGEST:
        raise OverflowError("inner products of these vectors do not fit 64-bit integers")
    return m


def pack_blocks(rows: DataFrame, width: int) -> DataFrame:
    """Blocks of at most BLOCK vectors: block, ids, labels, matrix; a row's number is block << ROW_BITS + its place."""
    ordered = rows.repartition(F.xxhash64("id", "label"))  # many rows of one id differ in nothing that matters here

    def pack(batches):
        from pyspark import TaskContext

        part, number, ids, labels, vectors = TaskContext.get().partitionId(), 0, [], [], []

        def block():
            return pa.RecordBatch.from_arrays([pa.array([part << 22 | number]), pa.array([np.array(ids, dtype="<i8").tobytes()]),
                                               pa.array([np.array(labels, dtype="<i8").tobytes()]), pa.array([narrow(stacked(vectors, width))], pa.binary())],
                                              names=["block", "ids", "labels", "matrix"])

        for batch in batches:
            for i, label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids.append(i)
                labels.append(label)
                vectors.append(v.values.to_numpy(zero_copy_only=False))
                if len(ids) == BLOCK:
                    yield block()
                    number, ids, labels, vectors = number + 1, [], [], []
        if ids:
            yield block()

    return ordered.select("id", "label", "ints").mapInArrow(pack, "block long, ids binary, labels binary, matrix binary")


def spanning_tree(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's minimum spanning tree by distance: the order of the nodes, and each node's parent (-1: the root) and edge length."""
    x = m.astype(float)
    n = len(x)
    order, parent, edge = np.zeros(n, dtype=np.int64), np.full(n, -1), np.zeros(n)
    left, best, near = np.ones(n, dtype=bool), np.full(n, np.inf), np.zeros(n, dtype=np.int64)
    at = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    for i in range(n):
        order[i], left[at] = at, False
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        closer = left & (d < best)
        best[closer], near[closer] = d[closer], at
        if i + 1 < n:
            at = int(np.argmin(np.where(left, best, np.inf)))
            parent[at], edge[at] = near[at], best[at]
    return order, parent, edge


def anchor_groups(blocks: DataFrame, width: int, every: int) -> DataFrame:
    """Groups of at most GROUP anchors with their trees: grp, ids, rows, labels, matrix, order, parent, edge."""
    planes = (mix(np.arange(BITS * width, dtype=np.uint64) + np.uint64(1)) >> np.uint64(11)).astype(float).reshape(BITS, width) / 2.0 ** 52 - 1

    def pick(batches):
        for batch in batches:
            for number, ids, labels, matrix in zip(*(c.to_pylist() for c in batch.columns)):
                ids, labels = np.frombuffer(ids, dtype="<i8"), np.frombuffer(labels, dtype="<i8")
                at = np.flatnonzero(ids % every == 0)
                m = widen(matrix, width)[at]
                code = ((m @ planes.T > 0) @ (1 << np.arange(BITS)[::-1])).astype(np.int64)
                code ^= code >> 1  # neighbours on the curve differ in few projections
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array((number << ROW_BITS) + at), pa.array(ids[at]), pa.array(labels[at]),
                                                  pa.array([v.tobytes() for v in m], pa.binary())], names=["code", "row", "id", "label", "vector"])

    # stored: the limits of the ranges and the rows come from the same copy
    anchors = materialize(blocks.select("block", "ids", "labels", "matrix").mapInArrow(pick, "code long, row long, id long, label long, vector binary"))
    parts = max(1, min(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-anchors.count() // GROUP)))
    ranged = anchors.repartitionByRange(parts, "code", F.xxhash64("row")).sortWithinPartitions("code", "row")

    def pack(batches):
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, []

        def group():
            m = np.stack([np.frombuffer(r[3], dtype="<i8") for r in held])
            order, parent, edge = spanning_tree(m)
            numbers = [np.array([r[i] for r in held], dtype="<i8").tobytes() for i in range(3)]
            values = [part << 22 | number, *numbers, narrow(m), order.astype("<i8").tobytes(), parent.astype("<i8").tobytes(), edge.astype("<f8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["grp", "rows", "anchors", "own_labels", "own", "tree", "parent", "edge"])

        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                held.append(r)
                if len(held) == GROUP:
                    yield group()
                    number, held = number + 1, []
        if held:
            yield group()

    return ranged.mapInArrow(pack, "grp long, rows binary, anchors binary, own_labels binary, own binary, tree binary, parent binary, edge binary")


@dataclass
class Best:
    """The first k results of each of some searches: higher scores first, then smaller ids."""

    k: int
    scores: list[np.ndarray]
    ids: list[np.ndarray]
    rows: list[np.ndarray]

    @classmethod
    def start(cls, n: int, k: int) -> "Best":
        none = np.empty(0, dtype=np.int64)
        return cls(k, [none] * n, [none] * n, [none] * n)

    def add(self, at: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        s, i, r = (np.concatenate([a[at], b]) for a, b in ((self.scores, scores), (self.ids, ids), (self.rows, rows)))
        first = np.lexsort((r, i, -s))[:self.k]
        self.scores[at], self.ids[at], self.rows[at] = s[first], i[first], r[first]

    def least(self, at: int) -> float:
        """The score a result must reach."""
        return float(self.scores[at][-1]) if len(self.scores[at]) == self.k else -np.inf


class Searcher:
    """Walks the trees of groups over blocks and keeps the best results of a bounded number of groups.

    ``windows`` names the windows of an anchor: None for the first pass, else per anchor the
    distinct scores of its positives."""

    def __init__(self, width: int, k: int, share: tuple[int, int]):
        self.width, self.k, self.share = width, k, share
        self.scored = 0  # exact scores, for tests
        self.looked = 0

    def floor(self, top: int) -> int:
        """The least whole number s with up * top <= down * s."""
        up, down = self.share
        return -((-up * top) // down)

    def walk(self, group: dict, block: dict, best: Best, tops: list[np.ndarray] | None):
        m, x = group["own"], block["matrix"]
        length = block["length"]
        exact = float(group["length"].max(initial=0) * length.max(initial=0)) < EXACT
        xf = block["float"] if exact else None
        slack = 1e-9 * (1 + group["length"].max(initial=0)) * (1 + length.max(initial=0))  # rounding of distances and lengths
        low, high = np.empty((len(m), len(x))), np.empty((len(m), len(x)))
        for at in group["tree"]:
            p = group["parent"][at]
            label = group["own_labels"][at]
            alike = block["labels"] == label
            if tops is None:
                open_, floor, top = alike & (block["rows"] != group["rows"][at]), best.least(at), np.inf
            else:
                own = tops[at]
                open_ = ~alike
                floors = [max(self.floor(int(t)), best.least(group["first"][at] + j)) for j, t in enumerate(own)]
                floor, top = min(floors, default=np.inf), max(own, default=-np.inf)
            if p < 0:
                ask = np.arange(len(x))
            else:
                reach = group["edge"][at] * length + slack
                low[at], high[at] = low[p] - reach, high[p] + reach
                ask = np.flatnonzero(open_ & (high[at] >= floor) & (low[at] <= top)) if floor <= top else np.empty(0, dtype=np.int64)
            self.looked += len(x)
            if not len(ask):
                continue
            if exact:
                near = xf if len(ask) == len(x) else xf[ask]
                scores = np.rint(near @ m[at].astype(float)).astype(np.int64)
            else:
                scores = x[ask] @ m[at]
            self.scored += len(ask)
            low[at, ask] = high[at, ask] = scores
            use = open_[ask]
            ask, scores = ask[use], scores[use]
            if tops is None:
                hit = scores >= floor
                if hit.any():
                    best.add(at, scores[hit], block["ids"][ask[hit]], block["rows"][ask[hit]])
            else:
                for j, t in enumerate(own):
                    hit = (scores >= floors[j]) & (scores <= t)
                    if hit.any():
                        best.add(group["first"][at] + j, scores[hit], block["ids"][ask[hit]], block["rows"][ask[hit]])


GROUP_COLUMNS = ["grp", "rows", "anchors", "own_labels", "own", "tree", "parent", "edge"]


def search(pairs: DataFrame, width: int, k: int, share: tuple[int, int], found: bool) -> DataFrame:
    """(row, top, anchor_id, id, other, score) of each search: a task's best for the groups and blocks that meet in it.

    ``pairs`` has the columns of a group, with ``found`` also its positives (slot and score), and of a
    block. Results never depend on the order of the pairs; it only decides how often they are handed on."""
    schema = pa.schema([("row", pa.int64()), ("top", pa.int64()), ("anchor_id", pa.int64()), ("vec_id", pa.int64()), ("other", pa.int64()), ("score", pa.int64())])

    def read_group(r: dict) -> tuple[dict, list[np.ndarray] | None]:
        g = {c: np.frombuffer(r[c], dtype="<i8") for c in ("rows", "anchors", "own_labels", "tree", "parent")}
        g |= {"own": widen(r["own"], width), "edge": np.frombuffer(r["edge"], dtype="<f8") * (1 + 1e-12)}
        g["length"] = np.sqrt((g["own"].astype(float) ** 2).sum(axis=1))
        if not found:
            return g, None
        tops = [[] for _ in g["rows"]]
        for slot, score in zip(r["slots"], r["tops"]):
            tops[slot].append(score)
        tops = [np.unique(np.array(t, dtype=np.int64)) for t in tops]
        g["first"] = np.concatenate([[0], np.cumsum([len(t) for t in tops])])
        return g, tops

    def read_block(r: dict) -> dict:
        x = widen(r["matrix"], width)
        ids = np.frombuffer(r["ids"], dtype="<i8")
        xf = x.astype(float)
        return {"matrix": x, "float": xf, "ids": ids, "labels": np.frombuffer(r["labels"], dtype="<i8"), "rows": (r["block"] << ROW_BITS) + np.arange(len(ids)),
                "length": np.sqrt((xf ** 2).sum(axis=1)) * (1 + 1e-12)}

    def results(g: dict, tops, best: Best) -> pa.RecordBatch:
        if tops is None:
            slots, keys = np.arange(len(g["rows"])), np.zeros(len(g["rows"]), dtype=np.int64)
        else:
            slots, keys = np.repeat(np.arange(len(tops)), [len(t) for t in tops]), np.concatenate([*tops, np.empty(0, dtype=np.int64)])
        n = [len(s) for s in best.scores]
        join = lambda parts: np.concatenate([*parts, np.empty(0, dtype=np.int64)])
        columns = [np.repeat(g["rows"][slots], n), np.repeat(keys, n), np.repeat(g["anchors"][slots], n), join(best.ids), join(best.rows), join(best.scores)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    def walk(batches):
        searcher, groups, last, block = Searcher(width, k, share), {}, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                at = batch.column(batch.schema.get_field_index("grp"))[i].as_py()
                row = lambda names: {c: batch.column(batch.schema.get_field_index(c))[i].as_py() for c in names}
                if at not in groups:
                    if len(groups) == OPEN_GROUPS:
                        yield results(*groups.pop(next(iter(groups))))
                    g, tops = read_group(row([*GROUP_COLUMNS, *(("slots", "tops") if found else ())]))
                    groups[at] = (g, tops, Best.start(len(g["rows"]) if tops is None else int(g["first"][-1]), k))
                g, tops, best = groups[at]
                number = batch.column(batch.schema.get_field_index("block"))[i].as_py()
                if number != last:
                    last, block = number, read_block(row(["block", "ids", "labels", "matrix"]))
                searcher.walk(g, block, best, tops)
        for state in groups.values():
            yield results(*state)

    return pairs.mapInArrow(walk, "row long, top long, anchor_id long, vec_id long, other long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The first k of each search, with ``rank``."""
    order = Window.partitionBy("row", "top").orderBy(F.desc("score"), "vec_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine_hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 5, every: int = 100, share: tuple[int, int] = (80, 100),
                        shift_every: int = 7, classes: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """For each anchor (id divisible by ``every``) and each of its positives, the hardest negatives.

    Components are floor(256 x), scores whole inner products; higher scores come first, ties by the
    smaller id. Positives are an anchor's first ``positives`` other rows of its label; a positive's negatives
    are the first ``negatives`` rows of other labels with share * positive_score <= negative_score <=
    positive_score (none if the positive's score is below zero). Returns anchor_id, positive_id, rank (from 1),
    negative_id, positive_score and negative_score.

    Labels of ids divisible by ``shift_every`` first move on by one modulo ``classes``. Rows without id, label or
    vector, empty vectors and vectors with a null or non-finite component take no part; shorter
    vectors count as filled up with zeros. Rows that repeat an id are separate anchors and candidates.
    An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    none = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = whole_numbers(vectors, id_col, vector_col, label_col, shift_every, classes)
    width = rows.agg(F.max(F.size("ints"))).first()[0]
    if not width:
        return spark.createDataFrame([], none)
    blocks = materialize(pack_blocks(rows, width))
    groups = materialize(anchor_groups(blocks, width, every))

    parts = -(-max(blocks.count(), 1) // PART)
    parts = max(parts, min(blocks.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    candidates = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)))

    def meet(own: DataFrame) -> DataFrame:
        """Each group with each block, by parts: the stated anchors against all rows, in blocks."""
        every_part = own.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        return every_part.join(candidates, "part").drop("part")

    top = best_of(search(meet(groups), width, positives, share, False), positives)
    top = materialize(top.select("row", F.col("anchor_id"), F.col("vec_id").alias("positive_id"), F.col("other").alias("positive_row"), F.col("score").alias("positive_score")))

    def slots(batches):
        for batch in batches:
            at, row = [], []
            for g, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(own, dtype="<i8")
                row.append(own)
                at += [(g, i) for i in range(len(own))]
            yield pa.RecordBatch.from_arrays([pa.array([a[0] for a in at], pa.int64()), pa.array([a[1] for a in at], pa.int64()),
                                              pa.array(np.concatenate([*row, np.empty(0, dtype=np.int64)]))], names=["grp", "slot", "row"])

    places = groups.select("grp", "rows").mapInArrow(slots, "grp long, slot long, row long")
    # at most GROUP * positives numbers for each group
    tops = top.join(places, "row").groupBy("grp").agg(F.collect_list(F.struct("slot", "positive_score")).alias("_t"))
    tops = tops.select("grp", F.col("_t.slot").alias("slots"), F.col("_t.positive_score").alias("tops"))
    found = best_of(search(meet(groups.join(tops, "grp")), width, negatives, share, True), negatives)
    found = found.select("row", F.col("top").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return top.join(found, ["row", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
