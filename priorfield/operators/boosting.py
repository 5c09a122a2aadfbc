"""Boosted trees on histograms of gradient sums, with row-wise and list-wise objectives.

Features are cut into bins once, and rows are put together once, in blocks or by event. Each level of a
tree is one job over these rows: tasks take the gradients at the present scores and add them up per
(node, feature, bin), so nothing is written in a round, and what is shuffled and what reaches the driver
has the size of the histogram and does not grow with the data. Gradients are whole multiples of a power of two
and are added as integers, so a model does not depend on how rows are dealt or in which order they come.

The list-wise objective forms no pair rows. Positions of NDCG beyond ``k`` do not count, so every
pair that counts has a member among the k rows of an event with the highest scores. Events lie whole in
one task, where all rows meet the first row, then the second, up to the k-th. In events too large for that
each row meets the k rows as one array; what the k rows gain from all others is summed per event and position.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .hot import MAX_ROWS_DEFAULT, MAX_ROWS_KEY, HotGroups, find_hot, split_hot
from .joins import lookup
from .windows import top_k

#: Gradients are multiples of 2 ** -BITS (times a power of two for large targets).
BITS = 32
#: Trees that are still part of the plan; after so many rounds the scores are written anew.
PENDING = 16
#: Rows added up at once in a task: sums of the two halves of a gradient are exact in doubles.
SLICE, LOW = 1 << 14, 24
#: A block has 2 ** BLOCK rows. Events with more rows than EVENT_ROWS (and than ``find_hot`` allows) are not put in one array.
BLOCK, EVENT_ROWS = 6, 1000


@dataclass(frozen=True)
class Tree:
    """Nodes are numbered from 1, the children of n are 2n and 2n + 1. A row goes to the first child if its
    bin is at most the split's bin, that is if its value is at most the edge of that bin."""

    splits: dict[int, tuple[int, int]]
    values: dict[int, float]

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The node of each row of bins."""
        at = np.ones(len(x), dtype=np.int64)
        for n, (f, b) in sorted(self.splits.items()):
            if n == 1:
                at = 2 + (x[:, f] > b).astype(np.int64)
            else:
                here = np.flatnonzero(at == n)
                at[here] = 2 * n + (x[here, f] > b)
        return at

    def add_to(self, scores: np.ndarray, x: np.ndarray, step: float) -> np.ndarray:
        values = np.zeros(max(self.values) + 1)
        values[list(self.values)] = list(self.values.values())
        return scores + step * values[self.nodes(x)]

    def expr(self, bins: Column, n: int = 1) -> Column:
        if n not in self.splits:
            return F.lit(self.values[n])
        f, b = self.splits[n]
        return F.when(F.get(bins, F.lit(f)) <= b, self.expr(bins, 2 * n)).otherwise(self.expr(bins, 2 * n + 1))


@dataclass(frozen=True)
class BoostedModel:
    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    start: float
    step: float
    trees: tuple[Tree, ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of bins, trees added in order."""
        s = np.full(len(x), self.start)
        for t in self.trees:
            s = t.add_to(s, x, self.step)
        return s

    def transform(self, df: DataFrame, out: str = "score") -> DataFrame:
        """``df`` with the score of each row; its other columns do not leave the JVM's batches."""
        @F.pandas_udf("double")
        def score(bins: pd.Series) -> pd.Series:
            return pd.Series(self.scores(np.array(bins.tolist(), dtype=np.int64).reshape(len(bins), -1)))

        return df.withColumn(out, score(binned(self.features, self.edges).cast("array<int>")))

    def probability(self, df: DataFrame, out: str = "p") -> DataFrame:
        return self.transform(df, out).withColumn(out, 1 / (1 + F.exp(-F.col(out))))


def bin_edges(df: DataFrame, features, bins: int) -> tuple[tuple[float, ...], ...]:
    """Edges of each feature: the middles between its values where it has at most ``bins`` + 1, else
    quantiles of a sketch over all rows. At most ``bins`` numbers a feature reach the driver."""
    if not 1 <= bins < 127:
        raise ValueError("bins must be between 1 and 126")
    d = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"_{i}") for i, c in enumerate(features)])
    share = [(i + 1) / (bins + 1) for i in range(bins)]
    r = d.agg(*[F.approx_count_distinct(c).alias(f"n{c}") for c in d.columns],
              *[F.percentile_approx(c, share, 10_000).alias(f"q{c}") for c in d.columns]).first()
    few = [c for c in d.columns if r[f"n{c}"] <= 2 * (bins + 1)]  # so their sets are small
    sets = d.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in few]).first() if few else {}
    edges = []
    for c in d.columns:
        values = sets[c] if c in few else None
        if values is not None and len(values) <= bins + 1:
            edges.append(tuple((a + b) / 2 for a, b in zip(values, values[1:])))
        else:
            edges.append(tuple(sorted(set(r[f"q{c}"] or []))))
    return tuple(edges)


def binned(features, edges) -> Column:
    """The bins of a row: how many edges lie below each value. Null and NaN take the last bin."""
    def one(c: str, e) -> Column:
        x = F.col(c).cast("double")
        below = F.size(F.filter(F.lit(list(e)), lambda v: v < x)) if e else F.lit(0)
        return F.when(x.isNull(), F.lit(len(e))).otherwise(below).cast("tinyint")

    return F.array(*[one(c, e) for c, e in zip(features, edges)])


def whole(x: Column, unit: float) -> Column:
    return F.round(x * F.lit(unit)).cast("long")


def logistic_gradients(d: DataFrame, unit: float) -> DataFrame:
    p = 1 / (1 + F.exp(-F.col("score")))
    return d.select("bins", whole(F.col("y") - p, unit).alias("g"), whole(p * (1 - p), unit).alias("h"), F.lit(1).cast("long").alias("n"))


def ideal_gain(d: DataFrame, event: str, gain: str, k: int, out: str = "_ideal") -> DataFrame:
    """(event, out): the highest discounted gain of the first k places of each event."""
    best = top_k(d.select(event, gain, (-F.col(gain)).alias("_down")), event, ["_down"], k)
    return best.groupBy(event).agg(F.sum(F.col(gain) / F.log2(F.col("place") + 1.0)).alias(out))


def pair_gradients(d: DataFrame, event: str, order, k: int, unit: float, weighted: bool = True, hot: HotGroups | None = None) -> DataFrame:
    """Gradient sums over pairs of rows of one event with different gains ``y``, at least one of them among the
    event's k highest ``score`` (ties by ``order``, then ``_row``).

    A pair pushes its better row up and the other down by 1 / (1 + exp(score difference)), weighted
    with what swapping both would change of NDCG@k (``weighted``; events without gain push nothing) or equally.
    Every row is returned once with n = 1; the rows in the first k places once more with n = 0 for
    the pairs with rows beyond. Only k rows and k sums of each event are shuffled besides the rows.
    """
    best = top_k(d.withColumn("_down", -F.col("score")), event, ["_down", *order, "_row"], k)
    arrays = best.groupBy(event).agg(F.sort_array(F.collect_list(F.struct("place", "_row", "score", "y"))).alias("_best"))
    rows = lookup(d, arrays, event, hot).withColumn("_own", F.get(F.filter("_best", lambda b: b["_row"] == F.col("_row")), F.lit(0))["place"])

    def discount(place):
        return F.when(place.isNull(), 0.0).otherwise(1 / F.log2(place + 1.0))

    def term(b: Column) -> Column:
        sign = F.when(F.col("y") > b["y"], 1.0).otherwise(-1.0)
        rho = 1 / (1 + F.exp(sign * (F.col("score") - b["score"])))
        weight = F.lit(1.0)
        if weighted:
            weight = F.when(F.col("_ideal") > 0, F.abs(F.col("y") - b["y"]) * F.abs(discount(F.col("_own")) - discount(b["place"])) / F.col("_ideal")).otherwise(0.0)
        counts = F.col("y") != b["y"]
        return F.struct(F.when(counts, whole(sign * rho * weight, unit)).otherwise(F.lit(0).cast("long")).alias("g"),
                        F.when(counts, whole(rho * (1 - rho) * weight, unit)).otherwise(F.lit(0).cast("long")).alias("h"))

    rows = rows.withColumn("_terms", F.transform("_best", term))
    zero = F.lit(0).cast("long")
    own = rows.select(event, "_row", "bins", F.aggregate("_terms", zero, lambda a, t: a + t["g"]).alias("g"),
                      F.aggregate("_terms", zero, lambda a, t: a + t["h"]).alias("h"), F.lit(1).cast("long").alias("n"))
    beyond = rows.filter(F.col("_own").isNull()).groupBy(event).agg(*[F.sum(F.get("_terms", F.lit(i))[c]).alias(f"_{c}{i}") for i in range(k) for c in ("g", "h")])
    pick = {c: F.get(F.array(*[F.col(f"_{c}{i}") for i in range(k)]), F.col("place") - 1) for c in ("g", "h")}
    more = best.join(beyond, event).select(event, "_row", "bins", (-pick["g"]).alias("g"), pick["h"].alias("h"), F.lit(0).cast("long").alias("n"))
    return own.unionByName(more)


def put_together(d: DataFrame, features: int, by: Column, sort: bool = False) -> DataFrame:
    """One row per group ``by``: arrays of y, keys and bins; eight bins are the bytes of one number."""
    bins = [reduce(Column.bitwiseOR, [F.shiftleft(F.coalesce(F.get("bins", F.lit(i + j)), F.lit(0)).cast("long"), 8 * j) for j in range(8)])
            for i in range(0, features, 8)]
    rows = F.collect_list(F.struct(*(["_key", "_row"] if sort else ["_key"]), "y", F.array(*bins).alias("bins")))
    ideal = [F.first("_ideal").alias("_ideal")] if "_ideal" in d.columns else []
    g = d.groupBy(by.alias("_group")).agg((F.sort_array(rows) if sort else rows).alias("_rows"), *ideal)
    return g.select("_rows.y", F.flatten("_rows.bins").alias("bins"), F.col("_rows._key").alias("_keys"), *([F.col("_ideal")] if ideal else []))


def whole_array(x: np.ndarray, unit: float) -> np.ndarray:
    """``whole`` for arrays: halves are rounded away from zero."""
    v = x * unit
    if len(v) and not np.abs(v).max() < 2.0 ** 63:
        raise ValueError("a gradient is not finite or too large")
    return np.copysign(np.floor(np.abs(v) + 0.5), v).astype(np.int64)


def event_gradients(y: np.ndarray, score: np.ndarray, sizes: np.ndarray, ideal: np.ndarray | None, k: int, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """What ``pair_gradients`` sums per row, for events that lie one after the other; ties go to the row that comes first.
    Pairs are equally weighted without ``ideal``."""
    event = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((-score, event))
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(y)) - first[event]
    y, score = y[order], score[order]
    discount = np.where(place < k, 1 / np.log2(place + 2.0), 0.0)
    g, h = np.zeros(len(y), np.int64), np.zeros(len(y), np.int64)
    low = np.arange(len(y))
    for i in range(k):
        low = low[place[low] > i]  # the rows behind the event's i-th
        if not len(low):
            break
        top = first[event[low]] + i
        differ = y[low] != y[top]
        a, b = low[differ], top[differ]
        sign = np.where(y[a] > y[b], 1.0, -1.0)
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            rho = 1 / (1 + np.exp(sign * (score[a] - score[b])))
            weight = 1.0
            if ideal is not None:
                best = ideal[event[a]]
                weight = np.where(best > 0, np.abs(y[a] - y[b]) * np.abs(discount[a] - discount[b]) / best, 0.0)
        push, bend = whole_array(sign * rho * weight, unit), whole_array(rho * (1 - rho) * weight, unit)
        g[a] += push
        h[a] += bend
        np.subtract.at(g, b, push)
        np.add.at(h, b, bend)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return g[back], h[back]


@dataclass(frozen=True)
class Gradients:
    """Takes the gradients of rows that ``put_together`` made, at their scores after the ``pending`` trees."""

    objective: str
    unit: float
    start: float
    step: float
    k: int
    pending: tuple[Tree, ...]

    def scored(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Bins and scores of a batch."""
        packed = batch.column("bins").flatten().to_numpy(zero_copy_only=False).astype("<i8", copy=False)
        x = packed.view(np.int8).reshape(len(batch.column("y").flatten()), -1)
        scores = batch.column("score").flatten().to_numpy(zero_copy_only=False) if "score" in batch.schema.names else np.full(len(x), self.start)
        for t in self.pending:
            scores = t.add_to(scores, x, self.step)
        return x, scores

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bins, g and h of a batch; with a column ``_seen`` only of the rows drawn."""
        x, score = self.scored(batch)
        y = batch.column("y").flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(batch.column("y").offsets.to_numpy())
        if "_seen" in batch.schema.names:
            seen = batch.column("_seen").flatten().to_numpy(zero_copy_only=False)
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[seen], minlength=len(sizes))
            x, score, y = x[seen], score[seen], y[seen]
        if self.objective in ("ndcg", "pairwise"):
            ideal = batch.column("_ideal").to_numpy(zero_copy_only=False) if self.objective == "ndcg" else None
            return x, *event_gradients(y, score, sizes, ideal, self.k, self.unit)
        if self.objective == "squared":
            return x, whole_array(y - score, self.unit), np.full(len(y), int(self.unit))
        with np.errstate(over="ignore"):
            p = 1 / (1 + np.exp(-score))
        return x, whole_array(y - p, self.unit), whole_array(p * (1 - p), self.unit)


def keep_scores(blocks: DataFrame, gradients: Gradients) -> DataFrame:
    """The same rows with the scores that all trees so far give; written anew."""
    columns = [c for c in blocks.columns if c != "score"]

    def score(batches):
        for batch in batches:
            scores = pa.ListArray.from_arrays(batch.column("y").offsets, pa.array(gradients.scored(batch)[1]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], scores], names=[*columns, "score"])

    out = blocks.select(*columns).withColumn("score", F.col("y")).schema
    return materialize(blocks.mapInArrow(score, out))


def histogram(rows: DataFrame, tree: Tree, open_nodes, chosen, width: int, gradients: Gradients | None = None) -> dict[tuple[int, int], np.ndarray]:
    """(node, feature) -> per bin the integer sums of g, h and n, over the rows that lie in the open nodes.

    ``rows`` have bins, g, h and n; with ``gradients`` they are rows put together."""
    place = {n: i for i, n in enumerate(open_nodes)}
    index = np.full(2 * max(open_nodes) + 2, -1)
    index[list(place)] = list(place.values())
    nodes, features = len(open_nodes), np.array(chosen)

    def parts_of(batch):
        """Bins, g, h and n of slices of a batch."""
        if gradients is not None:
            x, g, h = gradients.of(batch)
            for at in range(0, len(x), SLICE):
                yield x[at:at + SLICE], g[at:at + SLICE], h[at:at + SLICE], None
            return
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), *(part.column(i).to_numpy() for i in (1, 2, 3))

    def count(batches):
        total = np.zeros((5, len(features), nodes * width), dtype=np.int64)
        for batch in batches:
            for x, g, h, n in parts_of(batch):
                here = index[tree.nodes(x)]
                if here.min(initial=0) < 0:
                    inside = np.flatnonzero(here >= 0)
                    x, g, h, here = x[inside], g[inside], h[inside], here[inside]
                    n = n if n is None else n[inside]
                parts = {}  # sums of doubles are exact below 2 ** 53; of larger gradients the halves are added
                for i, v in ((0, g), (2, h)):
                    if len(v) and np.abs(v).max() >= 1 << 38:
                        parts |= {i: v >> LOW, i + 1: v & ((1 << LOW) - 1)}
                    else:
                        parts[i + 1] = v
                parts = {i: v.astype(np.float64) for i, v in parts.items()}
                for j, f in enumerate(features):
                    key = here * width + x[:, f]
                    for i, v in parts.items():
                        total[i, j] += np.bincount(key, v, nodes * width).astype(np.int64)
                    total[4, j] += np.bincount(key, n, nodes * width).astype(np.int64)
        some = np.argwhere(np.any(total != 0, axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some[:, 0].astype(np.int32)), pa.array(some[:, 1].astype(np.int32)), *[pa.array(p[some[:, 0], some[:, 1]]) for p in total]],
                                         names=["feature", "cell", "a", "b", "c", "d", "n"])

    sums = {c: F.sum(F.col(c).cast("decimal(38,0)")) for c in "abcdn"}
    taken = rows.select("bins", "g", "h", "n") if gradients is None else rows.drop("_keys")
    found = taken.mapInArrow(count, "feature int, cell int, a long, b long, c long, d long, n long").groupBy("feature", "cell").agg(
        *[s.alias(c) for c, s in sums.items()]).collect()  # nodes x features x bins
    out = {(n, f): np.zeros((3, width), dtype=object) for n in open_nodes for f in chosen}
    for r in found:
        cell = out[open_nodes[r["cell"] // width], chosen[r["feature"]]]
        cell[:, r["cell"] % width] = int(r["a"]) * (1 << LOW) + int(r["b"]), int(r["c"]) * (1 << LOW) + int(r["d"]), int(r["n"])
    return out


def best_split(cells: dict[int, np.ndarray], edges, unit: float, l2: float, min_leaf: int, min_weight: float):
    """(gain, feature, bin, (g, h) left, (g, h) right) of the split with the largest gain; ties go to the first feature and bin."""
    def score(g, h):
        return (g / unit) ** 2 / (h / unit + l2) if h / unit + l2 > 0 else 0.0

    best = None
    for f in sorted(cells):
        g, h, n = cells[f]
        left, every = [0, 0, 0], (g.sum(), h.sum(), n.sum())
        for b in range(len(edges[f])):
            left = [left[0] + g[b], left[1] + h[b], left[2] + n[b]]
            right = [a - b_ for a, b_ in zip(every, left)]
            if min(left[2], right[2]) < max(min_leaf, 1) or min(left[1], right[1]) < min_weight * unit:
                continue
            gain = score(*left[:2]) + score(*right[:2])
            if best is None or gain > best[0]:
                best = gain, f, b, tuple(left[:2]), tuple(right[:2])
    return best


def grow(sources, edges, chosen, depth: int, unit: float, l2: float, min_leaf: int, min_weight: float, min_gain: float | None) -> Tree | None:
    """One tree, level by level; None if the first node cannot be split. ``sources`` are pairs of rows and their gradients, as
    ``histogram`` takes them; their sums are added."""
    width = max(len(e) for e in edges) + 1
    tree, open_nodes = Tree({}, {}), [1]
    value = lambda g, h: (g / unit) / (h / unit + l2) if h / unit + l2 > 0 else 0.0
    for _ in range(depth):
        each = [histogram(rows, tree, open_nodes, chosen, width, gradients) for rows, gradients in sources]
        cells = {c: sum(e[c] for e in each) for c in each[0]}
        children = []
        for n in open_nodes:
            own = {f: cells[n, f] for f in chosen}
            found = best_split(own, edges, unit, l2, min_leaf, min_weight)
            g, h = (own[chosen[0]][i].sum() for i in (0, 1))
            if found is None or (min_gain is not None and found[0] - (g / unit) * value(g, h) <= min_gain):
                continue
            _, f, b, left, right = found
            tree.splits[n] = (f, b)
            tree.values.pop(n, None)
            tree.values.update({2 * n: value(*left), 2 * n + 1: value(*right)})
            children += [2 * n, 2 * n + 1]
        open_nodes = children
        if not open_nodes:
            break
    return tree if tree.splits else None


def fit_boosting(df: DataFrame, features, y: str, objective: str = "logistic", rounds: int = 60, step: float = 0.08, depth: int = 1, bins: int = 12,
                 l2: float = 1.0, max_features: int | float = 48, min_leaf: int = 20, min_weight: float = 0.0, min_gain: float | None = None, subsample: float = 1.0,
                 seed: int = 42, key=(), event: str | None = None, k: int = 32, hot: HotGroups | None = None) -> BoostedModel:
    """Boosted trees of ``depth`` (1: stumps) for an objective: ``logistic`` (y 0 or 1), ``squared``, or for rows of one
    ``event`` ``ndcg`` (y is a gain, not negative) or ``pairwise`` over pairs with one of the k highest scores.

    Each tree sees ``max_features`` features (a share if a float) and the share ``subsample`` of rows, drawn by a
    hash of ``key``. A split leaves ``min_leaf`` rows and the curvature ``min_weight`` on both sides; with ``min_gain`` None
    the best one is taken always, else only if it gains more. Higher scores come first in rankings.

    Rows with a null or NaN target (for pairs: or a null event) take no part; null and NaN features go with the
    largest values; a column with one value is never split. Without rows, or where nothing can
    be split, the model is a constant. Copies lie in the shared folder (see ``session.own_folder``).
    """
    listwise = objective in ("ndcg", "pairwise")
    if objective not in ("logistic", "squared") and not listwise:
        raise ValueError(objective)
    if listwise and event is None:
        raise ValueError("pairs need an event")
    features, key = tuple(features), list(key)
    d = df.filter(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")) & (F.col(event).isNotNull() if listwise else F.lit(True)))
    edges = bin_edges(d, features, bins)
    keep = [F.col(event).alias("_event")] if listwise else []
    d = materialize(d.select(*keep, F.struct(*key).alias("_key") if key else F.lit(0).alias("_key"), F.col(y).cast("double").alias("y"),
                             binned(features, edges).alias("bins"), F.monotonically_increasing_id().alias("_row")))
    r = d.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("y")).alias("top")).first()
    unit, start = 2.0 ** BITS, 0.0
    if not r["n"]:
        return BoostedModel(features, edges, start, step, ())
    if objective == "squared" and r["top"] > 1:
        unit = max(1.0, 2.0 ** (BITS - math.ceil(math.log2(r["top"]))))
    if not listwise:
        mean = int(d.agg(F.sum(whole(F.col("y"), unit).cast("decimal(38,0)"))).first()[0]) / r["n"] / unit
        rate = min(max(mean, 1e-5), 1 - 1e-5)  # fixed values
        start = math.log(rate / (1 - rate)) if objective == "logistic" else mean
    else:
        if not hot:  # events in one array are smaller than groups in one task
            hot = find_hot(d, ["_event"], min(EVENT_ROWS, int(d.sparkSession.conf.get(MAX_ROWS_KEY, str(MAX_ROWS_DEFAULT)))))
        hot = hot.renamed("_event")
        if objective == "ndcg":
            d = lookup(d, ideal_gain(d, "_event", "y", k), "_event", hot)
    base = None  # the rows of large events, row by row
    if listwise:
        cold, base = split_hot(d, hot)
        blocks = materialize(put_together(cold, len(features), F.col("_event"), True))
        base = base if base is None else base.withColumn("score", F.lit(start))
    else:
        blocks = materialize(put_together(d, len(features), F.shiftright("_row", BLOCK)))
    pending, trees = [], []
    rng = np.random.default_rng(seed)
    size = min(len(features), max(1, round(max_features * len(features)) if isinstance(max_features, float) else max_features))

    def drawn(key_, i) -> Column:
        return F.pmod(F.xxhash64(key_, F.lit(seed), F.lit(i)), F.lit(1 << 20)) < int(subsample * (1 << 20))

    for i in range(rounds):
        chosen = sorted(int(f) for f in rng.choice(len(features), size, replace=False))
        gradients = Gradients(objective, unit, start, step, k, tuple(pending))
        if base is not None:
            now = base.withColumn("score", reduce(lambda s, t: s + F.lit(step) * t.expr(F.col("bins")), pending, F.col("score")))
        if len(pending) >= PENDING:
            blocks, pending = keep_scores(blocks, gradients), []
            gradients = Gradients(objective, unit, start, step, k, ())
            if base is not None:
                now = base = materialize(now)
        sources = [(blocks if subsample >= 1 else blocks.withColumn("_seen", F.transform("_keys", lambda c: drawn(c, i))), gradients)]
        if base is not None:
            rows = pair_gradients(now if subsample >= 1 else now.filter(drawn("_key", i)), "_event", ["_key"], k, unit, objective == "ndcg", hot)
            if depth > 1:
                rows = materialize(rows.select("bins", "g", "h", "n"))  # every level reads them
            sources.append((rows, None))
        tree = grow(sources, edges, chosen, depth, unit, l2, min_leaf, min_weight, min_gain)
        if tree is None:
            break
        trees.append(tree)
        pending.append(tree)
    return BoostedModel(features, edges, start, step, tuple(trees))


def fit_stump_classifier(df: DataFrame, features, y: str, **params) -> BoostedModel:
    """Boosted stumps for a 0/1 target: 60 rounds, step 0.08, 12 bins, 48 features a round, 20 rows a leaf."""
    return fit_boosting(df, features, y, "logistic", **{"rounds": 60, "l2": 1.0, **params})


def fit_stump_regressor(df: DataFrame, features, y: str, **params) -> BoostedModel:
    """Boosted stumps on squared error, as a ranker of a normalised order: 80 rounds, leaves are means."""
    return fit_boosting(df, features, y, "squared", **{"rounds": 80, "l2": 0.0, **params})


def fit_ranker(df: DataFrame, features, gain: str, event: str, key, objective: str = "ndcg", **params) -> BoostedModel:
    """Boosted trees of depth 3 on the pairs of each event."""
    usual = {"rounds": 300, "step": 0.04, "depth": 3, "bins": 64, "l2": 3.0, "max_features": 0.8, "min_leaf": 1, "min_weight": 3.0, "min_gain": 0.0, "subsample": 0.85}
    return fit_boosting(df, features, gain, objective, **{**usual, **params}, key=key, event=event)
