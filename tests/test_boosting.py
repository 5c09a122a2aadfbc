import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorfield.operators import boosting as b

UNIT = 2.0 ** b.BITS


def plain_tree(x, g, h, n, edges, chosen, depth, l2, leaf, weight, gain):
    """A tree by loops over the rows of each node."""
    tree = b.Tree({}, {})
    value = lambda s, t: (s / UNIT) / (t / UNIT + l2)
    level = [1]
    for _ in range(depth):
        at, below = tree.nodes(x), []
        for node in level:
            m = at == node
            best = None
            for f in chosen:
                for bin_ in range(len(edges[f])):
                    left, right = m & (x[:, f] <= bin_), m & (x[:, f] > bin_)
                    sums = [[int(sum(int(v) for v in s[side])) for s in (g, h, n)] for side in (left, right)]
                    if min(s[2] for s in sums) < leaf or min(s[1] for s in sums) < weight * UNIT:
                        continue
                    found = sum((s[0] / UNIT) ** 2 / (s[1] / UNIT + l2) for s in sums)
                    if best is None or found > best[0]:
                        best = found, f, bin_, sums
            own = [int(sum(int(v) for v in s[m])) for s in (g, h)]
            if best is None or (gain is not None and best[0] - own[0] / UNIT * value(*own) <= gain):
                continue
            tree.splits[node] = best[1:3]
            tree.values.pop(node, None)
            tree.values.update({2 * node: value(*best[3][0][:2]), 2 * node + 1: value(*best[3][1][:2])})
            below += [2 * node, 2 * node + 1]
        level = below
    return tree if tree.splits else None


def plain_bins(values, edges):
    return np.array([[len(e) if v is None or math.isnan(v) else sum(v > t for t in e) for v, e in zip(row, edges)] for row in values])


def data(seed=3, rows=400):
    rng = np.random.default_rng(seed)
    x = [[float(rng.integers(5)), None if rng.random() < 0.1 else float(rng.random()), float(rng.integers(40))] for _ in range(rows)]
    y = [int(r[0] + 3 * (r[1] or 0) + rng.normal() > 3.5) for r in x]
    return x, y


@pytest.mark.parametrize("objective", ["logistic", "squared"])
@pytest.mark.parametrize("depth", [1, 3])
def test_equals_plain_loops(spark, objective, depth):
    x, y = data()
    target = y if objective == "logistic" else [v / 2 + r[2] / 80 for r, v in zip(x, y)]
    df = spark.createDataFrame([(i, *r, float(v)) for i, (r, v) in enumerate(zip(x, target))], "id long, a double, b double, c double, y double")
    params = dict(rounds=5, step=0.5, depth=depth, bins=6, l2=1.0, max_features=2, min_leaf=15, min_weight=0.5, min_gain=None if depth == 1 else 0.0, seed=5)
    model = b.fit_boosting(df.repartition(3), ["a", "b", "c"], "y", objective, **params)
    assert model == b.fit_boosting(df.repartition(1), ["a", "b", "c"], "y", objective, **params)  # however rows are dealt
    assert model.edges[0] == (0.5, 1.5, 2.5, 3.5) and [len(e) for e in model.edges[1:]] == [6, 6]
    bins, t = plain_bins(x, model.edges), np.array(target)
    start = math.log(t.mean() / (1 - t.mean())) if objective == "logistic" else t.mean()
    assert model.start == pytest.approx(start, abs=1e-9)
    s, rng, trees = np.full(len(t), model.start), np.random.default_rng(5), []
    for _ in range(5):
        chosen = sorted(rng.choice(3, 2, replace=False))
        p = 1 / (1 + np.exp(-s)) if objective == "logistic" else s
        g = np.rint((t - p) * UNIT).astype(np.int64)
        h = np.rint(p * (1 - p) * UNIT).astype(np.int64) if objective == "logistic" else np.full(len(t), int(UNIT))
        tree = plain_tree(bins, g, h, np.ones(len(t), np.int64), model.edges, chosen, depth, 1.0, 15, 0.5, params["min_gain"])
        trees.append(tree)
        s = s + 0.5 * np.array([tree.values[n] for n in tree.nodes(bins)])
    assert [m.splits for m in model.trees] == [m.splits for m in trees]
    got = model.transform(df).toPandas().sort_values("id")
    assert np.allclose(got.score, s, atol=1e-7) and np.array_equal(got.score, model.scores(bins))
    before = ((t - t.mean()) ** 2).mean()
    assert ((t - (1 / (1 + np.exp(-s)) if objective == "logistic" else s)) ** 2).mean() < 0.8 * before


def plain_pairs(events, s, y, ids, k, weighted):
    """Gradients by all pairs of each event."""
    g, h = np.zeros(len(s)), np.zeros(len(s))
    for e in set(events):
        rows = sorted([i for i in range(len(s)) if events[i] == e], key=lambda i: (-s[i], ids[i]))
        place = {i: p + 1 for p, i in enumerate(rows)}
        ideal = sum(v / math.log2(p + 2) for p, v in enumerate(sorted((y[i] for i in rows), reverse=True)[:k]))
        disc = lambda i: 1 / math.log2(place[i] + 1) if place[i] <= k else 0.0
        for i in rows:
            for j in rows:
                if y[i] > y[j] and min(place[i], place[j]) <= k:
                    rho = 1 / (1 + math.exp(s[i] - s[j]))
                    w = (y[i] - y[j]) * abs(disc(i) - disc(j)) / ideal if weighted else 1.0
                    g[i], g[j] = g[i] + rho * w, g[j] - rho * w
                    h[i], h[j] = h[i] + rho * (1 - rho) * w, h[j] + rho * (1 - rho) * w
    return g, h


@pytest.mark.parametrize("weighted", [True, False])
@pytest.mark.parametrize("limit", ["6", "1000000"])
def test_pair_gradients_equal_all_pairs(spark, weighted, limit):
    """Tied scores and gains, an event with a third of all rows, one without gain, one of a single row."""
    rng = np.random.default_rng(8)
    events = [0] * 40 + [1] * 9 + [2] + [3] * 5 + [int(v) for v in rng.integers(4, 12, 65)]
    y = [0 if e == 3 else int(rng.integers(0, 4)) for e in events]
    s = [float(rng.integers(-4, 5)) / 2 for _ in events]
    ids = [int(v) for v in rng.permutation(len(events))]
    d = spark.createDataFrame([(e, i, a, float(c), i, [0]) for e, i, a, c in zip(events, ids, s, y)], "e long, id long, score double, y double, _row long, bins array<int>").repartition(5)
    spark.conf.set("spark.priorfield.maxGroupRows", limit)
    try:
        hot = b.find_hot(d, ["e"])
    finally:
        spark.conf.unset("spark.priorfield.maxGroupRows")
    assert bool(hot) == (limit == "6")
    d = d.join(b.ideal_gain(d, "e", "y", 4), "e")
    got = b.pair_gradients(d, "e", ["id"], 4, UNIT, weighted, hot).groupBy("_row").agg(*[F.sum(c).alias(c) for c in "ghn"]).toPandas().set_index("_row").loc[ids]
    g, h = plain_pairs(events, s, y, ids, 4, weighted)
    assert np.allclose(got.g / UNIT, g, atol=1e-7) and np.allclose(got.h / UNIT, h, atol=1e-7) and (got.n == 1).all()


def test_ranker_learns_and_ignores_the_dealing(spark):
    rng = np.random.default_rng(4)
    rows = [(e, i, float(rng.integers(6)), float(rng.random())) for e in range(60) for i in range(8)]
    rows = [(*r, max(0, int(r[2] - 2 * r[3] + rng.normal() / 3))) for r in rows]
    df = spark.createDataFrame(rows, "event long, id long, a double, b double, gain int")
    params = dict(rounds=4, step=0.5, depth=2, bins=16, k=4, min_weight=0.1)
    for objective in ("ndcg", "pairwise"):
        model = b.fit_ranker(df.repartition(4), ["a", "b"], "gain", "event", ["id"], objective, **params)
        assert model == b.fit_ranker(df.coalesce(1), ["a", "b"], "gain", "event", ["id"], objective, **params)
        p = model.transform(df).toPandas()
        gained = p.sort_values(["event", "score"], ascending=[True, False]).groupby("event").head(2).gain.mean()
        assert gained > 1.4 * p.gain.mean()


def test_rounds_write_nothing_and_large_events_agree(spark, monkeypatch):
    """Events with ties, null keys and one of a third of all rows; rounds over events and over single rows give one model."""
    rng = np.random.default_rng(11)
    rows = [(int(e), None if i % 9 == 0 else i % 50, float(rng.integers(6)), float(rng.integers(30)), int(rng.integers(4)))
            for i, e in enumerate([0] * 60 + [*rng.integers(1, 25, 120)])]
    df = spark.createDataFrame(rows, "event long, id long, a double, b double, gain int").coalesce(1)
    params = dict(rounds=3, step=0.5, depth=2, bins=16, k=3, min_weight=0.01)
    written = []
    monkeypatch.setattr(b, "materialize", lambda d, plain=b.materialize: written.append(d) or plain(d))
    model = b.fit_ranker(df, ["a", "b"], "gain", "event", ["id"], "ndcg", **params)
    assert len(model.trees) == 3 and len(written) == 2  # the binned rows and the events
    monkeypatch.setattr(b, "PENDING", 2)
    spark.conf.set("spark.priorfield.maxGroupRows", "20")
    try:
        other = b.fit_ranker(df, ["a", "b"], "gain", "event", ["id"], "ndcg", **params)
    finally:
        spark.conf.unset("spark.priorfield.maxGroupRows")
    assert len(written) > 2 + 3  # rows of the large event are written in each round
    assert [t.splits for t in model.trees] == [t.splits for t in other.trees]
    assert all(np.allclose(list(t.values.values()), list(o.values.values()), atol=1e-7) for t, o in zip(model.trees, other.trees))


def test_blocks_keep_more_bins_than_a_number_holds(spark):
    """Nine features: their bins take two numbers of a row."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 100, (300, 9)).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), float(r[8] > 60)) for i, r in enumerate(x)], "id long, " + ", ".join(f"f{i} double" for i in range(9)) + ", y double")
    model = b.fit_stump_classifier(df, [f"f{i}" for i in range(9)], "y", rounds=3, bins=99)
    assert {t.splits[1][0] for t in model.trees} == {8}


def test_edge_cases(spark):
    schema = "id long, a double, bins string, score string, y int"
    rows = [(1, None, "x", "s", 1), (2, float("nan"), "x", "s", 0), (3, 1.0, "x", "s", None), (4, 1.0, None, None, 1), (4, 1.0, None, None, 1)]
    df = spark.createDataFrame(rows, schema)
    model = b.fit_boosting(df, ["a"], "y", rounds=3, min_leaf=1)
    assert model.edges == ((),) and model.trees == ()  # one value: nothing to split, the rate stays
    got = model.transform(df, "out").select("id", "bins", "out").collect()
    assert len(got) == 5 and {round(r.out, 6) for r in got} == {round(math.log(3), 6)}
    empty = b.fit_boosting(df.limit(0), ["a"], "y")
    assert empty.start == 0 and empty.transform(df.limit(0), "out").count() == 0
    one = b.fit_ranker(df.limit(0), ["a"], "y", "id", ["a"], rounds=2)
    assert one.trees == ()
    two = spark.createDataFrame([(i, float(i), i % 2) for i in range(50)] + [(99, None, 1)] * 9, "id long, a double, y int")
    m = b.fit_boosting(two, ["a"], "y", rounds=1, min_leaf=5)
    got = {r.a: r.score for r in m.transform(two).collect()}
    assert got[None] == got[49.0] > got[0.0]  # null goes with the largest values
    with pytest.raises(ValueError):
        b.fit_boosting(df, ["a"], "y", "ndcg")
