import math
import random

import numpy as np
import pytest

from priorfield.llm import mining


def plain(rows, positives=5, negatives=5, every=100, share=(80, 100)):
    own = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * x) for x in v]) for i, y, v in rows
           if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (anchor, label, x) in enumerate(own):
        if anchor % every:
            continue
        scored = sorted((-sum(s * t for s, t in zip(x, v)), i, y, b) for b, (i, y, v) in enumerate(own) if b != a)
        for minus, p, _, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [(i, -m) for m, i, y, _ in scored if y != label and share[0] * -minus <= share[1] * -m <= share[1] * -minus][:negatives]
            out += [(anchor, p, n + 1, i, -minus, s) for n, (i, s) in enumerate(fit)]
    return sorted(out)


def check(spark, rows, **how):
    vectors = spark.createDataFrame([(i, y, v, 0, "x") for i, y, v in rows], "vec_id long, label int, embedding array<float>, score int, row string").repartition(3)
    rows = [(r.vec_id, r.label, r.embedding) for r in vectors.collect()]
    got = sorted(tuple(r) for r in mining.mine_hard_negatives(vectors, **how).collect())
    assert got == plain(rows, **how)
    return got


def clustered(rng, n, width=8, clusters=5, spread=0.1):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(clusters)]
    return [(i, rng.randrange(4), [c + rng.gauss(0, spread) for c in centres[rng.randrange(clusters)]]) for i in range(n)]


def test_against_plain(spark, monkeypatch):
    for name, size in (("BLOCK", 16), ("GROUP", 5), ("PART", 2), ("OPEN_GROUPS", 2)):
        monkeypatch.setattr(mining, name, size)
    rng = random.Random(1)
    assert check(spark, clustered(rng, 260), every=10)
    assert check(spark, clustered(rng, 200, spread=1.0), every=9, positives=3, negatives=2, share=(1, 2))


def test_ties_repeats_and_odd_vectors(spark):
    same = [(i, i % 2, [1.0, 0.5]) for i in range(40)]
    odd = [(None, 1, [1.0, 1.0]), (50, 1, None), (60, 1, []), (70, None, [1.0, 0.0]), (80, 1, [1.0, None]), (90, 1, [float("nan"), 1.0]),
           (100, 0, [float("inf"), 0.0]), (110, 0, [2.0]), (20, 1, [0.0, 0.0]), (20, 1, [1.0, 0.5]), (20, 1, [1.0, 0.5]), (120, 5, [-1.0, -1.0])]
    check(spark, same + odd, every=10)
    check(spark, same, every=10)
    check(spark, [(0, 1, [1.0]), (1, 2, [1.0]), (7, 1, [1.0])])
    assert mining.mine_hard_negatives(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0
    assert mining.mine_hard_negatives(spark.createDataFrame([(1, 1, [1.0])], "vec_id long, label int, embedding array<float>")).count() == 0


def test_scores_beyond_doubles(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), [float(np.float32(rng.uniform(1, 2) * 2 ** 20)) for _ in range(6)]) for i in range(60)]
    got = check(spark, rows, every=10)
    assert max(r[4] for r in got) > 2 ** 56
    with pytest.raises(Exception, match="do not fit"):
        check(spark, [(0, 1, [1e18, 1.0]), (1, 1, [1e18, 2.0])])


def test_tree_is_least():
    rng = np.random.default_rng(3)
    for n in (1, 2, 17):
        m = rng.integers(-50, 50, (n, 4))
        order, parent, edge = mining.spanning_tree(m)
        d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(axis=2))
        assert sorted(order) == list(range(n)) and (parent < 0).sum() == 1
        place = np.argsort(order)
        assert all(p < 0 or (place[p] < place[i] and abs(edge[i] - d[p, i]) < 1e-9) for i, p in enumerate(parent))
        links = sorted((d[i, j], i, j) for i in range(n) for j in range(i))  # Kruskal
        root, total = list(range(n)), 0.0

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for w, i, j in links:
            if find(i) != find(j):
                root[find(i)] = find(j)
                total += w
        assert abs(total - edge.sum()) < 1e-6


def test_bounds_spare_most_scores():
    """Anchors near each other and candidates far from their windows are not scored."""
    rng = np.random.default_rng(5)
    width, n = 8, 2000
    anchors = (1000 + rng.normal(0, 5, (40, width))).astype(np.int64)
    x = rng.normal(0, 300, (n, width)).astype(np.int64)
    x[:20] = anchors[:20] + 3
    order, parent, edge = mining.spanning_tree(anchors)
    zero = np.zeros(40, dtype=np.int64)
    group = {"own": anchors, "rows": zero - 1, "own_labels": zero, "tree": order, "parent": parent, "edge": edge,
             "length": np.sqrt((anchors.astype(float) ** 2).sum(axis=1)), "first": np.arange(41)}
    block = {"matrix": x, "float": x.astype(float), "ids": np.arange(n), "rows": np.arange(n), "labels": np.ones(n, dtype=np.int64),
             "length": np.sqrt((x.astype(float) ** 2).sum(axis=1))}
    searcher, best = mining.Searcher(width, 5, (80, 100)), mining.Best.start(40, 5)
    tops = [np.array([int((a * a).sum())]) for a in anchors]
    searcher.walk(group, block, best, tops)
    assert searcher.looked == 40 * n and searcher.scored < 3 * n
    for i, a in enumerate(anchors):
        s = x @ a
        fit = np.flatnonzero((s <= tops[i][0]) & (80 * tops[i][0] <= 100 * s))
        assert best.ids[i].tolist() == fit[np.lexsort((fit, -s[fit]))][:5].tolist()
