import math
import random

from priorfield.llm import topk


def plain(rows, k, every):
    own = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(own):
        if q % every == 0:
            best = sorted((-sum(s * t for s, t in zip(x, y)), i) for b, (i, y) in enumerate(own) if b != a)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def check(spark, rows, k=5, every=10):
    vectors = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert sorted(tuple(r) for r in topk.exact_top_k(vectors, k, every).collect()) == plain(rows, k, every)


def test_against_plain(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "GROUP", 7)
    monkeypatch.setattr(topk, "HEAD", 4)
    rng = random.Random(1)
    check(spark, [(i, [rng.gauss(0, 1) * (1 + i % 5) for _ in range(12)]) for i in range(300)])


def test_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(None, [1.0, 1.0]), (40, None), (50, []), (60, [1.0, None]), (70, [float("nan"), 1.0]), (80, [float("inf"), 0.0]), (90, [3.0]), (20, [0.0, 0.0])]
    check(spark, rows)
    check(spark, [(0, [1.0, 2.0]), (7, [0.5, -1.0])])
    assert topk.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert topk.exact_top_k(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).count() == 0
