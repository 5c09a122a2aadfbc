import numpy as np
import pytest

from helpers import SCHEMA, odd_documents
from priorfield.llm.mixing import mix_sources, rake, target_shares


def test_raking_equals_plain_loop(spark):
    rng = np.random.default_rng(2)
    tokens = rng.integers(1, 1000, (4, 3, 2))
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", str(c), int(tokens[a, b, c])) for a in range(4) for b in range(3) for c in range(2)], "source string, lang string, topic string, tokens long")
    targets = {"source": {"s0": 0.1, "s1": 0.2, "s2": 0.3, "s3": 0.4}, "lang": {"l0": 5, "l1": 3, "l2": 2}}
    got = rake(target_shares(cells, targets, {"topic": 0.0}).withColumn("w", cells.tokens.cast("double")))
    w = tokens.astype(float)
    for _ in range(200):
        for axis, goal in enumerate(([0.1, 0.2, 0.3, 0.4], [0.5, 0.3, 0.2], [0.5, 0.5])):
            other = tuple(i for i in range(3) if i != axis)
            shape = [1, 1, 1]
            shape[axis] = -1
            w *= (np.array(goal) / w.sum(axis=other)).reshape(shape)
    for r in got.collect():
        assert r.w == pytest.approx(w[int(r.source[1]), int(r.lang[1]), int(r.topic)], rel=1e-4)


def test_kept_tokens_follow_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{rng.integers(500)}" for _ in range(20)), str(rng.choice(["en", "de"], p=[0.8, 0.2])), str(rng.choice(["a", "b", "c"], p=[0.6, 0.3, 0.1]))) for i in range(4000)]
    got = mix_sources(spark.createDataFrame(rows, SCHEMA), {"source": {"a": 1, "b": 1, "c": 1}, "lang": {"en": 0.8, "de": 0.2}}, {"topic": 1.0}, rate=0.25).toPandas()
    kept = got[got.kept]
    assert kept.n_tokens.sum() / got.n_tokens.sum() == pytest.approx(0.25, abs=0.03)
    assert (kept.groupby("source").n_tokens.sum() / kept.n_tokens.sum()).to_numpy() == pytest.approx([1 / 3] * 3, abs=0.05)
    assert ((got.probability >= 0) & (got.probability <= 1)).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame(odd_documents(), SCHEMA).withColumnRenamed("lang", "language").selectExpr("*", "language AS lang", "1 AS topic")
    got = mix_sources(docs)
    assert got.count() == docs.count() and got.filter("probability IS NULL OR kept IS NULL").count() == 0
    assert mix_sources(docs.limit(0)).count() == 0
