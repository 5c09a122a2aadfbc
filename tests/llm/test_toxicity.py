import random

import numpy as np
from pyspark.sql import functions as F

from helpers import SCHEMA, odd_documents, prose
from priorfield.llm import toxicity as tox


def test_gradient_step_lowers_the_loss():
    rng = np.random.default_rng(1)
    texts = [np.append(rng.integers(0, 500, 20), [tox.BUCKETS] * tox.PAD).astype(np.int32) for _ in range(64)]
    labels = np.array([int(i % 2) for i in range(64)])
    for i in np.flatnonzero(labels):
        texts[i][3] = 777
    model, memory = tox.Model.start(), {}
    for _ in range(60):
        model.step(texts, labels, np.ones(64), memory)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert ((model.logits(np.concatenate(texts), starts) > 0) == labels).all()
    assert (model.embedding[tox.BUCKETS] == 0).all()


def corpus(n=1500):
    rng = random.Random(6)
    bad = ["vileword", "nastyword", "foulword"]
    docs, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randrange(5, 80)).split()
        toxic = int(rng.random() < 0.25)
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", ",", "."]))
        docs.append((i, " ".join(words), rng.choice(["en", "de", None]), "s"))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d, known = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tox.fit_toxicity(d, known)
    got = tox.score_toxicity(d, model).join(known, "doc_id").filter(~tox.in_training(F.col("doc_id"))).toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95 and (got.rejected == got.toxic).mean() > 0.93
    swapped = tox.score_toxicity(d.withColumn("lang", F.lit("fr")).withColumn("doc_id", F.col("doc_id") + 7), model).toPandas().set_index("doc_id").score
    own = tox.score_toxicity(d, model).toPandas().set_index("doc_id").score
    assert np.allclose(swapped.sort_index().to_numpy(), own.sort_index().to_numpy())  # the text alone decides


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame(odd_documents(), SCHEMA).withColumn("score", F.lit("mine"))
    model = tox.fit_toxicity(docs, spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None), (4, 7)], "doc_id long, toxic int"))
    got = tox.score_toxicity(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score < 0.01 and not r.rejected for r in got)
    assert tox.score_toxicity(docs.limit(0), model).count() == 0


def test_thresholds_cover_all_labelled_rows(spark):
    """A language with 5 % of the rows has its own threshold, from rows outside the fitting sample."""
    docs, labels = corpus(1600)
    docs = [(i, text, "fi" if i % 20 < 3 else "en", s) for i, text, _, s in docs]
    labels = [(i, toxic) for i, toxic in labels if not (i % 20 == 0 and i % 3)]
    d, known = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tox.fit_toxicity(d, known, sample=150)
    assert set(model.by_language) == {"en", "fi"}
    got = tox.score_toxicity(d, model).join(known, "doc_id").filter(tox.in_training(F.col("doc_id"))).toPandas()
    for lang in ("en", "fi"):
        own = got[got.lang == lang]
        assert (own.rejected == own.toxic).mean() > 0.93
        odds = np.log(own.score / (1 - own.score)) + model.threshold
        assert (own.rejected == (odds >= model.by_language[lang] - 1e-6)).all()


def test_thresholds_from_counts(spark):
    rng = np.random.default_rng(3)
    rows = [(lang, int(b), int(a), int(c)) for lang, n in (("en", 60), ("de", 9), ("", 4), (None, 5), ("xx", 1))
            for b, a, c in zip(rng.choice(np.arange(-200, 200), n, replace=False), rng.integers(0, 30, n), rng.integers(0, 9, n))]
    rows += [("many", 3, 24, 0), ("many", 9, 0, 500)]
    weights, want = (1.25, 3.0), {}
    for lang in ["", *sorted({r[0] for r in rows if r[0]})]:
        own = [r for r in rows if not lang or r[0] == lang]
        n1, bins = sum(r[3] for r in own), sorted({r[1] for r in own})
        if lang and min(n1, sum(r[2] for r in own)) < tox.LEAST:
            continue
        def f1(border):
            hit, false = (sum(r[k] for r in own if r[1] >= border) for k in (3, 2))
            return 2 * weights[1] * hit / (weights[1] * (hit + n1) + weights[0] * false)
        best = max(bins, key=lambda b: (round(f1(b), 12), b))
        below = [b + 1 for b in bins if b < best]
        want[lang] = (best + (below[-1] if below else best - tox.BINS)) / 2 / tox.BINS
    assert "many" not in want and {"", "en"} <= set(want)
    got = tox.best_thresholds(spark.createDataFrame(rows, "lang string, bin long, n0 long, n1 long"), weights)
    assert got == want
