import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SCHEMA, odd_documents, prose
from priorfield.llm import quality as q


def test_slopes_are_the_gradient_of_the_risk():
    rng = np.random.default_rng(1)
    x_p, x_u = rng.normal(0.3, 1, (7, 5)), rng.normal(-0.3, 1, (9, 5))
    for slopes, prior in ((q.separation_slopes, 0.5), (q.risk_slopes, 0.2), (q.risk_slopes, 0.97)):
        net = q.Network.start(np.concatenate([x_p, x_u]), 3)
        x = np.concatenate([x_p, x_u])

        def risk():
            z = net.logits(x)
            total = slopes(z[:7], z[7:], prior)[0]
            if slopes is q.risk_slopes and q.softplus(z[7:]).mean() - prior * q.softplus(z[:7]).mean() < 0:
                return q.softplus(z[7:]).mean() * -1 + prior * q.softplus(z[:7]).mean()  # what a step lowers then
            return total

        z = net.logits(x)
        grad = net.gradients(x, np.concatenate(slopes(z[:7], z[7:], prior)[1:]))
        for k in ("w1", "b1", "w2", "b2"):
            value = getattr(net, k)
            for i in np.ndindex(value.shape):
                old = value[i]
                value[i] = old + 1e-6
                up = risk()
                value[i] = old - 1e-6
                down = risk()
                value[i] = old
                assert abs((up - down) / 2e-6 - grad[k][i]) < 1e-5


def test_negative_risk_never_counts():
    z_p, z_u = np.full(4, 3.0), np.full(4, -9.0)
    risk, g_p, g_u = q.risk_slopes(z_p, z_u, 0.9)
    assert q.softplus(z_u).mean() < 0.9 * q.softplus(z_p).mean() and risk == pytest.approx(0.9 * q.softplus(-z_p).mean())
    assert (g_p < 0).all() == False and (g_u < 0).all()  # noqa: E712


def test_prior_from_counts():
    rng = np.random.default_rng(2)
    for share in (0.1, 0.5, 0.85):
        good, n = rng.normal(2, 1, 20_000), int(40_000 * share)
        mixed = np.concatenate([rng.normal(2, 1, n), rng.normal(-2, 1, 40_000 - n)])
        bins = np.arange(-400, 401)
        count = lambda x: np.histogram(x * 64, np.append(bins, 401))[0]
        assert abs(q.estimate_prior(bins, count(good), count(mixed)) - share) < 0.03
    assert q.estimate_prior(np.array([]), np.array([]), np.array([])) == 0.5


def test_probability_line_is_the_minimum():
    rng = np.random.default_rng(4)
    z = np.linspace(-6, 6, 200)
    good, bad = np.exp(-(z - 1.5) ** 2), np.exp(-(z + 2) ** 2)
    p, u = np.round(5000 * good), np.round(5000 * (0.7 * good + 0.3 * bad))
    a, b = q.probability_line(z, p, u, 0.7)
    risk = lambda a, b: (u / u.sum() * q.softplus(a * z + b)).sum() - 0.7 * (p / p.sum() * (a * z + b)).sum()
    assert all(risk(a, b) <= risk(a + da, b + db) + 2e-5 for da, db in rng.normal(0, 0.05, (200, 2)))
    truth = 0.7 * good / (0.7 * good + 0.3 * bad)
    assert np.abs(q.sigmoid(a * z + b) - truth)[60:140].max() < 0.02


def plain_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lower = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in words]
    n, raw = len(words), text.encode()
    lines = [tuple(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in re.sub("[A-Z]", lambda m: m.group().lower(), text).split("\n")]
    lines = [x for x in lines if x]
    kind = lambda f: sum(map(f, raw)) / max(1, len(raw))
    white = lambda c: c in (32, 9, 10, 11, 12, 13)
    low, up, num = (lambda c: 97 <= c <= 122 or c > 127), (lambda c: 65 <= c <= 90), (lambda c: 48 <= c <= 57)
    blocks = sum(len(set(lower[i:i + 64])) for i in range(0, n, 64))
    return [np.log1p(n) / 5, np.log1p(len(lines)) / 5, sum(a == b for a, b in zip(lower, lower[1:])) / max(n, 1), (n - blocks) / max(n, 1), (n - len(set(lower))) / max(n, 1),
            (len(lines) - len(set(lines))) / max(len(lines), 1), kind(low), kind(up), kind(num), kind(white), kind(lambda c: c == 10), kind(lambda c: c > 127),
            kind(lambda c: not (low(c) or up(c) or num(c) or white(c))), sum(not white(c) for c in raw) / max(n, 1) / 10, n == 0, n < 5]


def plain_shape(word):
    out = ""
    for c in word.encode():
        k = "a" if 97 <= c <= 122 or c > 127 else "b" if 65 <= c <= 90 else "0" if 48 <= c <= 57 else chr(c)
        if out[-1:] != k or (k not in "ab0" and out[-2:] != k + k):
            out += k
    return out


def test_features_against_plain():
    rng = random.Random(2)
    texts = ["", " \n ", "One two two\n\nONE two Two\nx!!! %%%% a1b22 éÉ 中文 ...", "a" * 300]
    texts += ["".join(rng.choice("ab cD1 %!\n\té") for _ in range(rng.randrange(400))) for _ in range(60)] + [prose(rng, 700) + "\n" + prose(rng, 3)]
    seen = {}
    got = np.concatenate([x for _, x in q.features([t.encode() for t in texts])])
    assert got.shape == (len(texts), q.SHAPES + q.DENSE)
    for i, t in enumerate(texts):
        want = plain_features(t)
        off = np.abs(got[i, q.SHAPES:] - want)
        assert off.max() < 1e-5, (t, off)
    alone = ["Word", "THE!!", "of%%%", "|", "x9!!!!!", "of%%%%%%", "ABC!!"]
    for t in alone:
        row = next(q.features([t.encode()]))[1][0, :q.SHAPES]
        assert row.sum() == 1
        assert seen.setdefault(plain_shape(t), row.argmax()) == row.argmax()
    assert len(set(seen.values())) == len(seen) == 5


def corpus(n=1500, share=0.8, seed=6):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words, good = prose(rng, rng.randrange(5, 120)).split(), int(rng.random() < share)
        if not good:
            kind = i % 3
            words = [w + "%%%" for w in words] if kind == 0 else [w for w in words for _ in range(4)] if kind == 1 else [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), rng.choice(["en", "de", None]), "s"))
        labels.append((i, good))
    return docs, labels


def test_held_out_accuracy_and_no_negatives(spark):
    docs, labels = corpus()
    d, known = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    net, prior = q.fit_quality(d, known.filter("quality = 0 OR doc_id % 2 = 0"))
    assert abs(prior - 0.8) < 0.08
    got = q.score_quality(d, net).join(known, "doc_id").filter(~q.in_training(F.col("doc_id"))).toPandas()
    assert (got.predicted == got.quality).mean() > 0.97
    assert abs(got.score.mean() - 0.8) < 0.1
    again, same = q.fit_quality(d, known.filter("quality = 1 AND doc_id % 2 = 0"))  # labels 0 are never read
    assert same == prior and np.array_equal(again.w1, net.w1) and (again.a, again.b) == (net.a, net.b)
    swapped = q.score_quality(d.withColumn("lang", F.lit("fr")).withColumn("source", F.lit("t")).withColumn("doc_id", -F.col("doc_id")), net).toPandas()
    own = q.score_quality(d, net).toPandas().set_index("doc_id").score
    assert np.allclose(swapped.set_index(-swapped.doc_id).score.sort_index().to_numpy(), own.sort_index().to_numpy())


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = corpus(300)
    d, known = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    turned = known.withColumn("quality", F.when(q.in_training(F.col("doc_id")), F.col("quality")).otherwise(1 - F.col("quality")))
    (one, a), (two, b) = q.fit_quality(d, known), q.fit_quality(d, turned)
    assert a == b and np.array_equal(one.w1, two.w1) and (one.a, one.b) == (two.a, two.b)


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame(odd_documents(), SCHEMA).withColumn("score", F.lit("mine")).withColumn("_bin", F.lit(1))
    none = spark.createDataFrame([(None, 1), (3, None), (4, 7), (99, 1)], "doc_id long, quality int")
    net, prior = q.fit_quality(docs, none)
    got = q.score_quality(docs, net).collect()
    assert prior == 0.5 and len(got) == docs.count() and all(r.score == 0.5 and r.predicted == 1 for r in got)
    some = spark.createDataFrame([(i, 1) for i in range(12)] + [(1, 0)], "doc_id long, quality int")
    net, prior = q.fit_quality(docs, some)
    assert all(0 <= r.score <= 1 for r in q.score_quality(docs, net).collect()) and 0 < prior < 1
    assert q.score_quality(docs.limit(0), net).count() == 0
    assert q.fit_quality(docs.limit(0), some)[1] == 0.5
