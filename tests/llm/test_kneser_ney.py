import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from priorfield.llm.hashing import mix, word_hashes
from priorfield.llm.kneser_ney import discounts, fit, in_training, score_texts, unmix

TEXTS = ["the cat sat on the mat", "The cat ate the rat", "a dog sat on a mat", "the dog ate", "", None, "  \n ", "the the the the", "a rat ran on the mat and the cat ran",
         "dog and cat and rat", "the cat sat on the mat", "zebra", "the mat sat on a zebra"] * 2 + ["über straße the", "on a mat the cat ran " * 40]


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["</s>"]


class Plain:
    """The same model from dictionaries."""

    def __init__(self, texts):
        self.uni, self.big = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.uni.update(w)
            self.big.update(zip(["</s>", *w[:-1]], w))
        self.total, self.kinds, self.before = Counter(), defaultdict(Counter), Counter()
        for (u, w), c in self.big.items():
            self.total[u] += c
            self.kinds[u][min(c, 3)] += 1
            self.before[w] += 1
        of = lambda values: discounts(*[sum(v == i for v in values) for i in range(1, 5)])
        self.d, self.e = of(self.big.values()), of(self.before.values())

    def p(self, u, w):
        m = sum(self.before.values())
        gamma = sum(self.e[min(x, 3)] for x in self.before.values()) / m
        x = self.before[w]
        p1 = (x - self.e[min(x, 3)]) / m + gamma / (len(self.uni) + 1)
        if not self.total[u]:
            return p1
        c = self.big[u, w]
        return (c - self.d[min(c, 3)] + sum(self.d[k] * n for k, n in self.kinds[u].items()) * p1) / self.total[u]


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, score string").repartition(3)
    model = fit(docs.filter(in_training(docs.doc_id)))
    return {r.doc_id: r for r in score_texts(docs, model).collect()}


def test_equals_plain_model(scored):
    train = [t for i, t in enumerate(TEXTS) if zlib.crc32(str(i).encode()) % 5 != 1]
    plain = Plain(train)
    n, v = sum(plain.uni.values()), len(plain.uni)
    assert len(scored) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        w, r = tokens(t), scored[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(plain.uni[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((plain.uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r.score == pytest.approx(sum(math.log10(plain.p(u, x)) for u, x in zip(["</s>", *w[:-1]], w)))


def test_probabilities_add_up(scored):
    plain = Plain(TEXTS)
    for u in ("the", "zebra", "never seen", "</s>"):
        assert sum(plain.p(u, w) for w in [*plain.uni, "unknown word"]) == pytest.approx(1)


def test_empty_training_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    none = fit(docs.limit(0))
    assert {(r.doc_id, r.n_tokens, r.n_known, r.score) for r in score_texts(docs, none).collect()} == {(1, 3, 0, 0.0), (None, 1, 0, 0.0)}
    assert score_texts(docs.limit(0), none).count() == 0


def test_held_out_text_is_better_than_unigrams(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit(docs.filter(in_training(docs.doc_id)))
    held = score_texts(docs.filter(~in_training(docs.doc_id)), model).toPandas()
    assert held.score.sum() > held.base_score.sum()


def test_hashes():
    x = np.arange(1000, dtype=np.uint64) * np.uint64(0x1234567890ABCDEF)
    assert (unmix(mix(x)) == x).all()
    for text in ["", "   ", "a", "ab ba\tab\x0bÄb \n", "x" * 70_000 + " y " + "x" * 70_000, "ab " * 50_000]:
        words, hashes = text.encode().lower().split(), word_hashes(text.encode())
        assert len(words) == len(hashes)
        assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
