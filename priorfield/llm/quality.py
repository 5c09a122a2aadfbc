"""A text-quality classifier from trusted positives and unlabelled text (positive-unlabelled learning).

Rows labelled 1 are the trusted positives; all documents, whatever their label, are the unlabelled
text. No row is ever taken as a negative.

1. A network that tells positives from unlabelled text is trained on a bounded sample.
2. The class prior is estimated from its scores on all other documents: the smallest ratio of the
   share of unlabelled text to the share of positives above a score, with a margin for chance
   (Garg et al., 2021).
3. The classifier minimises the non-negative unbiased risk with that prior (Kiryo et al., 2017).
4. Its logits are turned into probabilities by the two numbers that minimise the unbiased logistic
   risk over all other documents, which is convex in them.

Steps 2 and 4 read counts by score bin over all documents; only the networks are fitted on a
sample. Features are taken from whole texts: hashed shapes of words (runs of letters, digits and
marks), repeats of words and lines, and shares of kinds of characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .hashing import WHITE, mix, word_groups

SHAPES, HIDDEN = 256, 16
#: Bounds of the fitting sample: positives and unlabelled documents, taken in the order of a hash of their id.
POSITIVES, UNLABELLED = 3_000, 6_000
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 30, 600, 256, 0.02, 1e-4
#: Bins of a score per unit, and the largest score told apart.
BINS, MOST = 64, 40.0
#: Confidence of the margin in the prior's estimate.
DELTA = 0.1
#: Fixed kinds of bytes: lower-case letters and all bytes beyond ASCII, upper-case letters, digits; other bytes stand for themselves.
KIND = np.arange(256, dtype=np.uint8)
KIND[[*range(97, 123), *range(128, 256)]] = ord("a")
KIND[65:91] = ord("b")
KIND[48:58] = ord("0")
DENSE = 16


def in_training(doc_id: Column) -> Column:
    """Rows whose labels may be learnt: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def shapes_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds of bytes with runs of letters or digits cut to one and runs of one mark to two, and which bytes are kept."""
    kind = KIND[raw]
    same = np.concatenate([[False], kind[1:] == kind[:-1]])
    word = (kind == ord("a")) | (kind == ord("b")) | (kind == ord("0"))
    twice = same & np.concatenate([[False], same[:-1]])
    keep = ~(same & (word | twice) & ~WHITE[kind])
    return kind[keep], keep


def sums(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of ``x`` over ranges."""
    total = np.concatenate([[0.0], np.cumsum(x, dtype=float)])
    return total[end] - total[begin]


def new_in_text(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which hashes are the first of their kind in their text."""
    order = np.lexsort((np.arange(len(hashes)), hashes, text))
    first = np.ones(len(hashes), dtype=bool)
    a, b = order[1:], order[:-1]
    first[order[1:]] = (hashes[a] != hashes[b]) | (text[a] != text[b])
    return first


def features(texts: list[bytes]):
    """Yields (first text, matrix): a row of ``SHAPES + DENSE`` numbers for each text, of whole texts."""
    for first, starts, words in word_groups(texts):
        n_texts = len(starts) - 1
        own = texts[first:first + n_texts]
        text = b"\n".join(own)
        raw = np.frombuffer(text, dtype=np.uint8)
        size = np.array([len(t) for t in own])
        end = np.cumsum(size + 1) - 1  # the break between two texts is part of neither
        begin_text = end - size
        kind, _ = shapes_of(raw)
        _, _, shapes = next(word_groups([kind.tobytes()], group=len(kind) + 2))
        n = np.diff(starts)
        at = np.repeat(np.arange(n_texts), n)
        again = np.zeros(len(words), dtype=bool)
        again[1:] = (words[1:] == words[:-1]) & (at[1:] == at[:-1])
        bucket = (mix(shapes + again.astype(np.uint64)) % np.uint64(SHAPES)).astype(np.int64)
        bag = np.bincount(at * SHAPES + bucket, minlength=n_texts * SHAPES).reshape(n_texts, SHAPES)
        out = np.zeros((n_texts, SHAPES + DENSE), dtype=np.float32)
        out[:, :SHAPES] = np.sqrt(bag / np.maximum(n, 1)[:, None])
        # lines as hashes of their words, in order
        breaks = np.concatenate([[0], np.cumsum(raw == 10)])
        begin = np.flatnonzero(~WHITE[raw] & np.concatenate([[True], WHITE[raw[:-1]]])) if len(raw) else np.empty(0, dtype=np.int64)
        line = breaks[begin]
        line_at = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(words) else np.empty(0, dtype=np.int64)
        place = (np.arange(len(words)) - np.repeat(line_at, np.diff(np.append(line_at, len(words))))).astype(np.uint64)
        lines = np.add.reduceat(mix(words + place), line_at) if len(words) else words
        line_text = at[line_at]
        n_lines = np.bincount(line_text, minlength=n_texts)
        local = at * np.int64(1 << 40) + (np.arange(len(words)) - np.repeat(starts[:-1], n)) // 64  # blocks of 64 words
        share = lambda mask: sums(mask, begin_text, end) / np.maximum(size, 1)
        of_words = lambda mask: sums(mask, starts[:-1], starts[1:]) / np.maximum(n, 1)
        dense = [np.log1p(n) / 5, np.log1p(n_lines) / 5, of_words(again), of_words(~new_in_text(words, local)), of_words(~new_in_text(words, at)),
                 np.bincount(line_text, ~new_in_text(lines, line_text), minlength=n_texts) / np.maximum(n_lines, 1),
                 share(KIND[raw] == ord("a")), share(KIND[raw] == ord("b")), share(KIND[raw] == ord("0")), share(WHITE[raw]), share(raw == 10), share(raw >= 128),
                 share((raw < 128) & ~WHITE[raw] & (KIND[raw] != ord("a")) & (KIND[raw] != ord("b")) & (KIND[raw] != ord("0"))),
                 sums(~WHITE[raw], begin_text, end) / np.maximum(n, 1) / 10, n == 0, n < 5]
        out[:, SHAPES:] = np.stack(dense, axis=1)
        yield first, out


def softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class Network:
    """One hidden layer over scaled features; ``a`` and ``b`` turn its logit into that of a probability."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    a: float = 1.0
    b: float = 0.0

    @classmethod
    def start(cls, x: np.ndarray, seed: int) -> "Network":
        rng = np.random.default_rng(seed)
        w1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN))
        return cls(x.mean(axis=0, dtype=float), np.maximum(x.std(axis=0, dtype=float), 0.02), w1, np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1))

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(np.clip((x - self.shift) / self.scale, -5, 5) @ self.w1 + self.b1, 0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.hidden(x) @ self.w2 + self.b2[0], -MOST, MOST)

    def gradients(self, x: np.ndarray, g: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the sum of a loss with derivative ``g`` by each row's logit."""
        own = np.clip((x - self.shift) / self.scale, -5, 5)
        h = np.maximum(own @ self.w1 + self.b1, 0)
        d = np.outer(g, self.w2) * (h > 0)
        return {"w1": own.T @ d, "b1": d.sum(axis=0), "w2": h.T @ g, "b2": np.array([g.sum()])}


def risk_slopes(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative unbiased risk of a batch, and the slopes by the logits of positives and of
    unlabelled rows that a step follows.

    The risk is prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]) for the logistic loss l. While
    the second part, the risk on negatives, is below zero, a step only takes it back up.
    """
    positive = prior * softplus(-z_p).mean()
    negative = softplus(z_u).mean() - prior * softplus(z_p).mean()
    g_p, g_u = -prior * sigmoid(z_p) / len(z_p), sigmoid(z_u) / len(z_u)
    if negative >= 0:
        return positive + negative, g_p - prior * sigmoid(-z_p) / len(z_p), g_u
    return positive, -g_p, -g_u


def separation_slopes(z_p: np.ndarray, z_u: np.ndarray, _: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The logistic risk of telling positives from unlabelled rows, each half of the weight, and its slopes."""
    risk = (softplus(-z_p).mean() + softplus(z_u).mean()) / 2
    return risk, -sigmoid(-z_p) / len(z_p) / 2, sigmoid(z_u) / len(z_u) / 2


def train(x_p: np.ndarray, x_u: np.ndarray, slopes, prior: float = 0.5, seed: int = 7) -> Network:
    """Adam on batches of positives and unlabelled rows in the proportion given."""
    net, rng = Network.start(np.concatenate([x_p, x_u]), seed), np.random.default_rng(seed)
    steps = max(1, -(-(len(x_p) + len(x_u)) // BATCH))
    memory = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in ("w1", "b1", "w2", "b2")}
    t, epochs = 0, max(EPOCHS, -(-LEAST_STEPS // steps))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + RATE / 20
        for own_p, own_u in zip(np.array_split(rng.permutation(len(x_p)), steps), np.array_split(rng.permutation(len(x_u)), steps)):
            if not (len(own_p) and len(own_u)):
                continue
            x = np.concatenate([x_p[own_p], x_u[own_u]])
            z = net.logits(x)
            _, g_p, g_u = slopes(z[:len(own_p)], z[len(own_p):], prior)
            t += 1
            for k, grad in net.gradients(x, np.concatenate([g_p, g_u])).items():
                value, (m, v) = getattr(net, k), memory[k]
                if k in ("w1", "w2"):
                    grad = grad + DECAY * value
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return net


def estimate_prior(bins: np.ndarray, n_p: np.ndarray, n_u: np.ndarray, delta: float = DELTA) -> float:
    """The share of positives in unlabelled text, from rows of both kinds by score bin.

    The least, over all borders, of (share of unlabelled above + margin) / (share of positives above);
    the border is where that has the margin added, the estimate is the plain ratio there.
    """
    order = np.argsort(-bins)
    p, u = np.cumsum(n_p[order]).astype(float), np.cumsum(n_u[order]).astype(float)
    if not len(p) or p[-1] == 0 or u[-1] == 0:
        return 0.5
    share_p, share_u = p / p[-1], u / u[-1]
    margin = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(p[-1]) + 1 / np.sqrt(u[-1]))
    seen = share_p > 0
    best = np.argmin((share_u[seen] + margin) / share_p[seen])
    return float(np.clip((share_u[seen] / share_p[seen])[best], 0.01, 0.99))


def probability_line(z: np.ndarray, n_p: np.ndarray, n_u: np.ndarray, prior: float) -> tuple[float, float]:
    """(a, b) that minimise E_u[log(1 + exp(a z + b))] - prior * E_p[a z + b], by Newton steps; a stays
    positive, and a pull towards (1, 0), as strong as one row, keeps few rows from extremes."""
    p, u = n_p / max(n_p.sum(), 1), n_u / max(n_u.sum(), 1)
    a, b, pull = 1.0, 0.0, 1 / max(n_p.sum() + n_u.sum(), 1)
    x = np.stack([z, np.ones_like(z)])
    loss = lambda a, b: (u * softplus(a * z + b)).sum() - prior * (p * (a * z + b)).sum() + pull / 2 * ((a - 1) ** 2 + b * b)
    for _ in range(100):
        s = sigmoid(a * z + b)
        grad = x @ (u * s - prior * p) + pull * np.array([a - 1, b])
        step = np.linalg.solve((x * (u * s * (1 - s))) @ x.T + pull * np.eye(2), grad)
        size, now = 1.0, loss(a, b)
        while size > 1e-6 and (a - size * step[0] <= 0 or loss(a - size * step[0], b - size * step[1]) > now):
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(size * step).max() < 1e-9 or size <= 1e-6:
            break
    return float(a), float(b)


def undecided() -> Network:
    """Every text gets the score 1/2."""
    n = SHAPES + DENSE
    return Network(np.zeros(n), np.ones(n), np.zeros((n, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1))


def _with_logits(rows: DataFrame, net: Network) -> DataFrame:
    """The columns before the last one, ``_text``, with ``_logit``."""
    shared = rows.sparkSession.sparkContext.broadcast(net)  # of fixed size
    schema = rows.drop("_text").schema.add("_logit", "double")

    def score(batches):
        for batch in batches:
            own = shared.value
            logits = [own.logits(x) for _, x in features([t.encode() if t else b"" for t in batch.column(batch.num_columns - 1).to_pylist()])]
            column = pa.array(np.concatenate(logits) if logits else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=[*batch.schema.names[:-1], "_logit"])

    return rows.mapInArrow(score, schema)


def _sample(docs: DataFrame, chosen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and features of a bounded number of documents, in the order of a hash; of several rows of an id the least."""
    def take(batches):
        for batch in batches:
            parts = [x for _, x in features([t.encode() if t else b"" for t in batch.column(1).to_pylist()])]
            rows = [r.astype("<f4").tobytes() for x in parts for r in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["id", "x"])

    rows = docs.join(F.broadcast(chosen), "_id").select("_id", "_text").mapInArrow(take, "id long, x binary").groupBy("id").agg(F.min("x").alias("x"))
    got = sorted(rows.withColumn("at", F.xxhash64("id")).collect(), key=lambda r: (r["at"], r["id"]))
    return np.array([r["id"] for r in got], dtype=np.int64), np.stack([np.frombuffer(r["x"], dtype="<f4") for r in got]) if got else np.zeros((0, SHAPES + DENSE))


def score_counts(rest: DataFrame, trusted: DataFrame, net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, positives, unlabelled documents) by bin of the logit, at most 2 * MOST * BINS rows; texts are scored before anything is shuffled."""
    scored = materialize(_with_logits(rest, net).withColumn("_bin", F.floor(F.col("_logit") * BINS)).drop("_logit"))
    u = scored.groupBy("_bin").agg(F.count(F.lit(1)).alias("u"))
    p = scored.groupBy("_id").agg(F.min("_bin").alias("_bin")).join(trusted, "_id", "left_semi").groupBy("_bin").agg(F.count(F.lit(1)).alias("p"))
    got = u.join(p, "_bin", "left").collect()
    return tuple(np.array([r[k] or 0 for r in got], dtype=float) for k in ("_bin", "p", "u"))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[Network, float]:
    """The classifier and the class prior, from ids that ``in_training`` names.

    The networks are fitted on at most ``positives`` trusted ids and ``unlabelled`` ids of documents,
    lowest hashes first; one fifth of the documents, by another hash, is never fitted on. Prior and
    probabilities come from all rows not fitted on. Null ids and labels other than 0 and 1 are left
    out; an id with several labels is trusted if one is 1. Without positives or documents on either
    side every text scores 1/2.
    """
    trusted = materialize(labels.filter(in_training(F.col(id_col)) & F.col(id_col).isNotNull() & (F.col(label_col) == 1)).select(
        F.col(id_col).cast("long").alias("_id")).distinct())
    rows = docs.filter(in_training(F.col(id_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    may_fit = F.pmod(F.xxhash64(F.col("_id"), F.lit(5)), F.lit(5)) > 0
    some = lambda ids, n: ids.filter(may_fit).orderBy(F.xxhash64("_id"), "_id").limit(n)
    held = rows.select("_id").distinct()
    own_p, own_u = some(held.join(trusted, "_id", "left_semi"), positives), some(held, unlabelled)
    (id_p, x_p), (id_u, x_u) = _sample(rows, own_p), _sample(rows, own_u)
    if not (len(x_p) and len(x_u)):
        return undecided(), 0.5
    used = docs.sparkSession.createDataFrame([(int(i),) for i in np.union1d(id_p, id_u)], "_id long")  # bounded by the sample
    rest = rows.join(F.broadcast(used), "_id", "left_anti")
    prior = estimate_prior(*score_counts(rest, trusted, train(x_p, x_u, separation_slopes)))
    net = train(x_p, x_u, risk_slopes, prior)
    bins, n_p, n_u = score_counts(rest, trusted, net)
    if n_p.sum() and n_u.sum():
        net.a, net.b = probability_line((bins + 0.5) / BINS, n_p, n_u, prior)
    return net, prior


def score_quality(docs: DataFrame, net: Network, text_col: str = "text", least: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """Score whole texts; one row out per row in, with the columns ``keep`` (all by default).

    Adds ``score``, the probability of good quality, and ``predicted`` (score >= ``least``). The text
    alone decides; null and empty texts are scored as no words. Columns of these names are replaced.
    An empty table gives an empty table.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    rows = _with_logits(docs.select(*keep, F.col(text_col).cast("string").alias("_text")), net)
    rows = rows.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-net.b) - F.lit(net.a) * F.col("_logit"))))
    return rows.select(*keep, "score", (F.col("score") >= least).cast("int").alias("predicted"))
