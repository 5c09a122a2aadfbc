"""A convolutional text classifier in numpy: hashed word embeddings, filters of several widths, max pooling.

The model is small and fixed in size. It is trained on the driver from a bounded sample of labelled
rows, whose texts reach the driver as word hashes, and sent to the workers, which score whole
texts. Decision thresholds, the common one and those by language, are calibrated on all labelled rows
that the model was not fitted on, from counts by score bin.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .hashing import PUNCTUATION, word_groups

BUCKETS, DIMENSION, FILTERS, WIDTHS = 1 << 16, 16, 16, (1, 2, 3)
PAD = max(WIDTHS) - 1  # padding behind each text, so that windows never reach into the next one
#: The bound of the training sample: rows of each class, taken in the order of a hash of their id.
SAMPLE = 3_000
EPOCHS, BATCH, RATE = 12, 32, 0.05
#: A language needs so many rows of each class among those not fitted on for a threshold of its own.
LEAST = 25
#: Bins of the logit per unit: a power of two, so that borders are exact.
BINS = 64


def in_training(doc_id: Column) -> Column:
    """Rows whose labels may be learnt: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def bucket_groups(texts: list[bytes]):
    """(first text, starts, buckets): words of each text as buckets, with padding behind."""
    for first, starts, words in word_groups(texts, between=PUNCTUATION):
        buckets = (words % np.uint64(BUCKETS)).astype(np.int32)
        at = np.repeat(starts[1:], PAD)
        yield first, starts + PAD * np.arange(len(starts)), np.insert(buckets, at, BUCKETS)


@dataclass
class Model:
    """Embeddings (the last row, padding, stays zero), filters by width, output weights, and thresholds of the logit."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    intercept: float
    threshold: float = 0.0
    by_language: dict[str, float] = field(default_factory=dict)

    @classmethod
    def start(cls, seed: int = 7) -> "Model":
        rng = np.random.default_rng(seed)
        e = rng.normal(0, 0.1, (BUCKETS + 1, DIMENSION)).astype(np.float32)
        e[BUCKETS] = 0
        filters = [rng.normal(0, 1 / np.sqrt(w * DIMENSION), (w, DIMENSION, FILTERS)).astype(np.float32) for w in WIDTHS]
        out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        return cls(e, filters, np.zeros(FILTERS * len(WIDTHS), dtype=np.float32), out, 0.0)

    def pooled(self, buckets: np.ndarray, starts: np.ndarray, places: bool = False):
        """Per text and filter the largest response (relu), and where it is."""
        x = self.embedding[buckets]
        tall, where = [], []
        for w, f in zip(WIDTHS, self.filters):
            y = x @ f[0]
            for k in range(1, w):
                y[:-k] += x[k:] @ f[k]
            tall.append(np.maximum.reduceat(y, starts[:-1], axis=0))
            if places:
                where.append(np.stack([a + y[a:b].argmax(axis=0) for a, b in zip(starts[:-1], starts[1:])]))
        tall = np.maximum(np.concatenate(tall, axis=1) + self.bias, 0)
        return (tall, np.concatenate(where, axis=1)) if places else tall

    def logits(self, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.pooled(buckets, starts) @ self.out + self.intercept

    def step(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, memory: dict):
        """One Adagrad step on a batch; only embeddings at the largest responses change."""
        buckets = np.concatenate(texts)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        tall, where = self.pooled(buckets, starts, True)
        p = 1 / (1 + np.exp(-np.clip(tall @ self.out + self.intercept, -30, 30)))
        g = ((p - labels) * weights / len(texts)).astype(np.float32)
        d_tall = np.outer(g, self.out) * (tall > 0)
        updates = [("out", tall.T @ g + 1e-4 * self.out), ("bias", d_tall.sum(axis=0))]
        rows, grads = [], []
        for i, w in enumerate(WIDTHS):
            own = slice(i * FILTERS, (i + 1) * FILTERS)
            d, at = d_tall[:, own], where[:, own]
            d_filter = np.zeros_like(self.filters[i])
            for k in range(w):
                place = np.minimum(at + k, len(buckets) - 1)  # text, filter
                words = buckets[place]
                d_filter[k] = np.einsum("tf,tfd->df", d, self.embedding[words])
                rows.append(words.ravel())
                grads.append((d[:, :, None] * self.filters[i][k].T[None]).reshape(-1, DIMENSION))
            self._move(f"filter{i}", self.filters[i], d_filter, memory)
        for name, grad in updates:
            self._move(name, getattr(self, name), grad, memory)
        memory["b"] = memory.get("b", 1e-6) + float(g.sum()) ** 2
        self.intercept -= RATE * float(g.sum()) / np.sqrt(memory["b"])
        rows, grads = np.concatenate(rows), np.concatenate(grads)
        used, at = np.unique(rows, return_inverse=True)
        total = np.zeros((len(used), DIMENSION), dtype=np.float32)
        np.add.at(total, at, grads)
        sums = memory.setdefault("e", np.full(BUCKETS + 1, 1e-6, dtype=np.float32))
        sums[used] += (total * total).mean(axis=1)
        self.embedding[used] -= RATE * total / np.sqrt(sums[used])[:, None]
        self.embedding[BUCKETS] = 0

    @staticmethod
    def _move(name: str, value: np.ndarray, grad: np.ndarray, memory: dict):
        sums = memory.setdefault(name, np.full(value.shape, 1e-6, dtype=np.float32))
        sums += grad * grad
        value -= RATE * grad / np.sqrt(sums)


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit on all given rows; both classes must be among them."""
    model, memory = Model.start(seed), {}
    fit, rng = np.arange(len(labels)), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for i in range(0, len(fit), BATCH):
            own = fit[i:i + BATCH]
            model.step([texts[j] for j in own], labels[own], np.ones(len(own)), memory)
    return model


def untrained() -> Model:
    """Every text gets a score near 0."""
    model = Model.start()
    model.out[:] = 0
    model.intercept = -20.0
    return model


def best_thresholds(counts: DataFrame, weights: tuple[float, float], least: int = LEAST) -> dict[str, float]:
    """By language, and over all rows as "", the border of the logit with the best F1, in the middle of
    the gap between the bins it lies between; of equal ones the highest.

    ``counts`` has rows of each class, ``n0`` and ``n1``, by ``lang`` and ``bin``; a row counts as often as
    the weight of its class says. Languages with fewer than ``least`` rows of either class are left out.
    """
    own = counts.filter(F.coalesce("lang", F.lit("")) != "").select("lang", "bin", "n0", "n1")
    common = counts.groupBy("bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).select(F.lit("").alias("lang"), "bin", "n0", "n1")
    every, down = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy(F.desc("bin"))
    so_far = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w0, w1 = map(F.lit, weights)
    d = own.unionByName(common).select(
        "lang", "bin", F.lead("bin").over(down).alias("below"), *[F.sum(n).over(so_far).alias(f"h{n}") for n in ("n0", "n1")],
        *[F.sum(n).over(every).alias(f"all_{n}") for n in ("n0", "n1")])
    d = d.filter((F.col("lang") == "") | (F.least("all_n0", "all_n1") >= least))
    f1 = 2 * w1 * F.col("hn1") / (w1 * F.col("hn1") + w0 * F.col("hn0") + w1 * F.col("all_n1"))
    best = d.groupBy("lang").agg(F.max(F.struct(f1.alias("f1"), "bin", "below")).alias("b")).select("lang", "b.bin", "b.below").collect()
    return {r["lang"]: (r["bin"] + (r["bin"] - BINS if r["below"] is None else r["below"] + 1)) / (2 * BINS) for r in best}


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Train on four fifths of at most ``sample`` labelled rows of each class, from ids that ``in_training``
    names, and calibrate thresholds on all other rows of these ids. Without rows of both classes in both
    parts, every text gets a score near 0.

    Labels other than 0 and 1 and null ids are left out; an id with several labels counts as 1 if
    any is; of several rows of one id the one whose words come first is used.
    """
    known = labels.filter(in_training(F.col(id_col)) & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(
        F.max(label_col).alias("_label"))
    parts = [known.filter(F.col("_label") == c).orderBy(F.xxhash64(id_col), id_col).limit(sample) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # at most 2 * sample rows
    rows = docs.select(F.col(id_col), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), id_col)

    def hashed(batches):
        for batch in batches:
            out = []
            for _, starts, buckets in bucket_groups([t.encode() if t else b"" for t in batch.column(3).to_pylist()]):
                out += [buckets[a:b].astype("<i4").tobytes() for a, b in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], names=["doc_id", "label", "lang", "words"])

    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col("_label").cast("int").alias("label"), "lang", "text").mapInArrow(
        hashed, "doc_id long, label int, lang string, words binary").groupBy("doc_id").agg(
        F.min("label").alias("label"), F.min("words").alias("words"))
    got = sorted(rows.withColumn("at", F.xxhash64("doc_id")).collect(), key=lambda r: (r["at"], r["doc_id"]))
    got = [r for i, r in enumerate(got) if i % 5]  # rows come in the order of a hash
    y = np.array([r["label"] for r in got], dtype=int)
    fitted = np.bincount(y, minlength=2)
    if fitted.min() == 0:
        return untrained()
    model = train([np.frombuffer(r["words"], dtype="<i4") for r in got], y)
    used = docs.sparkSession.createDataFrame([(r["doc_id"],) for r in got], "_used long")  # at most 2 * sample rows
    rest = docs.filter(in_training(F.col(id_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text")).join(
        F.broadcast(used), F.col("_id").cast("long") == F.col("_used"), "left_anti")
    # texts are scored before the join, so that none is shuffled
    scored = _with_logits(rest, model).groupBy("_id").agg(F.min(F.struct("_lang", "_logit")).alias("_s"))
    counts = materialize(scored.join(known.withColumnRenamed(id_col, "_id"), "_id").groupBy(
        F.col("_s._lang").alias("lang"), F.floor(F.col("_s._logit") * BINS).alias("bin")).agg(
        F.sum(1 - F.col("_label")).cast("long").alias("n0"), F.sum("_label").cast("long").alias("n1")))
    n = counts.agg(F.sum("n0"), F.sum("n1")).first()
    if not (n[0] and n[1]):
        return untrained()
    # rows fitted on are missing from the counts, more of the rarer class; each other row counts for its share of them
    model.by_language = best_thresholds(counts, (1 + float(fitted[0]) / n[0], 1 + float(fitted[1]) / n[1]))
    model.threshold = model.by_language.pop("")
    return model


def _with_logits(rows: DataFrame, model: Model) -> DataFrame:
    """``_lang`` and ``_text``, the last two columns, give way to ``_lang``, ``_logit`` and ``_own``: the
    threshold of the row's language. Only these two go to Python, and no text comes back."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # of fixed size, but for a threshold a language
    kind = pa.struct([("logit", pa.float64()), ("own", pa.float64())])

    @F.arrow_udf("logit double, own double")
    def score(texts: pa.Array, langs: pa.Array) -> pa.Array:
        m = shared.value
        logits = [m.logits(buckets, starts) for _, starts, buckets in bucket_groups([t.encode() if t else b"" for t in texts.to_pylist()])]
        own = [m.by_language.get(lang, m.threshold) for lang in langs.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(logits).astype(float) if logits else [], pa.float64()), pa.array(own, pa.float64())], fields=list(kind))

    return rows.withColumn("_found", score("_text", "_lang")).select(
        *[c for c in rows.columns if c != "_text"], F.col("_found.logit").alias("_logit"), F.col("_found.own").alias("_own"))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Score whole texts; one row out per row in, with the columns ``keep`` (all by default).

    Adds ``score`` (0 to 1, at least 0.5 from the best common threshold on; the text alone decides
    it), ``predicted`` (score >= 0.5) and ``rejected``: the threshold of the row's language is met
    (the common one for null or rare languages). Null and empty texts are scored as no words.
    Columns of these names are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted", "rejected")]
    rows = docs.select(*keep, F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"))
    scored = _with_logits(rows, model).withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(float(model.threshold)) - F.col("_logit"))))
    return scored.select(*keep, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("_logit") >= F.col("_own")).alias("rejected"))
