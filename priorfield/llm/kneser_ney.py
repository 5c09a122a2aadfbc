"""An interpolated modified Kneser-Ney bigram model, counted in Spark and looked up in mapped arrays.

Words are 64-bit hashes; a word's rank in the sorted hash array of the vocabulary is its id. All
counts are sorted arrays in shards (see arrays.py), written to the shared folder:

- vocabulary shards (by word hash): hash, count; a second set of arrays in the same order holds
  what belongs to a word as a context (tokens behind it, and words seen behind it once, twice,
  three times or more) and the number of different words before it;
- bigram shards (by a mixed key of both ids): key and count.

Workers map these files and score whole texts. The order is two: at three, the counts of the given
texts alone are larger than the disk that the job may use.

    p(w | u) = (c(uw) - D(c)) / c(u) + gamma(u) p1(w),   gamma(u) = (D1 N1(u) + D2 N2(u) + D3 N3(u)) / c(u)
    p1(w) = (m(w) - E(m)) / M + gamma1 / (V + 1),        m(w): different words before w, M: their sum

and p(w | u) = p1(w) for a context never seen. The discounts D of bigram counts and E of the
numbers m follow Chen and Goodman (1998). V + 1 counts one unknown word, so p(. | u) adds up to one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .arrays import Arrays, count_keys, merged, new_store, pack, pack_any, shards_for, store_of, unpack, unpack_any, write_arrays
from .hashing import mix, word_groups

#: Hash of the end token; no word hash is compared with it but by value.
END = np.uint64(0x9D5C3A1F0E7B2468)
CONTEXT = ("total", "n1", "n2", "n3", "before")


def in_training(doc_id: Column) -> Column:
    """Documents to learn from: crc32 of the id as text, modulo 5, is not 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 1


def token_groups(texts: list[bytes]):
    """(first text, starts, tokens) as word_groups gives them, with the end token behind each text."""
    for first, starts, words in word_groups(texts):
        yield first, starts + np.arange(len(starts)), np.insert(words, starts[1:], END)


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, by the numbers of counts of 1 to 4.

    Where a number is 0 the formula has no value, and the discount is what a half of the count leaves: 0.5."""
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(x, 0.0), k) for k, x in enumerate(d, 1))])


@dataclass
class Model:
    words: Arrays  # hashes and counts
    context: Arrays  # in the ranks of words; keys are not used
    bigrams: Arrays
    tokens: int
    vocabulary: int
    d: np.ndarray
    e: np.ndarray
    pairs: int
    before_counts: np.ndarray  # how many words have 1, 2 and 3 or more different words before them

    def lower(self, before: np.ndarray) -> np.ndarray:
        """p1 of words by the number of different words seen before them."""
        if not self.pairs:
            return np.full(len(before), 1.0 / (self.vocabulary + 1))
        gamma = float(self.before_counts @ self.e[1:]) / self.pairs
        return (before - self.e[np.minimum(before, 3)]) / self.pairs + gamma / (self.vocabulary + 1)

    def score(self, tokens: np.ndarray, starts: np.ndarray):
        """Per text: known tokens, base score, model score. ``starts`` has one entry more than texts."""
        order = np.argsort(tokens)
        rank, count = np.empty(len(tokens), dtype=np.int64), np.empty(len(tokens), dtype=np.float64)
        found, got = self.words.look_up(tokens[order], counts="<u8")
        rank[order], count[order] = found, got["counts"]
        beside = {k: np.zeros(len(tokens)) for k in CONTEXT}
        placed = np.flatnonzero(rank >= 0)
        placed = placed[np.argsort(rank[placed], kind="stable")]
        cut = np.searchsorted(rank[placed], self.words.first)
        for shard in np.flatnonzero(np.diff(cut)).tolist():
            at = placed[cut[shard]:cut[shard + 1]]
            for k in CONTEXT:
                beside[k][at] = self.context.get(shard, k, "<u8")[rank[at] - self.words.first[shard]]
        base = np.log10((count + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))
        # the context of a text's first token is the end token
        begin = starts[:-1]
        end_at = starts[1:] - 1
        previous = np.concatenate([[0], np.arange(len(tokens) - 1)])
        previous[begin] = end_at  # any end token of the group: all are alike
        u = rank[previous]
        seen = np.flatnonzero((u >= 0) & (rank >= 0))
        keys = bigram_keys(u[seen], rank[seen])
        by_key = np.argsort(keys)
        _, got = self.bigrams.look_up(keys[by_key], counts="<u8")
        pair = np.zeros(len(tokens), dtype=np.int64)
        pair[seen[by_key]] = got["counts"]
        p1 = self.lower(beside["before"].astype(np.int64))
        total = beside["total"][previous] * (u >= 0)
        gamma = self.d[1] * beside["n1"][previous] + self.d[2] * beside["n2"][previous] + self.d[3] * beside["n3"][previous]
        safe = np.maximum(total, 1)
        p = np.where(total > 0, (pair - self.d[np.minimum(pair, 3)] + gamma * p1) / safe, p1)
        score = np.log10(p)
        return np.add.reduceat((count > 0).astype(np.int64), begin), np.add.reduceat(base, begin), np.add.reduceat(score, begin)


def bigram_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A mixed key of two ranks below 2**32: mixing is one to one, and spreads a frequent context over all shards."""
    return mix((u.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def _texts(batch) -> list[bytes]:
    return [t.encode() if t else b"" for t in batch.column(batch.num_columns - 1).to_pylist()]


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Count the model over all whole texts of ``docs``. Null counts as empty; an empty table gives
    a model that knows no word and gives the unknown word probability one."""
    spark, shards = docs.sparkSession, shards_for(docs, text_col)
    texts, store = docs.select(F.col(text_col).cast("string").alias("text")), new_store(spark)

    def token_keys(batches):
        for batch in batches:
            for _, _, tokens in token_groups(_texts(batch)):
                yield tokens

    def write_words(table: pa.Table) -> pa.Table:
        shard, keys, counts = merged(table)
        name = write_arrays(store, keys=keys, counts=counts.astype("<u8"))
        return pa.table({"shard": pa.array([shard], pa.int32()), "file": [name], "n": [len(keys)], "tokens": [int(counts.sum())]})

    rows = count_keys(texts, token_keys, shards).groupBy("shard").applyInArrow(
        write_words, "shard int, file string, n long, tokens long").collect()  # one row per shard
    words = store_of(store, [r[:3] for r in rows], shards)
    if words.first[-1] >= 1 << 32:
        raise ValueError("more than 2**32 different words")

    def pair_keys(batches):
        for batch in batches:
            held, size = [], 0
            for _, starts, tokens in token_groups(_texts(batch)):
                held.append((tokens, starts))
                size += len(tokens)
                if size > 500_000:
                    yield pairs_of(held)
                    held, size = [], 0
            if held:
                yield pairs_of(held)

    def pairs_of(held):
        tokens = np.concatenate([t for t, _ in held])
        order = np.argsort(tokens)
        rank = np.empty(len(tokens), dtype=np.int64)
        rank[order] = words.look_up(tokens[order])[0]
        previous = np.concatenate([rank[-1:], rank[:-1]])  # the token before a text's first is an end token, as every text ends in one
        return bigram_keys(previous, rank)

    first = words.first

    def write_pairs(table: pa.Table) -> pa.Table:
        shard, keys, counts = merged(table)
        name = write_arrays(store, keys=keys, counts=counts.astype("<u8"))
        both = unmix(keys)
        u, w = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out = {k: [] for k in ("shard", "what", "ids", "a", "b", "c", "d")}
        order = np.argsort(u, kind="stable")
        ids, begin = np.unique(u[order], return_index=True)
        c = counts[order].astype(np.int64)
        stats = [np.add.reduceat(x, begin) for x in (c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64))]
        later, how_many = np.unique(w, return_counts=True)
        for what, at, values in (("context", ids, stats), ("before", later, [how_many] * 4)):
            cut = np.searchsorted(at, first)
            for i in np.flatnonzero(np.diff(cut)).tolist():
                a, b = cut[i], cut[i + 1]
                parts = [pack_any(v[a:b].astype(np.uint64)) for v in (values if what == "context" else values[:1])]
                parts += [b""] * (4 - len(parts))
                for k, v in zip(out, (i, what, pack(at[a:b].astype(np.uint64)), *parts)):
                    out[k].append(v)
        for k, v in zip(out, (shard, "file", pack(np.array([len(keys), *(int((counts == i).sum()) for i in range(1, 5))], dtype=np.uint64).cumsum()), name.encode(), b"", b"", b"")):
            out[k].append(v)
        return pa.table(out, schema=pa.schema([("shard", pa.int32()), ("what", pa.string()), *((k, pa.binary()) for k in ("ids", "a", "b", "c", "d"))]))

    counted = count_keys(texts, pair_keys, shards).groupBy("shard").applyInArrow(write_pairs, "shard int, what string, ids binary, a binary, b binary, c binary, d binary")
    parts = materialize(counted)
    files = parts.filter("what = 'file'").select("shard", "a", "ids").collect()  # one row per shard
    numbers = [np.diff(unpack(bytes(r["ids"])), prepend=np.uint64(0)).astype(np.int64) for r in files]
    bigrams = store_of(store, [(r["shard"], bytes(r["a"]).decode(), int(n[0])) for r, n in zip(files, numbers)], shards)

    def write_context(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        arrays = {k: np.zeros(first[shard + 1] - first[shard], dtype="<u8") for k in CONTEXT}
        for row in table.to_pylist():
            at = unpack(row["ids"]).astype(np.int64) - first[shard]
            kinds = zip(CONTEXT[:4], ("a", "b", "c", "d")) if row["what"] == "context" else (("before", "a"),)
            for kind, column in kinds:
                arrays[kind][at] += unpack_any(row[column])
        n = [int((arrays["before"] == i).sum()) for i in range(1, 5)]
        return pa.table({"shard": pa.array([shard], pa.int32()), "file": [write_arrays(store, **arrays)], "n": [len(arrays["before"])],
                         "m": [n], "more": [int((arrays["before"] > 2).sum())]})

    rows_c = parts.filter("what <> 'file'").groupBy("shard").applyInArrow(
        write_context, "shard int, file string, n long, m array<long>, more long").collect()  # one row per shard
    context = store_of(store, [r[:3] for r in rows_c], shards)
    of_pairs = np.sum([n[1:] for n in numbers], axis=0) if numbers else np.zeros(4)
    of_before = np.sum([r["m"] for r in rows_c], axis=0) if rows_c else np.zeros(4)
    return Model(words, context, bigrams, sum(r["tokens"] for r in rows), int(first[-1]), discounts(*of_pairs), discounts(*of_before),
                 int(sum(n[0] for n in numbers)), np.array([of_before[0], of_before[1], sum(r["more"] for r in rows_c)], dtype=float))


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score whole texts; one row out per row in: id, n_tokens, n_known, train_tokens, base_score, score and perplexity.

    Tokens are words and one end. ``score`` is the model's log10 probability of the text and
    ``perplexity`` 10 ** (-score / n_tokens). Null and empty texts are the end token alone. Null
    ids and repeated rows are kept; other columns are not read.
    """
    names = ("doc_id", "n_tokens", "n_known", "base_score", "score")

    def score(batches):
        for batch in batches:
            ids, texts = batch.column(0), _texts(batch)
            out, held, size = [], [], 0
            for group in token_groups(texts):
                held.append(group)
                size += len(group[2])
                if size > 300_000:
                    out.append(of(held))
                    held, size = [], 0
            if held:
                out.append(of(held))
            if out:
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(c)) for c in zip(*out))], names=list(names))

    def of(held):
        tokens = np.concatenate([t for *_, t in held])
        sizes = np.concatenate([np.diff(s) for _, s, _ in held])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        return (sizes, *model.score(tokens, starts))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        score, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return rows.select(F.col("doc_id").alias(id_col), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
                       F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
