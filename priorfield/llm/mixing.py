"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic). The tokens of the cells are raked: each
round scales the cells of every source, then of every language, then of every topic, to that
marginal's target share, until all three hold. A cell's weight over its tokens, times one common
rate, is the probability of its documents, and a hash of the document decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .hashing import word_groups
from .packing import document_point, projection

MARGINALS = ("source", "lang", "topic")
#: Power of a value's share of tokens that is its target: 1 keeps shares, 0 makes them equal.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.5}
RATE, ROUNDS, TOLERANCE = 0.7, 60, 1e-6
#: Cells are broadcast up to this number; beyond it they are joined by a shuffle.
SMALL = 50_000
NONE = "\u0000"  # stands for a null value of a marginal


def with_topics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``_topic`` (0 to 7, the signs of three projections of the hashed words) and ``_tokens`` (words, at least 1)."""
    matrix = projection(dimensions=3)
    kind = pa.struct([("topic", pa.string()), ("tokens", pa.int64())])

    @F.arrow_udf("topic string, tokens long")
    def look(texts: pa.Array) -> pa.Array:
        topics, tokens = [], []
        for _, starts, words in word_groups([t.encode() if t else b"" for t in texts.to_pylist()]):
            for a, b in zip(starts[:-1], starts[1:]):
                topics.append(str(int(np.dot(document_point(words[a:b], matrix) > 0, [1, 2, 4]))))
                tokens.append(max(1, int(b - a)))
        return pa.StructArray.from_arrays([pa.array(topics, pa.string()), pa.array(tokens, pa.int64())], fields=list(kind))

    # only the text goes to Python, and no text comes back
    return docs.withColumn("_found", look(F.col(text_col).cast("string"))).select(
        *docs.columns, F.col("_found.topic").alias("_topic"), F.col("_found.tokens").alias("_tokens"))


def target_shares(cells: DataFrame, targets: dict | None, powers: dict) -> DataFrame:
    """cells with the target share of each marginal's value: given (missing values: 0), or a power of its share of tokens."""
    for m in MARGINALS:
        given = (targets or {}).get(m)
        if given is None:
            own = cells.groupBy(m).agg(F.pow(F.sum("tokens").cast("double"), F.lit(float(powers[m]))).alias("x"))
        else:
            own = cells.sparkSession.createDataFrame([(NONE if k is None else str(k), float(v)) for k, v in given.items()], f"{m} string, x double")
            own = cells.select(m).distinct().join(own, m, "left").fillna(0.0, ["x"])
        total = own.agg(F.sum("x")).first()[0] or 1.0
        cells = cells.join(own.withColumn(f"t_{m}", F.col("x") / F.lit(total)).drop("x"), m)
    return cells


def rake(cells: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Scale ``w`` until each marginal of it has its target share; a few rounds run as one job.

    Where targets contradict empty cells, the last round's weights are returned."""
    for _ in range(0, rounds, 3):
        for _ in range(3):
            for m in MARGINALS:
                held = F.sum("w").over(Window.partitionBy(m))
                cells = cells.withColumn("w", F.when(held > 0, F.col("w") * F.col(f"t_{m}") / held).otherwise(F.lit(0.0)))
        cells = materialize(cells)
        worst = 0.0
        for m in MARGINALS[:-1]:  # the last one holds exactly
            off = cells.groupBy(m).agg(F.abs(F.sum("w") - F.first(f"t_{m}")).alias("off")).agg(F.max("off")).first()[0]
            worst = max(worst, off or 0.0)
        if worst <= tolerance:
            break
    return cells


def common_rate(cells: DataFrame, wanted: float) -> float:
    """The factor f with sum(min(tokens, f * w)) = wanted * sum(tokens), by narrowing an interval of 64 parts."""
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    if not total:
        return 0.0
    low, high = 0.0, total
    while cells.agg(F.sum(F.least(F.col("tokens").cast("double"), high * F.col("w")))).first()[0] < wanted * total and high < total * 1e9:
        high *= 16
    for _ in range(5):
        grid = np.linspace(low, high, 65)
        got = cells.agg(*[F.sum(F.least(F.col("tokens").cast("double"), float(f) * F.col("w"))).alias(str(i)) for i, f in enumerate(grid)]).first()
        k = min(int(np.searchsorted(np.maximum.accumulate(np.array(got, dtype=float)), wanted * total)), 64)
        low, high = float(grid[max(0, k - 1)]), float(grid[k])
    return high


def mix_sources(docs: DataFrame, targets: dict | None = None, powers: dict | None = None, rate: float = RATE, seed: int = 0,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Give every document a probability such that kept tokens follow the target marginals.

    All input columns come back with ``topic``, ``n_tokens``, ``probability`` and ``kept``; columns
    of these names are replaced. About ``rate`` of all tokens are kept; a probability is at most 1.
    Null sources and languages are values of their own; null and empty texts count one token; rows
    of one id are kept or dropped together only if all their columns that are used agree. The same
    input and seed keep the same rows. An empty table gives an empty table.
    """
    names = [c for c in docs.columns if c not in ("topic", "n_tokens", "probability", "kept")]
    keyed = with_topics(docs.select(*names), text_col).withColumn("_source", F.coalesce(F.col(source_col).cast("string"), F.lit(NONE))).withColumn(
        "_lang", F.coalesce(F.col(lang_col).cast("string"), F.lit(NONE)))
    cells = keyed.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic")).agg(
        F.sum("_tokens").alias("tokens"))
    cells = materialize(cells)
    cells = rake(target_shares(cells, targets, {**POWERS, **(powers or {})}).withColumn("w", F.col("tokens").cast("double")))
    factor = common_rate(cells, rate)
    chance = cells.select(F.col("source").alias("_source"), F.col("lang").alias("_lang"), F.col("topic").alias("_topic"),
                          F.least(F.lit(1.0), F.lit(factor) * F.col("w") / F.col("tokens")).alias("probability"))
    keys = ["_source", "_lang", "_topic"]
    if cells.count() <= SMALL:
        found = keyed.join(F.broadcast(chance), keys, "left")
    else:  # cells of a large source are hot: rows take a salt, cells are copied per salt
        salts = 16
        copies = chance.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = keyed.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(copies, [*keys, "_salt"], "left")
    place = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(NONE)), F.lit(seed), "_source", "_lang", "_topic", "_tokens")
    draw = (F.shiftrightunsigned(place, 11)).cast("double") / F.lit(float(1 << 53))
    return found.select(*names, F.col("_topic").cast("int").alias("topic"), F.col("_tokens").alias("n_tokens"), "probability",
                        (draw < F.col("probability")).alias("kept"))
