"""Bootstrap over events. Draws come from a hash, so any engine and any retry repeats them.

Every repetition gives every event a weight from the Poisson distribution with mean one, which is
how often resampling draws an event. The weight is a hash of (seed, repetition, event), so it is
made where the event lies: tasks digest blocks of events and add them up per repetition, and only
rows of repetitions and metrics travel.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize

DIGITS = 15  # hexadecimal digits of a draw: 60 bits
BLOCK = 16384  # events digested together: their words stay in a processor's cache
# fixed values of MD5
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]


def limits() -> list[str]:
    """Draws from these limits on mean one more: the distribution function at 0, 1, 2, ..., as digits.

    Digits of equal number compare as texts like the numbers they stand for."""
    total, out = 0.0, []
    for k in range(16):
        total += math.exp(-1) / math.factorial(k)
        x = int(total * 16**DIGITS)
        if x < 16**DIGITS:
            out.append(f"{x:0{DIGITS}x}")
    return out


def draws(texts: list[bytes], seed: int, reps: int):
    """(rep, weights of all events) of every repetition, for the events' texts ``:event`` (empty for none).

    One MD5 digest of ``seed:even repetition:event`` has the draws of that repetition and the next. Texts of one
    block are digested together, all others one by one."""
    first = [f"{seed}:{rep}".encode() for rep in range(0, reps, 2)]
    n = len(texts)
    size = np.fromiter(map(len, texts), np.int64, n)
    short = size <= 55 - max(map(len, first))
    long = np.flatnonzero(~short)
    raw = np.zeros((n, 64), np.uint8)
    for i in np.flatnonzero(short):
        raw[i, :size[i]] = np.frombuffer(texts[i], np.uint8)
    raw[short, size[short]] = 0x80
    blocks = {}  # by length of the first part: the words of the block behind it
    for text in first:
        k = len(text)
        if k not in blocks:
            moved = np.zeros((n, 64), np.uint8)
            moved[:, k:56] = raw[:, :56 - k]
            moved.view("<u4")[:, 14] = (size + k) * 8
            blocks[k] = np.ascontiguousarray(moved.view("<u4").T)
    borders = [np.uint64(int(x, 16)) for x in limits()]
    for pair, text in enumerate(first):
        words = list(blocks[len(text)])
        head = np.frombuffer(text.ljust(-(-len(text) // 4) * 4, b"\0"), "<u4")
        for i, x in enumerate(head):
            words[i] = words[i] | x
        digest = _md5(words)
        for i in long:
            digest[i] = np.frombuffer(hashlib.md5(text + texts[i], usedforsecurity=False).digest(), "<u4")
        high, low = digest.view(">u8").astype(np.uint64).T
        for rep, draw in ((2 * pair, high >> np.uint64(4)), (2 * pair + 1, (high & np.uint64(15)) << np.uint64(56) | low >> np.uint64(8))):
            if rep < reps:
                w = np.zeros(n, np.uint8)
                for x in borders:
                    w += draw >= x
                yield rep, w


def _md5(words) -> np.ndarray:
    """Digests of one block each, as rows of four words; ``words`` are the 16 words of all blocks."""
    state = [np.full(len(words[0]), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (x.copy() for x in state)
    f, turned = np.empty_like(a), np.empty_like(a)
    for i, add in enumerate(_SINES):
        if i < 32:  # d ^ (b & (c ^ d)), then c ^ (d & (b ^ c))
            x, y, z = (b, c, d) if i < 16 else (d, b, c)
            np.bitwise_xor(y, z, out=f)
            f &= x
            f ^= z
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16]
        f += add
        turn = _TURNS[i // 16][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=turned)
        f <<= np.uint32(turn)
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    return np.stack([x + y for x, y in zip(state, (a, b, c, d))], axis=1)


def _resample(events: DataFrame, key: str, values, reps: int, seed: int) -> DataFrame:
    """Per repetition, over all events with their weights: ``s_<value>``, the sum of weight times value, and
    ``w_<value>``, the sum of weights, where the value is not null. Null if all values are.

    Tasks add up their own events; only a row of each task and repetition is shuffled."""
    names = [f"{part}_{v}" for v in values for part in ("s", "w")]
    schema = ", ".join(["rep int", *[f"`{c}` double" for c in names]])

    def add(batches):
        total, seen = np.zeros((reps, len(names))), np.zeros(len(names), bool)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                texts = [x.encode() for x in part.column(0).to_pylist()]
                cells = np.zeros((len(texts), len(names)))
                for i in range(len(values)):
                    got = part.column(i + 1).is_valid().to_numpy(zero_copy_only=False)
                    cells[:, 2 * i] = part.column(i + 1).fill_null(0.0).to_numpy(zero_copy_only=False)
                    cells[:, 2 * i + 1] = got
                    seen[2 * i:2 * i + 2] |= got.any()
                for rep, w in draws(texts, seed, reps):
                    total[rep] += w.astype(float) @ cells
        if seen.any():
            columns = [pa.array(total[:, i] if seen[i] else [None] * reps, pa.float64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(range(reps), pa.int32()), *columns], names=["rep", *names])

    # rows are few and draws are many: keep the number of partitions that small rows would be merged out of
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.concat(F.lit(":"), F.col(key).cast("string")), F.lit(""))
    rows = events.repartition(parts, key).select(text.alias("_text"), *[F.col(v).cast("double").alias(v) for v in values])
    return rows.mapInArrow(add, schema).groupBy("rep").agg(*[F.sum(c).alias(c) for c in names])


def _interval(samples: DataFrame, points: DataFrame, metrics) -> DataFrame:
    """Long table: metric, estimate, 2.5% and 97.5% of the repetitions."""
    def long(df, out):
        parts = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(out)) for m in metrics])
        return df.select(F.explode(parts).alias("_m")).select("_m.metric", f"_m.{out}")

    ends = long(samples, "v").groupBy("metric").agg(
        F.percentile("v", F.lit(0.025)).alias("lower_95"), F.percentile("v", F.lit(0.975)).alias("upper_95"))
    return long(points, "estimate").join(ends, "metric")


def bootstrap_mean(events: DataFrame, key: str, metrics, reps: int, seed: int) -> DataFrame:
    """Interval of the mean of per-event values; null values are left out. ``key`` names the event."""
    metrics = list(metrics)
    events = materialize(events.select(key, *metrics))
    d = _resample(events, key, metrics, reps, seed)
    means = [F.try_divide(f"s_{m}", f"w_{m}").alias(m) for m in metrics]
    point = events.agg(*[F.avg(m).alias(m) for m in metrics])
    return _interval(d.select(*means), point, metrics)


def bootstrap_pooled(events: DataFrame, key: str, sums: dict[str, str], rows: str, reps: int, seed: int) -> DataFrame:
    """Interval of a row mean when whole events are drawn: sums over rows are pooled, then divided.

    ``sums`` maps metric name to the per-event sum column; ``rows`` is the per-event row count.
    """
    cols = list(dict.fromkeys([*sums.values(), rows]))
    events = materialize(events.select(key, *cols))
    d = _resample(events, key, cols, reps, seed)
    ratios = [F.try_divide(f"s_{c}", f"s_{rows}").alias(m) for m, c in sums.items()]
    point = events.agg(*[(F.sum(c) / F.sum(rows)).alias(m) for m, c in sums.items()])
    return _interval(d.select(*ratios), point, list(sums))
