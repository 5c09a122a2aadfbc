"""Hot groups: find the few keys too large for one task, and split them in order.

A window or a grouped list puts all rows of a key into one task. Keys with more rows than
``max_rows`` and more than 1/MAX_HOT of all rows are found by one counting pass. So at most
MAX_HOT keys are hot, none is left out, and every other key holds at most 1/MAX_HOT of the data;
the list is small enough to ship to every task, and whatever is aggregated per hot key is too.
All other keys keep the plain window plan.

Rows of a hot key are cut into chunks that follow the window order. The chunk limits come from
a sample picked by hash, but every row is kept and the limits only decide which task sees it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import materialize

MAX_ROWS_KEY = "spark.priorfield.maxGroupRows"
MAX_ROWS_DEFAULT = 1_000_000
MAX_HOT = 20_000
TASK_ROWS = 100_000
OVERSAMPLE = 8


@dataclass(frozen=True)
class HotGroups:
    keys: tuple[str, ...]
    rows: DataFrame | None  # keys + _hot_rows, at most MAX_HOT rows; None when no key is hot
    chunk_rows: int
    total: int = 0  # rows of the table the keys were counted on

    def __bool__(self) -> bool:
        return self.rows is not None

    def renamed(self, *keys: str) -> "HotGroups":
        if self.rows is None:
            return HotGroups(tuple(keys), None, self.chunk_rows, self.total)
        cols = [F.col(a).alias(b) for a, b in zip(self.keys, keys)]
        return HotGroups(tuple(keys), self.rows.select(*cols, "_hot_rows"), self.chunk_rows, self.total)


def join_same(left: DataFrame, right: DataFrame, keys, how: str = "inner", small: bool = False) -> DataFrame:
    """Join where null keys match each other; keeps the left keys.

    ``small`` asks for a broadcast and is only given for sides with a proven bound.
    """
    for k in keys:
        right = right.withColumnRenamed(k, f"_r_{k}")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    got = left.join(F.broadcast(right) if small else right, on, how)
    return got if how in ("left_semi", "left_anti") else got.drop(*[f"_r_{k}" for k in keys])


def find_hot(df: DataFrame, keys, max_rows: int | None = None, weight: str | None = None) -> HotGroups:
    """Count rows per key (map-side combined) and keep the keys above the limit.

    The limit is at least 1/MAX_HOT of all rows, so at most MAX_HOT keys can be above it; chunks
    grow with the table so that their number is bounded too. ``weight`` sums a count column of a table counted before. Keys may be
    counted on a narrower table than the one to be split: an upper bound is enough.
    """
    spark, keys = df.sparkSession, tuple(keys)
    if max_rows is None:
        max_rows = int(spark.conf.get(MAX_ROWS_KEY, str(MAX_ROWS_DEFAULT)))
    size = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.groupBy(*keys).agg(size.cast("long").alias("_hot_rows"))
    total, largest = counts.agg(F.sum("_hot_rows"), F.max("_hot_rows")).first()
    max_rows = max(max_rows, (total or 0) // MAX_HOT)
    if (largest or 0) <= max_rows:
        return HotGroups(keys, None, max_rows, total or 0)
    found = counts.filter(F.col("_hot_rows") > max_rows).collect()  # at most MAX_HOT rows
    chunk_rows = max(max_rows, sum(r["_hot_rows"] for r in found) // MAX_HOT)
    return HotGroups(keys, spark.createDataFrame(found, counts.schema), chunk_rows, total)


def deal(df: DataFrame, hot: HotGroups) -> DataFrame:
    """Rows dealt by the counted keys, so that a task gets about TASK_ROWS however large the table is.

    Windows and groups of these keys keep that deal; their sorts lie in memory side by side, and partitions
    merged by size would grow with the table. With hot keys, or few rows, nothing is dealt.
    """
    return df if hot else spread(df, hot.keys, hot.total)


def spread(df: DataFrame, keys, total: int) -> DataFrame:
    """Rows without hot keys dealt by keys, about TASK_ROWS to a task when there are ``total`` of them."""
    if total <= TASK_ROWS:
        return df
    n = max(-(-total // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def join_dealt(left: DataFrame, right: DataFrame, keys, hot: HotGroups, how: str = "inner") -> DataFrame:
    """``join_same`` with both sides dealt by the keys, about TASK_ROWS of the counted rows to a task.

    ``hot`` is counted on some of the keys. With hot keys, or few rows, nothing is dealt and Spark may split what is skewed.
    """
    def dealt(df):  # a null key lies with the nulls of the other side
        marks = []
        for k in keys:
            kind = df.schema[k].dataType
            marks += [F.coalesce(F.col(k), F.lit("" if isinstance(kind, T.StringType) else 0).cast(kind)), F.col(k).isNull()]
        return spread(df, marks, hot.total)

    plain = all(isinstance(d.schema[k].dataType, (T.NumericType, T.StringType)) for d in (left, right) for k in keys)
    return join_same(left, right, keys, how) if hot or not plain else join_same(dealt(left), dealt(right), keys, how)


def split_hot(df: DataFrame, hot: HotGroups) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys).

    The hot rows are written once to the shared folder: several branches read them, and without
    the copy every operator in a chain would multiply the plan.
    """
    if not hot:
        return df, None
    few = hot.rows.select(*hot.keys)
    big = join_same(df, few, hot.keys, "left_semi", True)
    return join_same(df, few, hot.keys, "left_anti", True), materialize(big)


def salted(left: DataFrame, right: DataFrame, key: str, hot: HotGroups) -> tuple[DataFrame, DataFrame]:
    """Spread hot keys of a join: left rows get a salt from their own hash, right rows are copied
    once per salt. Copies are made for hot keys only, so their number is bounded."""
    n = F.ceil(F.col("_hot_rows") / F.lit(hot.chunk_rows)).cast("long").alias("_salts")
    plan = hot.renamed(key).rows.select(key, n)
    row = F.pmod(F.xxhash64(*left.columns), F.col("_salts"))
    a = join_same(left, plan, [key], "left", True).withColumn("_salt", F.coalesce(row, F.lit(0).cast("long"))).drop("_salts")
    last = F.coalesce(F.col("_salts"), F.lit(1).cast("long")) - 1
    b = join_same(right, plan, [key], "left", True).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("_salts")
    return a, b


def find_index(bounds: Column, x: Column) -> Column:
    """How many entries of a sorted array are <= x, by bisection."""
    steps = F.ceil(F.log2(F.size(bounds) + F.lit(1.0))).cast("int") + F.lit(1)
    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))

    def step(s, _):
        mid = ((s["lo"] + s["hi"]) / F.lit(2)).cast("int")
        right = F.get(bounds, mid) <= x
        return (
            F.when(s["lo"] >= s["hi"], s)
            .when(right, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi")))
            .otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))
        )

    return F.aggregate(F.sequence(F.lit(1), steps), start, step)["lo"]


def order_key(order) -> Column:
    return F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])


def chunk_hot(rows: DataFrame, hot: HotGroups, order, out: str = "_chunk") -> DataFrame:
    """Number the order-following chunks of each hot key; a chunk fits one task."""
    spark, keys = rows.sparkSession, hot.keys
    plan = hot.rows.withColumn(
        "_chunks", F.ceil(F.col("_hot_rows") / F.lit(hot.chunk_rows)).cast("long") + 1
    ).withColumn(
        "_every", F.greatest(F.lit(1), F.floor(F.col("_hot_rows") / (F.col("_chunks") * OVERSAMPLE)))
    )
    seen = join_same(rows, plan, keys, small=True).select(
        *keys, order_key(order).alias("_at"), "_every", "_chunks"
    )
    picked = seen.filter(F.pmod(F.xxhash64("_at"), F.col("_every")) == 0).select(
        *keys, "_at", "_chunks"
    )
    sample = picked.groupBy(*keys).agg(
        F.sort_array(F.collect_set("_at")).alias("_s"), F.max("_chunks").alias("_chunks")
    )
    stride = F.greatest(F.lit(1), F.floor(F.size("_s") / F.col("_chunks"))).cast("int")
    limits = sample.select(
        *keys, F.filter("_s", lambda _, i: F.pmod(i + 1, stride) == 0).alias("_limits")
    )
    found = limits.collect()
    d = join_same(rows, spark.createDataFrame(found, limits.schema), keys, "left", True)
    d = d.withColumn("_row_at", order_key(order)).withColumn(out, F.lit(0))
    most = max((len(r["_limits"]) for r in found), default=0)
    for i in reversed(range(most.bit_length())):  # how many limits are <= the row, by halved steps
        d = d.withColumn(out, F.col(out) + F.when(F.get("_limits", F.col(out) + (2**i - 1)) <= F.col("_row_at"), 2**i).otherwise(0))
    return d.drop("_limits", "_row_at")
