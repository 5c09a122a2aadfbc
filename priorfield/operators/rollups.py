"""Grouped summaries of event histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .hot import join_same


def group_event_rollup(history: DataFrame, event: str, group: str, carry=(), **sums_and_means: Column) -> DataFrame:
    """One row per (event, group): entry count plus the given aggregates. ``carry`` are columns
    fixed within the event."""
    return history.groupBy(event, group, *carry).agg(
        F.count(F.lit(1)).alias("entries"), *[a.alias(n) for n, a in sums_and_means.items()])


def total_or_zero(c: str) -> Column:
    """Sum where a group with only nulls gives 0."""
    return F.coalesce(F.sum(c), F.lit(0))


def sum_or_null(c: str) -> Column:
    return F.sum(c)


def venue_event_rollup(history: DataFrame, event: str, venue: str, winner: str, slot: str, carry=(), **means: Column) -> DataFrame:
    """One row per (event, venue), with the winner's start slot and whether it was slot 1."""
    d = history.groupBy(event, venue, *carry).agg(
        F.min(F.when(F.col(winner) == 1, F.col(slot))).alias("winner_slot"),
        *[a.alias(n) for n, a in means.items()])
    return d.withColumn("first_slot_won", F.coalesce(F.col("winner_slot") == 1, F.lit(False)).cast("int"))


def split_summary(df: DataFrame, split: str, event: str, season: str, eligible: str) -> DataFrame:
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(eligible).alias("eligible_rows"),
        F.count_distinct(event).alias("events"), F.sort_array(F.collect_set(season)).alias("seasons"))


def null_profile(df: DataFrame, cols=None) -> DataFrame:
    """column, nulls: only columns that have any. One aggregation over all columns."""
    cols = list(cols or df.columns)
    one = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    return one.unpivot([], cols, "column", "nulls").filter(F.col("nulls") > 0)


def distinct_profile(df: DataFrame, cols) -> DataFrame:
    """column, nulls, distinct values: counted from (column, value) pairs, combined map-side."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    v = df.select(F.explode(pairs).alias("_p")).select("_p.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return v.groupBy("column").agg(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
                                   F.count("value").alias("distinct_values"))


def constant_columns(df: DataFrame, cols) -> DataFrame:
    return distinct_profile(df, cols).filter(F.col("distinct_values") <= 1).select("column")


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count()


def crosstab(df: DataFrame, row: str, col: str, values) -> DataFrame:
    """Counts by two columns; the pivot values are given, so no extra pass finds them."""
    return df.groupBy(row).pivot(col, list(values)).count().na.fill(0)


def event_counts(df: DataFrame, event: str, **flags: str) -> DataFrame:
    return df.groupBy(event).agg(F.count(F.lit(1)).alias("entries"), *[F.sum(c).alias(n) for n, c in flags.items()])


def unseen_categories(df: DataFrame, split: str, cols, train: str = "train") -> DataFrame:
    """(split, column, value) of the other splits that training never had."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    v = df.select(split, F.explode(pairs).alias("_p")).select(split, "_p.*").distinct()
    known = v.filter(F.col(split) == train).select("column", "value")
    return join_same(v.filter(F.col(split) != train), known, ["column", "value"], "left_anti")


def coverage(events: DataFrame, event: str, season: str, present, children: dict[str, DataFrame]) -> DataFrame:
    """Per season: events, present fields, and events that have rows in each child table."""
    d = events
    for name, child in children.items():
        has = child.select(event).distinct().withColumn(f"_{name}", F.lit(1))
        d = d.join(has, event, "left")
    return d.groupBy(season).agg(
        F.count(F.lit(1)).alias("events"), *[F.count(c).alias(f"with_{c}") for c in present],
        *[F.count(f"_{n}").alias(f"in_{n}") for n in children])


def by_scope(df: DataFrame, season: str, *aggs: Column) -> DataFrame:
    """The same aggregates overall and per season, in one pass over grouping sets."""
    return df.groupingSets([[], [season]], season).agg(
        F.when(F.grouping(season) == 1, F.lit("all")).otherwise(F.col(season).cast("string")).alias("scope"), *aggs
    ).drop(season)


def assert_constant(df: DataFrame, key: str, col: str) -> DataFrame:
    """Keys with more than one value of the column (expected: none)."""
    return df.groupBy(key).agg(F.min(col).alias("_a"), F.max(col).alias("_b"), F.count(F.when(F.col(col).isNull(), 1)).alias("_n")).filter(
        (F.col("_a") != F.col("_b")) | ((F.col("_n") > 0) & F.col("_a").isNotNull())).select(key)


def field_totals(long: DataFrame, *keys: str, p: str | dict[str, str] = "p") -> DataFrame:
    """Sum of a probability per key. ``p`` may map targets to columns: then one row per key and target."""
    if isinstance(p, str):
        return long.groupBy(*keys).agg(F.sum(p).alias("total"))
    sums = long.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{c}") for c in p.values()])
    cells = F.array(*[F.struct(F.lit(y).alias("target"), F.col(f"_t_{c}").alias("total")) for y, c in p.items()])
    return sums.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")


def winner_audit(df: DataFrame, event: str, entrant: str, label: str, p: str) -> DataFrame:
    """Labels per event and extremes of per-event sums, whether one entrant won everything, and
    the loss recomputed."""
    from .metrics import log_loss_row

    e = df.withColumn("_l", log_loss_row(label, p)).groupBy(event).agg(
        F.sum(label).alias("winners"), F.sum(p).alias("total"), F.sum("_l").alias("loss"),
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col(label) == 1, F.col(entrant))).alias("winner"))
    return e.agg(
        F.count(F.lit(1)).alias("events"), F.min("winners").alias("min_winners"), F.max("winners").alias("max_winners"),
        F.min("total").alias("min_total"), F.max("total").alias("max_total"),
        (F.count_distinct("winner") == 1).cast("int").alias("same_winner"),
        (F.sum("loss") / F.sum("n")).alias("log_loss"))


def outcome_coverage(announced: DataFrame, results: DataFrame, event: str, entrant: str, positive: str) -> DataFrame:
    """Per event: announced, with a result, positives among them, positives outside the field."""
    a = announced.select(event, entrant).withColumn("_a", F.lit(1))
    d = a.join(results.select(event, entrant, positive), [event, entrant], "full_outer")
    inside, pos = F.col("_a").isNotNull(), F.coalesce(F.col(positive), F.lit(0))
    return d.groupBy(event).agg(
        F.count("_a").alias("announced"), F.sum((inside & F.col(positive).isNotNull()).cast("int")).alias("with_result"),
        F.sum(F.when(inside, pos).otherwise(0)).alias("positives"),
        F.sum(F.when(~inside, pos).otherwise(0)).alias("positives_outside"))


def entry_counts(entries: DataFrame, event: str, group: str) -> DataFrame:
    return entries.groupBy(event, group).agg(F.count(F.lit(1)).alias("entries"))


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
