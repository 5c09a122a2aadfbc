"""Joins that state what they expect, and set operations on keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .hot import HotGroups, join_same, salted, spread
from .windows import attach_group, last_per, next_in


class RuleViolation(ValueError):
    pass


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "left", card: str = "many_to_one") -> DataFrame:
    """Equi-join that stops when a side declared unique is not. Null keys match each other."""
    for side, name in ((left, "one_to" if card.startswith("one_to") else None), (right, "to_one" if card.endswith("to_one") else None)):
        if name and not duplicate_keys(side, on).isEmpty():
            raise RuleViolation(f"join on {list(on)} is not {card}")
    return join_same(left, right, list(on), how)


def join_nullsafe(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    return join_same(left, right, list(on), how)


def lookup(df: DataFrame, dim: DataFrame, key: str, hot: HotGroups | None = None) -> DataFrame:
    """Left join to a unique dimension. Spark picks the plan; rows of hot keys are salted so no
    task gets all of them."""
    if not hot:
        return df.join(dim, key, "left")
    a, b = salted(df, dim, key, hot)
    return a.join(b, [key, "_salt"], "left").drop("_salt")


def semi(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    return df.join(keys, list(on), "left_semi")


def anti(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    return join_same(df, keys, list(on), "left_anti")


def key_diff(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """Keys on one side only, with the side."""
    a, b = a.select(*on).distinct(), b.select(*on).distinct()
    return anti(a, b, on).withColumn("side", F.lit("left")).unionByName(
        anti(b, a, on).withColumn("side", F.lit("right")))


def entrant_keys(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.union(b), frames).distinct()


def duplicates(df: DataFrame, keys) -> DataFrame:
    """Every member of a duplicated key, with the number of copies."""
    return join_same(df, duplicate_keys(df, keys), list(keys))


def lag_join(rows: DataFrame, standings: DataFrame, events: DataFrame, event: str, season: str, order, on, values,
             hot: HotGroups | None = None) -> DataFrame:
    """Attach the standing held after the previous event of the season."""
    nxt = next_in(events.select(event, season, *[o for o in order if o not in (event, season)]),
                  [season], order, event, "_next", hot).select(event, F.col("_next"))
    after = standings.select(event, *on, *values).join(nxt, event).drop(event).filter(F.col("_next").isNotNull())
    return join_same(rows, after.withColumnRenamed("_next", event), [event, *on], "left")


def prior_season_join(rows: DataFrame, standings: DataFrame, events: DataFrame, event: str, season: str, order, on,
                      values: dict[str, str]) -> DataFrame:
    """Attach the standing at the end of the previous season. ``values``: output -> column."""
    final = last_per(events.select(season, *[o for o in order if o != event], event), [season],
                     [o for o in order if o != event] + [event]).select(event, season)
    end = standings.select(event, *on, *[F.col(c).alias(o) for o, c in values.items()]).join(
        final, event).drop(event).withColumn(season, F.col(season) + 1)
    return join_same(rows, end, [season, *on], "left")


def overlay(df: DataFrame, corrections: DataFrame, key, cols) -> DataFrame:
    """Reviewed corrections win over the source, which is left as it is."""
    c = corrections.select(*key, *[F.col(x).alias(f"_new_{x}") for x in cols])
    d = join_same(df, c, list(key), "left")
    for x in cols:
        d = d.withColumn(x, F.coalesce(F.col(f"_new_{x}"), F.col(x)))
    return d.drop(*[f"_new_{x}" for x in cols])


def enrich(entries: DataFrame, registry: DataFrame, key, cols) -> DataFrame:
    """Given values win; gaps are filled from the registry."""
    r = registry.select(*key, *[F.col(x).alias(f"_reg_{x}") for x in cols])
    d = join_same(entries, r, list(key), "left")
    for x in cols:
        d = d.withColumn(x, F.coalesce(F.col(x), F.col(f"_reg_{x}")))
    return d.drop(*[f"_reg_{x}" for x in cols])


def source_conflicts(a: DataFrame, b: DataFrame, key: str, col: str) -> DataFrame:
    """Keys where two sources disagree or only one has a value."""
    d = a.select(key, F.col(col).alias("left_value")).join(b.select(key, F.col(col).alias("right_value")), key, "full_outer")
    return d.filter(~F.col("left_value").eqNullSafe(F.col("right_value")))


def _differs(x: Column, y: Column, rtol: float, atol: float) -> Column:
    """Whether a cell of a full join of _a and _b differs; it does where a side is missing."""
    x, y = x.cast("double"), y.cast("double")
    near = F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), x.isNull() & y.isNull())
    return ~near | F.col("_a").isNull() | F.col("_b").isNull()


def table_diff(a: DataFrame, b: DataFrame, keys, cols, rtol: float = 0.0, atol: float = 0.0) -> DataFrame:
    """Cells that differ by more than the tolerance, or keys on one side only. Null equals null."""
    left = a.select(*keys, F.struct(*cols).alias("_a"))
    right = b.select(*keys, F.struct(*cols).alias("_b"))
    d = left.join(right, list(keys), "full_outer")
    cells = F.array(*[F.when(_differs(F.col(f"_a.{c}"), F.col(f"_b.{c}"), rtol, atol), F.struct(
        F.lit(c).alias("column"), F.col(f"_a.{c}").cast("double").alias("left_value"),
        F.col(f"_b.{c}").cast("double").alias("right_value"))) for c in cols])
    return d.select(*keys, F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("_d")).select(*keys, "_d.*")


def diff_counts(a: DataFrame, b: DataFrame, keys, cols, planted, rtol: float = 0.0, atol: float = 0.0, total: int = 0) -> DataFrame:
    """One row: rows compared, cells that differ, and cells that differ after the first column of the
    ``planted`` rows of ``b`` was changed. The last number shows that the comparison finds changes.

    One join serves all three. ``total`` says how many rows a side has at most, for dealing them by the keys."""
    left = a.select(*keys, F.struct(*cols).alias("_a"))
    right = b.select(*keys, F.struct(*cols).alias("_b"), planted.alias("_planted"))
    d = spread(left, keys, total).join(spread(right, keys, total), list(keys), "full_outer")
    first, rest = cols[0], cols[1:]
    old = F.col(f"_b.{first}")
    wrong = F.when(F.col("_planted"), F.coalesce(old, F.lit(0)) + 1).otherwise(old)

    def cells(changed):
        found = [_differs(F.col(f"_a.{first}"), changed, rtol, atol), *[_differs(F.col(f"_a.{c}"), F.col(f"_b.{c}"), rtol, atol) for c in rest]]
        return F.coalesce(F.sum(sum((x.cast("long") for x in found), F.lit(0).cast("long"))), F.lit(0).cast("long"))

    both = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.lit(1))
    return d.agg(F.count(both).alias("compared"), cells(old).alias("differ"), cells(wrong).alias("planted"))


def field_maximum(df: DataFrame, by, col: str, out: str) -> DataFrame:
    return attach_group(df, by, None, **{out: F.max(col)})
