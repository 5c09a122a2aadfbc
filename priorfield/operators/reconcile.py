"""Make per-event probabilities nest and sum to fixed totals.

The projection onto {0 <= x <= upper, sum x = target} is x = clip(value - shift, 0, upper) for
one shift per event. The total is piecewise linear in the shift, with a corner where a row
starts to move (value - upper) and one where it reaches zero (value). Sorting the corners and
taking running sums gives the total at every corner, so the exact shift follows from the last
corner whose total still reaches the target. No iteration, no per-event list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .hot import HotGroups, find_hot, join_same, split_hot
from .windows import running_total

QUOTAS = {"win": 1, "podium": 3, "points": 10}  # fixed values


def monotone_row(low, mid, high) -> tuple[Column, Column, Column]:
    """Least-squares projection of three values onto low <= mid <= high (min-max form)."""
    a, b, c = F.col(low), F.col(mid), F.col(high)
    ab, bc, abc = (a + b) / 2, (b + c) / 2, (a + b + c) / 3
    return (F.least(a, ab, abc), F.greatest(F.least(ab, abc), F.least(b, bc)), F.greatest(c, bc, abc))


def _corners(df: DataFrame, value: str, upper: str) -> Column:
    v, u = F.col(value), F.col(upper)
    return F.explode(F.array(F.struct((v - u).alias("at"), F.lit(1).alias("step")),
                             F.struct(v.alias("at"), F.lit(-1).alias("step"))))


def _solve(best: Column, least: Column, goal: Column) -> Column:
    """Shift from the last corner whose total reaches the target."""
    shift = F.when(best["active"] > 0, best["at"] + (best["total"] - goal) / best["active"]).otherwise(best["at"])
    return F.coalesce(shift, least)


def _apply(value: str, upper: str) -> Column:
    return F.least(F.greatest(F.col(value) - F.col("_shift"), F.lit(0.0)), F.col(upper))


def _project_cold(df: DataFrame, event: str, value: str, upper: str, target: str, out: str) -> DataFrame:
    every = Window.partitionBy(event)
    run = every.orderBy("_at", F.desc("_step"))
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    d = df.select("*", _corners(df, value, upper).alias("_c"))
    d = d.select(*df.columns, F.col("_c.at").alias("_at"), F.col("_c.step").alias("_step"))
    d = d.select(
        "*", F.row_number().over(run).alias("_rn"), F.sum("_step").over(upto).alias("_active"),
        F.sum(F.col("_step") * F.col("_at")).over(upto).alias("_moved"),
        F.sum(F.when(F.col("_step") == 1, F.col(upper))).over(every).alias("_cap"),
    )
    d = d.withColumn("_total", F.col("_cap") + F.col("_moved") - F.col("_active") * F.col("_at"))
    d = d.withColumn("_goal", F.least(F.col(target).cast("double"), F.col("_cap")))
    reached = F.when(F.col("_total") >= F.col("_goal"), F.struct(
        F.col("_at").alias("at"), F.col("_rn"), F.col("_total").alias("total"), F.col("_active").alias("active")))
    d = d.select("*", F.max(reached).over(every).alias("_best"), F.min("_at").over(every).alias("_least"))
    d = d.filter(F.col("_step") == -1)
    d = d.withColumn("_shift", _solve(F.col("_best"), F.col("_least"), F.col("_goal")))
    return d.select(*[c for c in df.columns if c != out], _apply(value, upper).alias(out))


def _project_hot(df: DataFrame, event: str, value: str, upper: str, target: str, out: str, hot: HotGroups) -> DataFrame:
    caps = df.groupBy(event).agg(F.sum(upper).alias("_cap"), F.first(target).alias("_target"),
                                 F.min(F.col(value) - F.col(upper)).alias("_least"))
    c = df.select(event, _corners(df, value, upper).alias("_c")).select(event, "_c.at", "_c.step")
    c = c.groupBy(event, "at").agg(F.sum("step").alias("step"))
    c = c.withColumn("moved", F.col("step") * F.col("at"))
    c = running_total(c, [event], ["at"], hot, active="step", sum_moved="moved")
    c = join_same(c, caps, [event], small=True)  # one row per hot event
    goal = F.least(F.col("_target").cast("double"), F.col("_cap"))
    c = c.withColumn("total", F.col("_cap") + F.col("sum_moved") - F.col("active") * F.col("at"))
    best = c.groupBy(event).agg(
        F.max(F.when(F.col("total") >= goal, F.struct("at", "total", "active"))).alias("_best"),
        F.min("_least").alias("_least"), F.min(goal).alias("_goal"))
    shift = best.select(event, _solve(F.col("_best"), F.col("_least"), F.col("_goal")).alias("_shift"))
    d = join_same(df, shift, [event], small=True)
    return d.select(*[x for x in df.columns if x != out], _apply(value, upper).alias(out))


def project_bounded_sum(df: DataFrame, event: str, value: str, upper: str, target: str, out: str,
                        hot: HotGroups | None = None) -> DataFrame:
    """Project ``value`` per event onto 0 <= x <= upper with sum equal to min(target, sum upper)."""
    hot = find_hot(df, [event]) if hot is None else hot
    cold, big = split_hot(df, hot)
    got = _project_cold(cold, event, value, upper, target, out)
    if big is None:
        return got
    return got.unionByName(_project_hot(big, event, value, upper, target, out, hot))


def reconcile(df: DataFrame, event: str, win: str = "p_win", podium: str = "p_podium",
              points: str = "p_points", hot: HotGroups | None = None) -> DataFrame:
    """Replace the three probabilities by nested ones whose sums are min(quota, field size).

    ``event`` may be a composite: pass a struct column. Ordinary events take one shuffle in all.
    """
    hot = find_hot(df, [event]) if hot is None else hot
    low, mid, high = monotone_row(win, podium, points)
    keep = [c for c in df.columns if c not in (win, podium, points)]
    base = df.select(*keep, low.alias(win), mid.alias(podium), high.alias(points))
    cold, big = split_hot(base, hot)

    def project(part, sizes, step):
        d = sizes(part).withColumn("_one", F.lit(1.0))
        for name, p, upper in (("points", points, "_one"), ("podium", podium, points), ("win", win, podium)):
            d = d.withColumn("_quota", F.least(F.lit(QUOTAS[name]), F.col("_size")))
            d = step(d, p, upper)
        return d.select(*df.columns)

    got = project(
        cold, lambda d: d.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(event))),
        lambda d, p, u: _project_cold(d, event, p, u, "_quota", p))
    if big is None:
        return got
    exact = big.groupBy(event).agg(F.count(F.lit(1)).alias("_size"))
    return got.unionByName(project(
        big, lambda d: join_same(d, exact, [event], small=True),
        lambda d, p, u: materialize(_project_hot(d, event, p, u, "_quota", p, hot))))
