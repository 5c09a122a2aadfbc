"""Baseline scores and probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .hot import HotGroups, find_hot, join_same
from .reconcile import QUOTAS, reconcile
from .windows import attach_group, rank_first

TEMPERATURES = {"win": 0.65, "podium": 1.5, "points": 4.0}  # fixed values


def slot_score(slot, qualifying, size) -> Column:
    """Start slot, else qualifying place, else one behind the field."""
    return F.coalesce(F.col(slot).cast("double"), F.col(qualifying).cast("double"), F.col(size) + F.lit(1.0))


def qualifying_score(slot, qualifying, size) -> Column:
    return F.coalesce(F.col(qualifying).cast("double"), slot_score(slot, qualifying, size))


def form_score(slot_normalised, recent, slot, standing, size) -> Column:
    """0.6 slot + 0.25 recent finish + 0.15 standing, each relative to the field size."""
    n = F.col(size).cast("double")
    a = F.coalesce(F.col(slot_normalised), F.lit(1.0))
    b = F.coalesce(F.col(recent).cast("double"), F.col(slot).cast("double"), n) / n
    c = F.coalesce(F.col(standing).cast("double"), n) / n
    return 0.6 * a + 0.25 * b + 0.15 * c


def quota_probabilities(df: DataFrame, event: str, score: str, hot: HotGroups | None = None) -> DataFrame:
    """Softmax of the score in the event, scaled to each quota, then reconciled."""
    hot = find_hot(df, [event]) if hot is None else hot
    d = attach_group(df, [event], hot, _best=F.min(score), _size=F.count(F.lit(1)))
    for role, t in TEMPERATURES.items():
        x = -(F.col(score) - F.col("_best")) / F.lit(t)
        d = d.withColumn(f"_e_{role}", F.exp(F.least(F.greatest(x, F.lit(-30.0)), F.lit(30.0))))
    d = attach_group(d, [event], hot, **{f"_t_{r}": F.sum(f"_e_{r}") for r in TEMPERATURES})
    for role, quota in QUOTAS.items():
        raw = F.col(f"_e_{role}") / F.col(f"_t_{role}") * F.least(F.lit(quota), F.col("_size"))
        d = d.withColumn(f"p_{role}", F.least(F.greatest(raw, F.lit(1e-8)), F.lit(1 - 1e-8)))
    d = d.select(*df.columns, *[f"p_{r}" for r in QUOTAS])
    return reconcile(d, event, hot=hot)


def uniform_probabilities(df: DataFrame, event: str, hot: HotGroups | None = None) -> DataFrame:
    return quota_probabilities(df.withColumn("_zero", F.lit(0.0)), event, "_zero", hot).drop("_zero")


def smoothed_rates(train: DataFrame, key: str, targets: dict[str, str], weight: float) -> DataFrame:
    """Per key value: (positives + weight * prior) / (rows + weight) for each target."""
    prior = train.agg(*[F.avg(F.col(y).cast("double")).alias(p) for p, y in targets.items()]).first()
    c = train.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(y).alias(p) for p, y in targets.items()])
    return c.select(key, *[((F.col(p) + weight * F.lit(prior[p])) / (F.col("_n") + weight)).alias(p) for p in targets])


def rate_probabilities(train: DataFrame, df: DataFrame, key: str, targets: dict[str, str], weight: float) -> DataFrame:
    """Look the smoothed rate up; unseen keys get the prior. ``targets``: output -> label."""
    prior = train.agg(*[F.avg(F.col(y).cast("double")).alias(p) for p, y in targets.items()]).first()
    rates = smoothed_rates(train, key, targets, weight)
    d = join_same(df, rates, [key], "left")
    for p in targets:
        d = d.withColumn(p, F.coalesce(F.col(p), F.lit(prior[p])))
    return d


def prior_rate(train: DataFrame, df: DataFrame, targets: dict[str, str]) -> DataFrame:
    prior = train.agg(*[F.avg(F.col(y).cast("double")).alias(p) for p, y in targets.items()]).first()
    return df.select("*", *[F.lit(prior[p]).alias(p) for p in targets])


def recent_form(entrant_recent, group_recent) -> Column:
    """Higher is better: minus the recent finish of the entrant, else of its group, else 30."""
    return -F.coalesce(F.col(entrant_recent), F.col(group_recent), F.lit(30.0))


def group_form(group_points, entrant_points) -> Column:
    return F.coalesce(F.col(group_points), F.lit(0.0)) + 0.5 * F.coalesce(F.col(entrant_points), F.lit(0.0))


def rank_rate(train: DataFrame, df: DataFrame, event: str, entrant: str, score: str, targets: dict[str, str]) -> DataFrame:
    """Rank by descending score in the event, then the smoothed rate of that rank (20 rows)."""
    def ranked(d):
        d = d.withColumn("_down", -F.col(score))
        return rank_first(d, event, ["_down", entrant], "rank", None).drop("_down")

    return rate_probabilities(ranked(train), ranked(df), "rank", targets, 20.0)
