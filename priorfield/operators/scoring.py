"""Batch scoring through named stages, and scoring of stored forecasts after the event."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .hot import HotGroups, find_hot
from .metrics import log_loss_row
from .reconcile import reconcile
from .rollups import null_profile
from .windows import attach_group, rank_first

STAGES = ("raw", "calibrated", "rank_calibrated", "blended", "reconciled")  # fixed values
ROLES = ("win", "podium", "points")


def score_stages(df: DataFrame, event: str, raw: dict[str, str], calibrated: dict[str, Column], ranked: dict[str, Column],
                 alpha: float, keep, hot: HotGroups | None = None) -> DataFrame:
    """Long table with one row per (entry, stage): raw, calibrated, rank-calibrated, blended and
    reconciled probabilities. The maps go from role to column or expression."""
    d = df.select(*keep, *[F.col(raw[r]).alias(f"raw_{r}") for r in ROLES],
                  *[calibrated[r].alias(f"calibrated_{r}") for r in ROLES],
                  *[ranked[r].alias(f"rank_calibrated_{r}") for r in ROLES])
    for r in ROLES:
        blend = (1 - F.lit(alpha)) * F.col(f"calibrated_{r}") + F.lit(alpha) * F.col(f"rank_calibrated_{r}")
        d = d.withColumn(f"blended_{r}", blend).withColumn(f"reconciled_{r}", F.col(f"blended_{r}"))
    d = reconcile(d, event, *[f"reconciled_{r}" for r in ROLES], hot=hot)
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), *[F.col(f"{s}_{r}").alias(f"p_{r}") for r in ROLES]) for s in STAGES])
    return d.select(*keep, F.explode(stages).alias("_s")).select(*keep, "_s.*")


def predicted_order(df: DataFrame, event: str, score: str, tiebreak, hot: HotGroups | None = None, out: str = "predicted_order") -> DataFrame:
    return rank_first(df, event, [score, *tiebreak], out, hot)


def combine_families(long: DataFrame, selection: DataFrame, keys, target: str = "target", method: str = "method",
                     name: str = "selected_combination") -> DataFrame:
    """Add a method that takes, per target, the family named in the selection table (one row per target)."""
    picked = long.join(F.broadcast(selection), [target, method], "left_semi").withColumn(method, F.lit(name))
    return long.unionByName(picked)


def batch_quality(df: DataFrame, entrant: str, history: DataFrame, features) -> DataFrame:
    """Null counts per feature and the number of first-time entrants, as (item, amount)."""
    nulls = null_profile(df, features).select(F.concat(F.lit("null:"), "column").alias("item"), F.col("nulls").alias("amount"))
    new = df.select(entrant).distinct().join(history.select(entrant).distinct(), entrant, "left_anti")
    return nulls.unionByName(new.agg(F.lit("first_time_entrants").alias("item"), F.count(F.lit(1)).alias("amount")))


def favourites(long: DataFrame, by, entrant: str, p: str, order: str) -> DataFrame:
    """Entrant with the highest probability against the one ranked first, per group."""
    return long.groupBy(*by).agg(
        F.max_by(entrant, F.struct(F.col(p), -F.col(entrant))).alias("favourite"),
        F.min_by(entrant, F.struct(order, entrant)).alias("ranked_first"),
    ).withColumn("agree", (F.col("favourite") == F.col("ranked_first")).cast("int"))


def roster_gaps(long: DataFrame, outcomes: DataFrame, event: str, entrant: str, hot: HotGroups | None = None) -> DataFrame:
    """Where a forecast and the outcomes of its event name different entrants, or one name twice:
    event, method, stage, forecast rows, outcome rows and rows found on both sides.

    Both sides are stacked and compared inside the event, so sides dealt alike by event are not shuffled again."""
    hot = find_hot(outcomes, [event]) if hot is None else hot
    both = long.select(event, "method", "stage", entrant, F.lit(0).alias("_o")).unionByName(
        outcomes.select(event, entrant, F.lit(1).alias("_o")), allowMissingColumns=True)
    both = attach_group(both, [event, entrant], hot, _sides=F.sum("_o"))
    both = attach_group(both, [event], hot, outcome_rows=F.sum("_o")).filter(F.col("_o") == 0)
    got = both.groupBy(event, "method", "stage").agg(
        F.count(F.lit(1)).alias("forecast_rows"), F.count(F.when(F.col("_sides") == 1, F.lit(1))).alias("common_rows"),
        F.count_distinct(F.struct(entrant)).alias("_entrants"), F.first("outcome_rows").alias("outcome_rows"))
    wrong = (F.col("forecast_rows") != F.col("common_rows")) | (F.col("outcome_rows") != F.col("common_rows")) | (F.col("_entrants") != F.col("forecast_rows"))
    return got.filter(wrong).drop("_entrants")


def score_forecasts(long: DataFrame, outcomes: DataFrame, event: str, entrant: str, hot: HotGroups | None = None,
                    strict: bool = True) -> DataFrame:
    """One row per (event, method, stage): losses per target and the ranking measures.

    Forecast and outcomes of an event must name the same entrants; ``strict`` stops otherwise,
    else entrants on one side only are left out.

    ``long``: event, method, stage, entrant, predicted_order, p_win, p_podium, p_points.
    ``outcomes``: event, entrant, finish_order, position, points.
    """
    hot = find_hot(outcomes, [event]) if hot is None else hot
    if strict:
        bad = roster_gaps(long, outcomes, event, entrant, hot).limit(5).collect()
        if bad:
            raise ValueError(f"forecast and outcomes name different entrants, first cases: {bad}")
    o = attach_group(outcomes, [event], hot, _n=F.count(F.lit(1)))
    o = o.select(event, entrant, F.struct(
        "finish_order", "_n", F.coalesce(F.col("position") == 1, F.lit(False)).cast("int").alias("win"),
        F.coalesce(F.col("position") <= 3, F.lit(False)).cast("int").alias("podium"),
        F.coalesce(F.col("points") > 0, F.lit(False)).cast("int").alias("points")).alias("_out"))
    # every forecast row meets the outcomes of its entrant inside the event, as in a join
    d = long.select(event, "method", "stage", entrant, "predicted_order", *[f"p_{r}" for r in ROLES], F.lit(1).alias("_forecast")).unionByName(
        o, allowMissingColumns=True)
    d = attach_group(d, [event, entrant], hot, _outs=F.collect_list("_out")).filter(F.col("_forecast") == 1).drop("_out", "_forecast")
    d = d.select("*", F.explode("_outs").alias("_out")).select(event, "method", "stage", entrant, "predicted_order", *[f"p_{r}" for r in ROLES], "_out.*")
    off = (F.col("predicted_order") - F.col("finish_order")).cast("double")
    n = F.max("_n").cast("double")
    aggs = []
    for r in ROLES:
        aggs += [F.avg(log_loss_row(r, f"p_{r}")).alias(f"{r}_log_loss"), F.avg(F.pow(F.col(f"p_{r}") - F.col(r), 2)).alias(f"{r}_brier")]
    hit = F.sum(((F.col("predicted_order") <= 3) & (F.col("podium") == 1)).cast("int"))
    return d.groupBy(event, "method", "stage").agg(
        *aggs, F.avg(F.abs(off)).alias("mae"),
        (1 - F.try_divide(6 * F.sum(off * off), n * (n * n - 1))).alias("spearman"),
        F.max(((F.col("predicted_order") == 1) & (F.col("win") == 1)).cast("int")).alias("winner_top1"),
        F.try_divide(hit, F.sum("podium")).alias("podium_overlap"))


def search_forecast(df: DataFrame, query: str, fields, sort: str, entrant: str) -> DataFrame:
    """Rows whose name or group contains the text, whatever the case, best first or in order."""
    hit = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in fields])).contains(query.lower())
    keys = [F.asc_nulls_last(sort), F.col(entrant)] if sort == "predicted_order" else [F.desc_nulls_last(sort), F.col(entrant)]
    return df.filter(hit).orderBy(*keys)


def stack_methods(frames: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [d.withColumn("method", F.lit(m)) for m, d in frames.items()])


def pivot_methods(long: DataFrame, keys, method: str, methods, values) -> DataFrame:
    """Wide prediction table: one column per method and value. One grouping by the keys, whose deal it keeps."""
    return long.groupBy(*keys).agg(*[F.first(F.when(F.col(method) == m, F.col(v)), ignorenulls=True).alias(f"{m}_{v}")
                                     for m in methods for v in values])
