"""Point-in-time operators: what was known strictly before a cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .hot import HotGroups, find_hot, join_same
from .joins import anti, table_diff
from .windows import attach_group, last_per, latest, prior_features, rank_first


def asof_features(entries: DataFrame, history: DataFrame, keysets, order, cutoff: str,
                  hot: HotGroups | None = None) -> DataFrame:
    """For each entry: the history features of its keys over rows dated before its cutoff.

    The state after every history row is computed first; then entries and history are put in
    one order and each entry takes the latest state. Entries never count as history, so any
    number of cutoffs is served at once. ``order`` starts with the history's date.
    """
    if hot is None:
        history = materialize(history)  # counted first, then read again
        hot = find_hot(history, keysets[0][0])
    date, *rest = order
    after = prior_features(history, keysets, order, hot, inclusive=True, dealt=False)
    states = {f"_state{i}": F.struct(*[s.out for s in specs]) for i, (_, specs) in enumerate(keysets)}
    keys = list(dict.fromkeys(k for ks, _ in keysets for k in ks))
    past = after.select(*keys, F.col(date).alias("_at"), F.lit(1).alias("_kind"), *[F.col(c).alias(f"_t_{c}") for c in rest],
                        *[s.alias(n) for n, s in states.items()])
    if hot:
        past = materialize(past)  # rows of large keys and all others are read apart
    ask = entries.select("*", F.col(cutoff).alias("_at"), F.lit(0).alias("_kind"))
    both = past.unionByName(ask, allowMissingColumns=True)
    sets = [(ks, [latest(f"_got{i}", f"_state{i}")]) for i, (ks, _) in enumerate(keysets)]
    line = ["_at", "_kind", *[f"_t_{c}" for c in rest]]
    got = prior_features(both, sets, line, hot, dealt=False).filter(F.col("_kind") == 0)
    outs = []
    for i, (_, specs) in enumerate(keysets):
        for s in specs:
            v = F.col(f"_got{i}.{s.out}")
            outs.append((F.coalesce(v, F.lit(0)) if s.kind in ("count", "sum") else v).alias(s.out))
    return got.select(*entries.columns, *outs)


def completed_before(events: DataFrame, event: str, date: str, cutoff, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Cut every table to events dated strictly before the cutoff."""
    kept = events.filter(F.col(date) < cutoff)
    out = {"events": kept}
    for name, child in children.items():
        out[name] = child.join(kept.select(event), event, "left_semi")
    return out


def same_day_conflicts(events: DataFrame, results: DataFrame, event: str, date: str, cutoff) -> DataFrame:
    """Events on the cutoff day that already have results: ambiguous, must be rejected."""
    return events.filter(F.col(date) == cutoff).join(results.select(event), event, "left_semi").select(event)


def missing_history(events: DataFrame, results: DataFrame, event: str, date: str, cutoff) -> DataFrame:
    """Earlier scheduled events without results."""
    return anti(events.filter(F.col(date) < cutoff).select(event), results.select(event), [event])


def standings_gap(events: DataFrame, standings: DataFrame, event: str, season: str, order) -> DataFrame:
    """Seasons whose latest completed event has no standings."""
    final = last_per(events, [season], list(order)).select(season, event)
    return anti(final, standings.select(event), [event])


def latest_standing(standings: DataFrame, events: DataFrame, event: str, season: str, order, on) -> DataFrame:
    """Standing after the last event of each season."""
    final = last_per(events, [season], list(order)).select(season, event)
    return standings.join(final.select(event, season), event)


def missingness(df: DataFrame, keys, features, reason: Column) -> DataFrame:
    """One row per (entrant, feature) that is null, with the reason. ``reason`` may use ``feature``."""
    cells = F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in features])
    return df.select(*keys, F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("feature")).withColumn("reason", reason)


def attach_outcomes(entries: DataFrame, results: DataFrame, keys, status: str, order: str, withdrawn: str,
                    non_start=("DNS",)) -> DataFrame:
    """Labels for the announced field: non-starters and withdrawals keep no order."""
    d = join_same(entries, results, list(keys), "left")
    started = F.col(status).isNotNull() & ~F.col(status).isin(*non_start) & (F.coalesce(F.col(withdrawn), F.lit(0)) == 0)
    return d.withColumn("ranking_available", F.coalesce(started, F.lit(False)).cast("int")).withColumn(
        order, F.when(F.col("ranking_available") == 1, F.col(order)))


def apply_eligibility(df: DataFrame, audit: DataFrame, keys, display_order: str, event: str, entrant: str,
                      hot: HotGroups | None = None) -> DataFrame:
    """Default eligible; audited rows take the audit's decision; order is re-ranked among eligible."""
    a = audit.select(*keys, F.col("prediction_eligible").cast("int").alias("_e"), F.col("reason").alias("_r"))
    d = join_same(df, a, list(keys), "left")
    d = d.withColumn("prediction_eligible", F.coalesce(F.col("_e"), F.lit(1)))
    d = d.withColumn("eligibility_reason", F.coalesce(F.col("_r"), F.lit("present_in_final_slot_source"))).drop("_e", "_r")
    d = d.withColumn("_out", 1 - F.col("prediction_eligible"))
    d = rank_first(d, event, ["_out", display_order, entrant], "_rank", hot)
    return d.withColumn("finish_order", F.when(F.col("prediction_eligible") == 1, F.col("_rank"))).drop("_out", "_rank")


def eligibility_gaps(df: DataFrame, audit: DataFrame, keys, has_record: str) -> DataFrame:
    """Rows without a slot record and without a decision, and decisions without such a row."""
    open_rows = df.filter(F.col(has_record) == 0).select(*keys)
    return anti(open_rows, audit.select(*keys), keys).withColumn("gap", F.lit("unresolved")).unionByName(
        anti(audit.select(*keys), open_rows, keys).withColumn("gap", F.lit("not_open")))


def lineage_profile(profile: DataFrame, lineage: DataFrame) -> DataFrame:
    """Column profile with its availability class and source; both have one row per column."""
    return profile.join(F.broadcast(lineage), "column", "left")


def class_counts(profile: DataFrame) -> DataFrame:
    return profile.groupBy("availability").agg(F.count(F.lit(1)).alias("columns"), F.sum("nulls").alias("nulls"))


def leakage_probe(build, history: DataFrame, changed: DataFrame, keys, features, upto: Column) -> DataFrame:
    """Features up to an event that move when outcomes at and after it change (expected: none)."""
    return table_diff(build(history).filter(upto), build(changed).filter(upto), keys, features)


def later_outcomes_changed(df: DataFrame, date: str, start, **new: Column) -> DataFrame:
    for c, e in new.items():
        df = df.withColumn(c, F.when(F.col(date) >= start, e).otherwise(F.col(c)))
    return df


def event_size(df: DataFrame, event: str, out: str = "field_size", hot=None) -> DataFrame:
    return attach_group(df, [event], hot, **{out: F.count(F.lit(1))})
