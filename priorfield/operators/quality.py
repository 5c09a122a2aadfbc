"""Data-quality rules. Every rule gives rows (rule, key, detail); none means the data is sound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .joins import RuleViolation, key_diff

SCHEMA = "rule string, key string, detail string"


def report(df: DataFrame, rule: str, key, detail) -> DataFrame:
    k = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    d = detail if isinstance(detail, Column) else F.lit(detail)
    return df.select(F.lit(rule).alias("rule"), k.alias("key"), d.cast("string").alias("detail"))


def strict(*violations: DataFrame) -> None:
    for v in violations:
        first = v.limit(5).collect()
        if first:
            raise RuleViolation("; ".join(f"{r['rule']} {r['key']}: {r['detail']}" for r in first))


def check_columns(df: DataFrame, required, exact: bool = False) -> DataFrame:
    """Required columns present; with ``exact`` also their order."""
    spark: SparkSession = df.sparkSession
    rows = [("columns", c, "missing") for c in required if c not in df.columns]
    if exact and not rows and list(df.columns) != list(required):
        rows = [("columns", "", "order differs")]
    return spark.createDataFrame(rows, SCHEMA)


def check_unique(df: DataFrame, keys) -> DataFrame:
    d = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return report(d, "unique", keys, F.concat(F.col("n").cast("string"), F.lit(" copies")))


def check_not_null(df: DataFrame, key, cols) -> DataFrame:
    cells = F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols])
    d = df.select(*key, F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("_c"))
    return report(d, "not_null", key, F.col("_c"))


def check_agreement(df: DataFrame, other: DataFrame, keys, cols) -> DataFrame:
    """Columns that differ between two tables on matching keys."""
    o = other.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in cols])
    wrong = F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_o_{c}")), F.lit(c)) for c in cols])
    d = df.select(*keys, *cols).join(o, list(keys)).select(*keys, F.explode(F.filter(wrong, lambda x: x.isNotNull())).alias("_c"))
    return report(d, "agreement", keys, F.col("_c"))


def check_event_counts(df: DataFrame, event: str, expected: dict[str, int]) -> DataFrame:
    """Exactly the stated number of flagged rows per event (one winner, three on the podium)."""
    d = df.groupBy(event).agg(*[F.sum(c).alias(c) for c in expected])
    wrong = reduce(lambda a, b: a | b, [F.col(c) != n for c, n in expected.items()])
    text = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in expected])
    return report(d.filter(wrong), "event_counts", [event], text)


def check_contiguous(df: DataFrame, event: str, order: str) -> DataFrame:
    """The order of an event is 1..n: no nulls, no repeats, largest equals count."""
    d = df.groupBy(event, order).agg(F.count(F.lit(1)).alias("_c")).groupBy(event).agg(
        F.sum("_c").alias("n"), F.max(order).alias("top"), F.min(order).alias("low"),
        F.max("_c").alias("copies"), F.sum(F.col(order).isNull().cast("int")).alias("nulls"))
    bad = ~((F.col("top") == F.col("n")) & (F.col("low") == 1) & (F.col("copies") == 1) & (F.col("nulls") == 0))
    return report(d.filter(F.coalesce(bad, F.lit(True))), "contiguous", [event], "order is not 1..n")


def check_splits(df: DataFrame, split: str, event: str, date: str, chain) -> DataFrame:
    """Each event in one split; splits follow each other in time."""
    e = df.groupBy(event).agg(F.min(split).alias("_a"), F.max(split).alias("_b")).filter(F.col("_a") != F.col("_b"))
    ends = df.groupBy(split).agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    out = report(e, "split_disjoint", [event], "event in two splits")
    for a, b in zip(chain, chain[1:]):
        x = ends.filter(F.col(split) == a).select(F.lit(1).alias("_j"), F.col("hi"))
        y = ends.filter(F.col(split) == b).select(F.lit(1).alias("_j"), F.col("lo"), split)
        late = x.join(y, "_j").filter(F.col("hi") >= F.col("lo"))
        out = out.unionByName(report(late, "split_order", [split], f"starts before {a} ends"))
    return out


def check_probability(df: DataFrame, key, cols) -> DataFrame:
    def bad(c):
        p = F.col(c)
        return p.isNull() | F.isnan(p) | (p < 0) | (p > 1)

    cells = F.array(*[F.when(bad(c), F.lit(c)) for c in cols])
    d = df.select(*key, F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("_c"))
    return report(d, "probability", key, F.col("_c"))


def check_official(df: DataFrame, event: str, entrant: str, position: str) -> DataFrame:
    """One winner, three podium rows, distinct whole positions."""
    p = F.col(position).cast("double")
    flags = df.select(event, (p == 1).cast("int").alias("winner"), (p <= 3).cast("int").alias("podium"))
    flags = flags.na.fill(0)
    ranked = df.filter(p.isNotNull())
    odd = ranked.filter((p % 1 != 0) | (p < 1))
    return (check_event_counts(flags, event, {"winner": 1, "podium": 3})
            .unionByName(check_unique(ranked, [event, position]))
            .unionByName(report(odd, "whole_position", [event, entrant], "position is not a whole number from 1")))


def check_entries(df: DataFrame, event: str, entrant: str, slot: str, pit: str, penalty: str, has_penalty: str, times) -> DataFrame:
    """Unique entrant and slot, slot excludes the pit lane, penalty flag agrees, times positive."""
    both = df.filter(F.col(slot).isNotNull() & (F.col(pit) == 1))
    pen = df.filter((F.coalesce(F.col(penalty), F.lit(0)) > 0) & (F.coalesce(F.col(has_penalty), F.lit(0)) == 0))
    neg = df.filter(reduce(lambda a, b: a | b, [F.coalesce(F.col(t) <= 0, F.lit(False)) for t in times]))
    key = [event, entrant]
    return (check_unique(df, key).unionByName(check_unique(df.filter(F.col(slot).isNotNull()), [event, slot]))
            .unionByName(report(both, "slot_or_pit", key, "slot and pit lane"))
            .unionByName(report(pen, "penalty", key, "positions without a penalty"))
            .unionByName(report(neg, "positive_time", key, "time is not positive")))


def check_chronology(df: DataFrame, key, times) -> DataFrame:
    """The given times do not run backwards; missing ones are skipped."""
    wrong = F.array(*[F.when(F.col(a) > F.col(b), F.lit(f"{a}>{b}")) for a, b in zip(times, times[1:])])
    d = df.select(*key, F.explode(F.filter(wrong, lambda x: x.isNotNull())).alias("_c"))
    return report(d, "chronology", key, F.col("_c"))


def check_cutoff(df: DataFrame, key, first_session: str, cutoff: str) -> DataFrame:
    d = df.filter(~F.col(cutoff).eqNullSafe(F.col(first_session) - F.expr("INTERVAL 24 HOURS")))
    return report(d, "cutoff", key, "cutoff is not 24 h before the first session")


def check_roster(entries: DataFrame, event: str, entrant: str, status: str, evidence: str, reason: str) -> DataFrame:
    """Announced entries need evidence; withdrawals need evidence and a reason; no other status."""
    some = F.size(F.coalesce(F.col(evidence), F.array().cast("array<string>"))) > 0
    bad = (F.when(~F.col(status).isin("announced", "withdrawn") | F.col(status).isNull(), "unknown status")
           .when(~some, "no evidence").when((F.col(status) == "withdrawn") & F.col(reason).isNull(), "withdrawal without a reason"))
    return report(entries.withColumn("_b", bad).filter(F.col("_b").isNotNull()), "roster", [event, entrant], F.col("_b"))


def check_mapping(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key has one value (a group's engine, a season's rule)."""
    d = df.groupBy(key).agg(F.min(value).alias("_a"), F.max(value).alias("_b")).filter(F.col("_a") != F.col("_b"))
    return report(d, "mapping", [key], f"several values of {value}")


def check_forecast(long: DataFrame, roster: DataFrame, snapshot: str, method: str, entrant: str, stage: str,
                   win: str, podium: str, points: str, order: str, order_only=(), tolerance: float = 1e-6) -> DataFrame:
    """Roster match, order is a permutation, nested p in [0,1], quota sums, order-only methods carry no p.

    ``long``: one row per (snapshot, method, stage, entrant); order-only methods have a null stage.
    """
    key = [snapshot, method, stage]
    out = [check_contiguous(long.withColumn("_g", F.concat_ws("|", *key)), "_g", order)]
    carries = long.filter(F.col(method).isin(*order_only) & (F.col(win).isNotNull() | F.col(podium).isNotNull() | F.col(points).isNotNull())) if order_only else None
    if carries is not None:
        out.append(report(carries, "order_only", [*key, entrant], "carries a probability"))
    p = long.filter(~F.col(method).isin(*order_only)) if order_only else long
    out.append(check_probability(p, [*key, entrant], [win, podium, points]))
    nest = p.filter((F.col(win) > F.col(podium) + tolerance) | (F.col(podium) > F.col(points) + tolerance))
    out.append(report(nest, "nested", [*key, entrant], "probabilities do not nest"))
    s = p.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in (win, podium, points)])
    off = reduce(lambda a, b: a | b, [F.abs(F.col(f"s_{c}") - F.least(F.lit(q), F.col("n"))) > tolerance
                                      for c, q in ((win, 1), (podium, 3), (points, 10))])
    out.append(report(s.filter(off), "quota", key, "sum differs from the quota"))
    miss = key_diff(roster, long, [snapshot, entrant])
    out.append(report(miss, "roster_match", [snapshot, entrant], F.col("side")))
    return reduce(lambda a, b: a.unionByName(b), out)


def check_outcomes(outcomes: DataFrame, roster: DataFrame, event: str, entrant: str, order: str, position: str, points: str) -> DataFrame:
    """Complete roster, order 1..n, points >= 0, unique positions, one official winner."""
    key = [event, entrant]
    neg = outcomes.filter(F.col(points).isNull() | (F.col(points) < 0))
    flags = outcomes.select(event, F.coalesce((F.col(position) == 1).cast("int"), F.lit(0)).alias("winner"))
    return (check_contiguous(outcomes, event, order)
            .unionByName(report(neg, "points", key, "points missing or negative"))
            .unionByName(check_unique(outcomes.filter(F.col(position).isNotNull()), [event, position]))
            .unionByName(check_event_counts(flags, event, {"winner": 1}))
            .unionByName(report(key_diff(roster, outcomes, key), "roster_match", key, F.col("side"))))


#: Kinds of documents that may speak for an entry.
ENTRY_KINDS = ("entry_list", "season_registration", "event_lineup", "withdrawal")


def check_evidence(entries: DataFrame, evidence: DataFrame, event: str, entrant: str, group: str, status: str, kind: str) -> DataFrame:
    """Documents behind each entry: an entry list, or a registration and a lineup, for this entrant and group; a withdrawal
    document exactly for withdrawn entries; no other kinds; at least one announced entry an event.

    Documents of the entrant under another group do not count; a null kind is an unknown kind.
    """
    keys = [event, entrant, group]
    has = {k: F.max((F.col(kind) == k).cast("int")) for k in ENTRY_KINDS}
    held = evidence.groupBy(*keys).agg(*[F.coalesce(e, F.lit(0)).alias(f"_{k}") for k, e in has.items()])  # few rows a key: combined before the shuffle
    d = entries.select(*keys, status).join(held, keys, "left").na.fill(0, [f"_{k}" for k in ENTRY_KINDS])
    known = (F.col("_entry_list") == 1) | ((F.col("_season_registration") == 1) & (F.col("_event_lineup") == 1))
    agrees = F.coalesce(F.col(status) == "withdrawn", F.lit(False)) == (F.col("_withdrawal") == 1)
    odd = evidence.filter(F.col(kind).isNull() | ~F.col(kind).isin(*ENTRY_KINDS))
    none = entries.groupBy(event).agg(F.coalesce(F.max((F.col(status) == "announced").cast("int")), F.lit(0)).alias("_n")).filter("_n = 0")
    return (report(d.filter(~known), "evidence", [event, entrant], "neither entry list nor registration with lineup")
            .unionByName(report(d.filter(~agrees), "withdrawal", [event, entrant], "status and withdrawal document disagree"))
            .unionByName(report(odd, "evidence_kind", [event, entrant], F.coalesce(F.col(kind), F.lit("unknown"))))
            .unionByName(report(none, "announced", [event], "no announced entry")))


def check_outcome_field(field: DataFrame, results: DataFrame, withdrawals: DataFrame, event: str, entrant: str, group: str, state: str, position: str,
                        points: str, published: str, cutoff: str, non_start=("DNS",)) -> DataFrame:
    """Results for the announced field: each entry has a result of its group, or a withdrawal of its group published after the cutoff;
    non-starters have neither position nor points; points are not negative; every withdrawal is used, once.

    ``field`` has the cutoff, ``withdrawals`` the publication time. Null points count as none.
    """
    key = [event, entrant]
    r = results.select(*key, F.col(group).alias("_group"), state, position, points, F.lit(1).alias("_has"))
    late = withdrawals.groupBy(*key, group).agg(F.max(published).alias("_published"))
    d = field.select(*key, group, cutoff).join(r, key, "left").join(late, [*key, group], "left")
    here = F.col("_has").isNotNull()
    gone = F.coalesce(F.col("_published") > F.col(cutoff), F.lit(False))
    amount = F.coalesce(F.col(points).cast("double"), F.lit(0.0))
    idle = F.coalesce(F.col(state).isin(*non_start), F.lit(False)) & (F.col(position).isNotNull() | (amount != 0))
    unused = withdrawals.join(d.filter(~here).select(*key, group), [*key, group], "left_anti")
    return (report(d.filter(~here & ~gone), "missing_result", key, "no result and no withdrawal after the cutoff")
            .unionByName(report(d.filter(here & ~F.col("_group").eqNullSafe(F.col(group))), "group", key, "result of another group"))
            .unionByName(report(d.filter(here & idle), "non_start", key, "non-starter with position or points"))
            .unionByName(report(d.filter(here & ((amount < 0) | F.isnan(amount))), "points", key, "points are negative or no number"))
            .unionByName(report(unused, "unused_withdrawal", key, "withdrawal without a missing result"))
            .unionByName(check_unique(withdrawals, key)))


def check_schedule(schedule: DataFrame, calendar: DataFrame, event: str, scope, start: str, date: str) -> DataFrame:
    """Schedules agree with the calendar: the event is in it once, every scope column is equal, and the start, where given, is on its date."""
    other = calendar.groupBy(event).agg(F.count(F.lit(1)).alias("_rows"), *[F.min(c).alias(f"_o_{c}") for c in scope], F.min(date).alias("_date"))
    d = schedule.select(event, *scope, start).join(other, event, "left")
    once = F.coalesce(F.col("_rows") == 1, F.lit(False))
    wrong = F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_o_{c}")), F.lit(c)) for c in scope],
                    F.when(F.to_date(start) != F.to_date("_date"), F.lit(start)))
    cells = d.filter(once).select(event, F.explode(F.filter(wrong, lambda x: x.isNotNull())).alias("_c"))
    return report(d.filter(~once), "schedule", [event], "event unknown or repeated in the calendar").unionByName(report(cells, "schedule", [event], F.col("_c")))


def check_outcome_times(outcomes: DataFrame, key, start: str, completed: str, retrieved: str, reviewer: str, provider: str, providers) -> DataFrame:
    """An outcome is complete after the start, retrieved no earlier than complete, reviewed, and of an accepted provider; missing times fail."""
    bad = {"not complete after the start": F.col(completed) > F.col(start), "retrieved before complete": F.col(retrieved) >= F.col(completed),
           "no reviewer": F.length(F.trim(F.col(reviewer))) > 0, "provider not accepted": F.col(provider).isin(*providers)}
    cells = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for text, ok in bad.items()])
    d = outcomes.select(*key, F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("_c"))
    return report(d, "outcome_times", key, F.col("_c"))
