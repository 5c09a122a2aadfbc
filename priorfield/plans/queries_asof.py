"""Point-in-time operators on the order tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import asof, joins, rollups, windows as w
from ..operators.hot import deal, spread
from ..session import materialize
from .orders import EVENT_ORDER
from .queries_history import STANDINGS_SQL, standings
from .registry import query

CUTOFF = datetime.date(1999, 7, 1)
CUT = "DATE '1999-07-01'"
KEY = ["event_id", "entrant"]


def cutoff():
    return F.lit(CUTOFF)


@query("completed_before", f"SELECT count(DISTINCT event_id) AS events, count(*) AS rows, CAST(sum(points) AS BIGINT) AS points FROM entries WHERE event_date < {CUT}")
def completed_before(t):
    got = asof.completed_before(t.events(), "event_id", "event_date", cutoff(), {"entries": t.entries().select("event_id", "points")})
    return got["entries"].agg(F.count_distinct("event_id").alias("events"), F.count(F.lit(1)).alias("rows"), F.sum("points").alias("points"))


@query("same_day_conflicts", f"SELECT event_id FROM events_t WHERE event_date = {CUT} AND event_id IN (SELECT l_orderkey FROM lineitem)", base="events")
def same_day_conflicts(t):
    return asof.same_day_conflicts(t.events(), t.read("lineitem").select(F.col("l_orderkey").alias("event_id")), "event_id", "event_date", cutoff())


@query("missing_history", f"SELECT event_id FROM events_t WHERE event_date < {CUT} AND event_id NOT IN (SELECT l_orderkey FROM lineitem)", base="events")
def missing_history(t):
    return asof.missing_history(t.events(), t.read("lineitem").select(F.col("l_orderkey").alias("event_id")), "event_id", "event_date", cutoff())


@query("standings_gap", STANDINGS_SQL + """, fin AS (SELECT venue, arg_max(event_id, (event_date, event_id)) AS event_id FROM events_t GROUP BY 1)
  SELECT venue, event_id FROM fin WHERE event_id NOT IN (SELECT event_id FROM st WHERE season_points > 400)""")
def standings_gap(t):
    """Venues whose latest event left nobody with more than 400 points."""
    s = standings(t).filter(F.col("season_points") > 400)
    return asof.standings_gap(t.events().select("venue", "event_date", "event_id"), s, "event_id", "venue", EVENT_ORDER)


STATE = {"n": "count(*)", "points": "CAST(coalesce(sum(points), 0) AS BIGINT)", "avg_finish": "avg(position)"}


@query("asof_entry_features", """, q AS (SELECT s_suppkey AS entrant, CAST(DATE '1996-03-01' + INTERVAL (s_suppkey % 60) MONTH AS DATE) AS cutoff FROM supplier UNION ALL SELECT s_suppkey, DATE '2001-08-05' FROM supplier),
  j AS (SELECT q.entrant, q.cutoff, e.event_id, e.event_date, e.points, e.position, e.season, row_number() OVER (PARTITION BY q.entrant, q.cutoff ORDER BY e.event_date DESC, e.event_id DESC) AS back FROM q LEFT JOIN entries e ON e.entrant = q.entrant AND e.event_date < q.cutoff)
  SELECT entrant, CAST(cutoff AS VARCHAR) AS cutoff, count(event_id) AS n, CAST(coalesce(sum(points), 0) AS BIGINT) AS points, avg(position) AS avg_finish, avg(position) FILTER (back <= 5) AS recent_5, max(position) FILTER (back = 1) AS previous,
    count(event_id) FILTER (season = year(cutoff)) AS season_n, CAST(coalesce(sum(points) FILTER (season = year(cutoff)), 0) AS BIGINT) AS season_points FROM j GROUP BY entrant, cutoff""")
def asof_entry_features(t):
    """Two cutoffs per entrant in one job: career, recent and season history strictly before each."""
    s = t.read("supplier").select(F.col("s_suppkey").alias("entrant"))
    q = s.withColumn("cutoff", F.add_months(F.lit("1996-03-01").cast("date"), (F.col("entrant") % 60).cast("int"))).unionByName(
        s.withColumn("cutoff", F.lit("2001-08-05").cast("date"))).withColumn("season", F.year("cutoff"))
    sets = [(["entrant"], [w.prior_count("n"), w.prior_sum("points_before", "points"), w.prior_mean("avg_finish", "position"),
                           w.prior_rolling_mean("recent_5", "position", 5), w.previous("previous", "position")]),
            (["entrant", "season"], [w.prior_count("season_n"), w.prior_sum("season_points", "points")])]
    h = t.entries().select("entrant", "season", *EVENT_ORDER, "points", "position")
    d = asof.asof_features(q, h, sets, EVENT_ORDER, "cutoff", t.hot_entrant)
    return d.select("entrant", F.col("cutoff").cast("string").alias("cutoff"), "n", F.col("points_before").alias("points"), "avg_finish", "recent_5", "previous", "season_n", "season_points")


@query("asof_group_features", """, q AS (SELECT n_nationkey AS grp, CAST(DATE '1997-01-01' + INTERVAL (n_nationkey) MONTH AS DATE) AS cutoff FROM nation), g AS (SELECT event_id, event_date, grp, sum(points) AS points, count(*) AS entries FROM entries GROUP BY ALL)
  SELECT q.grp, count(event_id) AS events, CAST(coalesce(sum(entries), 0) AS BIGINT) AS entries, CAST(sum(points) AS DOUBLE) / nullif(count(event_id), 0) AS points_per_event FROM q LEFT JOIN g ON g.grp = q.grp AND g.event_date < q.cutoff GROUP BY 1""")
def asof_group_features(t):
    g = rollups.group_event_rollup(t.entries(), "event_id", "grp", ["event_date"], points=F.sum("points"))
    q = t.read("nation").select(F.col("n_nationkey").alias("grp"), F.add_months(F.lit("1997-01-01").cast("date"), F.col("n_nationkey").cast("int")).alias("cutoff"))
    sets = [(["grp"], [w.prior_count("events"), w.prior_sum("all_entries", "entries"), w.prior_sum("all_points", "points")])]
    d = asof.asof_features(q, g, sets, EVENT_ORDER, "cutoff")
    return d.select("grp", "events", F.col("all_entries").alias("entries"), F.try_divide(F.col("all_points").cast("double"), "events").alias("points_per_event"))


@query("asof_venue_features", f""", v AS (SELECT event_id, event_date, venue, min(CASE WHEN win = 1 THEN start_slot END) AS ws FROM entries GROUP BY ALL) SELECT n_nationkey AS venue, count(event_id) AS events, avg(ws) AS avg_winner_slot
  FROM nation LEFT JOIN v ON venue = n_nationkey AND event_date < {CUT} GROUP BY 1""")
def asof_venue_features(t):
    v = rollups.venue_event_rollup(t.entries(), "event_id", "venue", "win", "start_slot", ["event_date"])
    q = t.read("nation").select(F.col("n_nationkey").alias("venue"), cutoff().alias("cutoff"))
    sets = [(["venue"], [w.prior_count("events"), w.prior_mean("avg_winner_slot", "winner_slot")])]
    return asof.asof_features(q, v, sets, EVENT_ORDER, "cutoff").select("venue", "events", "avg_winner_slot")


@query("latest_standings", STANDINGS_SQL + f""", b AS (SELECT * FROM st WHERE event_date < {CUT}) SELECT s_suppkey AS entrant, (SELECT coalesce(max(season_points), 0) FROM b WHERE b.entrant = s_suppkey AND season = 1999) AS season_points,
  (SELECT max(season_points) FROM b WHERE b.entrant = s_suppkey AND season = 1998) AS previous_season_points FROM supplier""")
def latest_standings(t):
    """Standing of this and the previous season at the cutoff; points default to 0 this season only."""
    s = standings(t).filter(F.col("event_date") < cutoff())
    last = w.last_per(s, ["entrant", "season"], EVENT_ORDER)
    d = t.read("supplier").select(F.col("s_suppkey").alias("entrant"))
    a = last.filter(F.col("season") == 1999).select("entrant", "season_points")
    b = last.filter(F.col("season") == 1998).select("entrant", F.col("season_points").alias("previous_season_points"))
    return d.join(a, "entrant", "left").join(b, "entrant", "left").na.fill({"season_points": 0})


@query("season_end_standings", STANDINGS_SQL + """, lst AS (SELECT season, arg_max(event_id, (event_date, event_id)) AS event_id FROM events_t WHERE event_id IN (SELECT l_orderkey FROM lineitem) GROUP BY season)
  SELECT st.event_id, st.entrant, lst.season, st.season_points FROM st JOIN lst ON st.event_id = lst.event_id""")
def season_end_standings(t):
    """Standings after the last event of each season that has results, for every season in the table."""
    done = joins.semi(t.events().select("season", *EVENT_ORDER), t.read("lineitem").select(F.col("l_orderkey").alias("event_id")), ["event_id"])
    s = standings(t).select("event_id", "entrant", "season_points")
    return asof.latest_standing(s, done, "event_id", "season", EVENT_ORDER, ["entrant"])


@query("missingness_ledger", """SELECT event_id, entrant, 'start_slot' AS feature, CASE WHEN flag = 'N' THEN 'not_announced' ELSE 'missing_registry_or_undefined_prior_history' END AS reason FROM entries WHERE start_slot IS NULL UNION ALL
  SELECT event_id, entrant, 'qual_slot', CASE WHEN flag = 'N' THEN 'not_announced' ELSE 'missing_registry_or_undefined_prior_history' END FROM entries WHERE qual_slot IS NULL""")
def missingness_ledger(t):
    why = F.when(F.col("flag") == "N", "not_announced").otherwise("missing_registry_or_undefined_prior_history")
    return asof.missingness(t.entries(), [*KEY, "flag"], ["start_slot", "qual_slot"], why).drop("flag")


@query("attach_outcomes", """SELECT event_id, entrant, CASE WHEN flag = 'A' THEN 'DNS' ELSE flag END AS state, CAST(flag <> 'A' AND disc <> 0 AND status = 'O' AS INTEGER) AS ranking_available,
  CASE WHEN flag <> 'A' AND disc <> 0 AND status = 'O' THEN finish_order END AS finish_order FROM entries WHERE status = 'O'""")
def attach_outcomes(t):
    """Announced field (status O) with results; non-starters and withdrawals keep no order."""
    e = t.entries()
    field = e.filter(F.col("status") == "O").select(*KEY, (F.col("disc") == 0).cast("int").alias("withdrawn"))
    res = e.select(*KEY, F.when(F.col("flag") == "A", "DNS").otherwise(F.col("flag")).alias("state"), "finish_order")
    return asof.attach_outcomes(field, res, KEY, "state", "finish_order", "withdrawn").drop("withdrawn")


@query("apply_eligibility", """, d AS (SELECT *, CASE WHEN flag = 'N' AND start_slot IS NULL THEN 0 ELSE 1 END AS ok FROM entries) SELECT event_id, entrant, ok AS prediction_eligible, CASE WHEN ok = 0 THEN 'not seen before the start' ELSE 'present_in_final_slot_source' END AS eligibility_reason,
  CASE WHEN ok = 1 THEN row_number() OVER (PARTITION BY event_id, ok ORDER BY finish_order) END AS finish_order FROM d""")
def apply_eligibility(t):
    e = t.entries().withColumnRenamed("finish_order", "display_order")
    audit = e.filter((F.col("flag") == "N") & F.col("start_slot").isNull()).select(*KEY, F.lit(False).alias("prediction_eligible"), F.lit("not seen before the start").alias("reason"))
    return asof.apply_eligibility(e, audit, KEY, "display_order", "event_id", "entrant", t.hot_event).select(*KEY, "prediction_eligible", "eligibility_reason", "finish_order")


@query("eligibility_gaps", """SELECT event_id, entrant, 'unresolved' AS gap FROM entries WHERE start_slot IS NULL AND flag <> 'N' UNION ALL SELECT event_id, entrant, 'not_open' FROM entries WHERE start_slot IS NOT NULL AND flag = 'N'""")
def eligibility_gaps(t):
    e = t.entries().withColumn("has", F.col("start_slot").isNotNull().cast("int"))
    return asof.eligibility_gaps(e, e.filter(F.col("flag") == "N"), KEY, "has")


LINEAGE = [("slot", "scheduled", "lines"), ("start_slot", "scheduled", "lines"), ("qual_slot", "scheduled", "lines"), ("qty", "outcome", "lines"), ("position", "outcome", "derived"), ("venue", "event", "orders")]


@query("lineage_profile", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count(*) - count({c}) AS BIGINT) AS nulls, count(DISTINCT {c}) AS distinct_values, '{a}' AS availability, '{s}' AS source FROM entries""" for c, a, s in LINEAGE) + ")")
def lineage_profile(t):
    """Column profile joined to the availability class and source of each feature."""
    lineage = t.spark.createDataFrame(LINEAGE, "column string, availability string, source string")
    return asof.lineage_profile(rollups.distinct_profile(t.entries(), [c for c, _, _ in LINEAGE]), lineage)


@query("availability_counts", "SELECT availability, count(*) AS columns, CAST(sum(nulls) AS BIGINT) AS nulls FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS availability, count(*) - count({c}) AS nulls FROM entries" for c, a, s in LINEAGE) + ") GROUP BY 1")
def availability_counts(t):
    return asof.class_counts(lineage_profile(t))


PROBE = [(["entrant"], [w.prior_count("n"), w.prior_mean("avg_finish", "position"), w.prior_sum("points_before", "points"), w.prior_rolling_mean("recent_5", "position", 5)])]


@query("leakage_probe", f"""SELECT count(*) AS compared, CAST(0 AS BIGINT) AS differ, count(*) FILTER (event_id % 10 = 0) AS planted FROM entries
  WHERE event_date < {CUT} OR event_date = {CUT} AND event_id <= (SELECT min(event_id) FROM entries WHERE event_date = {CUT})""")
def leakage_probe(t):
    """Outcomes at and after the cutoff are changed; features of events up to it must not move."""
    h = t.saved(*KEY, "event_date", "points", "position")
    changed = asof.later_outcomes_changed(h, "event_date", cutoff(), points=F.col("points") + 1000, position=F.lit(99).cast("long"))
    # events of the cutoff day itself may follow each other, so the probe stops at its first one
    day = h.filter(F.col("event_date") == cutoff()).agg(F.min("event_id").alias("first_event")).scalar()
    upto = (F.col("event_date") < cutoff()) | ((F.col("event_date") == cutoff()) & (F.col("event_id") <= day))
    cols = ["n", "avg_finish", "points_before", "recent_5"]
    a, b = (materialize(w.prior_features(d, PROBE, EVENT_ORDER, t.hot_entrant, dealt=False).filter(upto).select(*KEY, *cols)) for d in (h, changed))
    return joins.diff_counts(a, b, KEY, cols, F.col("event_id") % 10 == 0, total=t.hot_event.total)


@query("train_serve_parity", """, o AS (SELECT entrant, min(event_id) AS event_id FROM entries GROUP BY entrant, event_date HAVING count(*) = 1)
  SELECT count(*) AS compared, CAST(0 AS BIGINT) AS differ, count(*) FILTER (event_id % 10 = 0) AS planted FROM o""")
def train_serve_parity(t):
    """Training windows against as-of features for every entry whose day has one event of the entrant."""
    h = t.saved(*KEY, "event_date", "points", "position")
    train = w.prior_features(h, PROBE, EVENT_ORDER, t.hot_entrant, dealt=False)
    q = h.select(*KEY, F.col("event_date").alias("cutoff"))
    serve = asof.asof_features(q, h, PROBE, EVENT_ORDER, "cutoff", t.hot_entrant)
    days = deal(h.select(*KEY, "event_date"), t.hot_entrant).groupBy("entrant", "event_date")
    once = days.agg(F.count(F.lit(1)).alias("c"), F.min("event_id").alias("event_id")).filter(F.col("c") == 1).select(*KEY)
    cols = ["n", "avg_finish", "points_before", "recent_5"]
    # dealt by the keys once: the comparison keeps that deal
    total = t.hot_event.total
    a, b = (joins.semi(spread(d.select(*KEY, *cols), KEY, total), spread(once, KEY, total), KEY) for d in (train, serve))
    return joins.diff_counts(a, b, KEY, cols, F.col("event_id") % 10 == 0, rtol=1e-10, atol=1e-10)


@query("next_event", f"SELECT venue, arg_min(event_id, (event_date, event_id)) AS event_id FROM events_t WHERE event_date > {CUT} GROUP BY 1", base="events")
def next_event(t):
    """Next upcoming event of each venue at a time."""
    d = t.events().filter(F.col("event_date") > cutoff()).select("venue", "event_date", "event_id")
    return w.first_per(d, ["venue"], EVENT_ORDER).select("venue", "event_id")


@query("latest_completed", f"SELECT venue, arg_max(event_id, (event_date, event_id)) AS event_id FROM events_t WHERE event_date < {CUT} AND event_id IN (SELECT l_orderkey FROM lineitem) GROUP BY 1", base="events")
def latest_completed(t):
    d = t.events().filter(F.col("event_date") < cutoff()).select("venue", "event_date", "event_id")
    d = joins.semi(d, t.read("lineitem").select(F.col("l_orderkey").alias("event_id")), ["event_id"])
    return w.last_per(d, ["venue"], EVENT_ORDER).select("venue", "event_id")


@query("overdue_events", f"SELECT o_orderkey AS event_id FROM orders WHERE o_orderdate < {CUT} AND o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)", base="")
def overdue_events(t):
    """Past events without results, cancelled ones left out."""
    o = t.read("orders").filter((F.col("o_orderdate") < cutoff()) & (F.col("o_orderstatus") != "P")).select(F.col("o_orderkey").alias("event_id"))
    return joins.anti(o, t.read("lineitem").select(F.col("l_orderkey").alias("event_id")), ["event_id"])
