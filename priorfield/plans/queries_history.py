"""History windows, event windows, rollups, standings, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import flag, safe_divide
from ..operators import joins, rollups, windows as w
from ..operators.hot import deal, join_dealt
from ..session import materialize
from .orders import EVENT_ORDER
from .registry import query

PRE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
BY_ENTRANT = "PARTITION BY entrant ORDER BY event_date, event_id"


@query("entries", "SELECT event_id, CAST(event_date AS VARCHAR) AS event_date, season, month, venue, entrant, grp, slot, cents, qty, qty_sum, disc, "
       "flag, status, finish_order, position, points, points_finish, podium, win, dnf, classified, start_slot, qual_slot, gained, split FROM entries")
def entries(t):
    d = t.entries().withColumn("event_date", F.col("event_date").cast("string"))
    return d.drop("partkey", "score", "p_win", "p_podium", "p_points")


def _mean(c, frame, keys="entrant"):
    return f"avg({c}) OVER (PARTITION BY {keys} ORDER BY event_date, event_id {frame})"


@query("prior_mean", f"SELECT event_id, entrant, {_mean('position', PRE)} AS avg_position, {_mean('points', PRE)} AS points_per_start, "
       f"{_mean('win', PRE)} AS win_rate FROM entries")
def prior_mean(t):
    specs = [w.prior_mean("avg_position", "position"), w.prior_mean("points_per_start", "points"), w.prior_mean("win_rate", "win")]
    return w.prior_features(t.entries(), [(["entrant"], specs)], EVENT_ORDER, t.hot_entrant, dealt=False).select(
        "event_id", "entrant", "avg_position", "points_per_start", "win_rate")


@query("prior_rolling_mean", "SELECT event_id, entrant, " + ", ".join(
    _mean("position", f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING") + f" AS recent_{n}" for n in (3, 5, 10)) + " FROM entries")
def prior_rolling_mean(t):
    specs = [w.prior_rolling_mean(f"recent_{n}", "position", n) for n in (3, 5, 10)]
    return w.prior_features(t.entries(), [(["entrant"], specs)], EVENT_ORDER, t.hot_entrant, dealt=False).select(
        "event_id", "entrant", "recent_3", "recent_5", "recent_10")


@query("prior_sum", f"SELECT event_id, entrant, CAST(coalesce(sum(points) OVER ({BY_ENTRANT} {PRE}), 0) AS BIGINT) AS prior_points, "
       f"CAST(coalesce(sum(position) OVER ({BY_ENTRANT} {PRE}), 0) AS BIGINT) AS prior_position_sum FROM entries")
def prior_sum(t):
    specs = [w.prior_sum("prior_points", "points"), w.prior_sum("prior_position_sum", "position")]
    return w.prior_features(t.entries(), [(["entrant"], specs)], EVENT_ORDER, t.hot_entrant, dealt=False).select(
        "event_id", "entrant", "prior_points", "prior_position_sum")


@query("prior_count", "SELECT event_id, entrant, row_number() OVER (PARTITION BY entrant ORDER BY event_date, event_id) - 1 AS prior_entries, "
       "row_number() OVER (PARTITION BY entrant, venue ORDER BY event_date, event_id) - 1 AS venue_entries FROM entries")
def prior_count(t):
    sets = [(["entrant"], [w.prior_count("prior_entries")]), (["entrant", "venue"], [w.prior_count("venue_entries")])]
    return w.prior_features(t.entries(), sets, EVENT_ORDER, t.hot_entrant, dealt=False).select("event_id", "entrant", "prior_entries", "venue_entries")


@query("previous_value", f"SELECT event_id, entrant, lag(position) OVER ({BY_ENTRANT}) AS previous_position, "
       f"lag(points) OVER ({BY_ENTRANT}) AS previous_points FROM entries")
def previous_value(t):
    specs = [w.previous("previous_position", "position"), w.previous("previous_points", "points")]
    return w.prior_features(t.entries(), [(["entrant"], specs)], EVENT_ORDER, t.hot_entrant, dealt=False).select(
        "event_id", "entrant", "previous_position", "previous_points")


@query("latest_known_value", f"SELECT event_id, entrant, last_value(position IGNORE NULLS) OVER ({BY_ENTRANT} {PRE}) AS last_position FROM entries")
def latest_known_value(t):
    return w.prior_features(t.entries(), [(["entrant"], [w.latest("last_position", "position")])], EVENT_ORDER, t.hot_entrant, dealt=False).select(
        "event_id", "entrant", "last_position")


@query("user_event_history", """SELECT event_id, user_id, row_number() OVER u - 1 AS prior_events,
  avg(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS avg_cents,
  avg(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS recent_5_cents,
  lag(event_type) OVER u AS previous_type FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)""", base="")
def user_event_history(t):
    d = t.read("events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    specs = [w.prior_count("prior_events"), w.prior_mean("avg_cents", "cents"), w.prior_rolling_mean("recent_5_cents", "cents", 5),
             w.previous("previous_type", "event_type")]
    return w.prior_features(d, [(["user_id"], specs)], ["ts", "event_id"], dealt=False).select(
        "event_id", "user_id", "prior_events", "avg_cents", "recent_5_cents", "previous_type")


HISTORY = {"avg_finish": "position", "points_per_start": "points", "points_finish_rate": "points_finish", "podium_rate": "podium",
           "win_rate": "win", "dnf_rate": "dnf", "avg_start": "start_slot", "avg_qualifying": "qual_slot"}
RATES = {"points_finish_rate": "points_finish", "podium_rate": "podium", "win_rate": "win", "dnf_rate": "dnf"}


def entrant_keysets():
    """Every history feature of an entrant, by key set; the entrant key comes first."""
    career = [w.prior_count("prior_entries"), w.prior_sum("prior_classified", "classified"), w.prior_mean("career_avg_finish", "position"),
              w.prior_mean("career_points_per_start", "points"), *[w.prior_mean(f"career_{k}", c) for k, c in RATES.items()],
              *[w.previous(f"previous_{k}", c) for k, c in {"finish": "position", "points": "points", "start": "start_slot", "qualifying": "qual_slot"}.items()],
              *[w.prior_rolling_mean(f"recent_{n}_{k}", c, n) for n in (3, 5, 10) for k, c in HISTORY.items()]]
    season = [w.prior_count("season_entries"), w.prior_sum("season_points", "points"), w.prior_mean("season_avg_finish", "position"),
              *[w.prior_mean(f"season_{k}", c) for k, c in RATES.items()]]
    venue = [w.prior_count("venue_entries"), w.prior_mean("venue_avg_finish", "position"), *[w.prior_mean(f"venue_{k}", c) for k, c in RATES.items()]]
    group = [w.prior_count("group_entries"), w.prior_mean("group_avg_finish", "position"), w.prior_mean("group_points_per_start", "points"),
             *[w.prior_mean(f"group_{k}", c) for k, c in RATES.items()]]
    return [(["entrant"], career), (["entrant", "season"], season), (["entrant", "venue"], venue), (["entrant", "grp"], group)]


def _history_sql():
    out = []
    for keys, specs in entrant_keysets():
        over = f"PARTITION BY {', '.join(keys)} ORDER BY event_date, event_id"
        for s in specs:
            e = {"count": f"row_number() OVER ({over}) - 1",
                 "sum": f"CAST(coalesce(sum({s.col}) OVER ({over} {PRE}), 0) AS BIGINT)",
                 "mean": f"avg({s.col}) OVER ({over} {PRE})", "last": f"lag({s.col}) OVER ({over})",
                 "rolling": f"avg({s.col}) OVER ({over} ROWS BETWEEN {s.n} PRECEDING AND 1 PRECEDING)"}[s.kind]
            out.append(f"{e} AS {s.out}")
    return ", ".join(out)


@query("entrant_history", f"SELECT event_id, entrant, {_history_sql()} FROM entries")
def entrant_history(t):
    sets = entrant_keysets()
    d = w.prior_features(t.entries(), sets, EVENT_ORDER, t.hot_entrant, dealt=False)
    return d.select("event_id", "entrant", *[s.out for _, specs in sets for s in specs])


# --- windows inside an event -----------------------------------------------------------------

@query("event_window_aggregates", """SELECT event_id, entrant, count(*) OVER e AS field_size, count(start_slot) OVER e AS slots_known,
  min(cents) OVER e AS lowest, avg(qty) OVER e AS mean_qty FROM entries WINDOW e AS (PARTITION BY event_id)""")
def event_window_aggregates(t):
    return w.attach_group(t.entries(), ["event_id"], t.hot_event, field_size=F.count(F.lit(1)), slots_known=F.count("start_slot"),
                          lowest=F.min("cents"), mean_qty=F.avg("qty")).select(
        "event_id", "entrant", "field_size", "slots_known", "lowest", "mean_qty")


@query("event_relative_values", """, x AS (SELECT *, CASE WHEN status = 'F' AND flag = 'N' THEN count(start_slot) OVER (PARTITION BY event_id) + 1 ELSE start_slot END AS eff,
    count(start_slot) OVER (PARTITION BY event_id) AS n, min(cents) OVER (PARTITION BY event_id) AS best FROM entries)
  SELECT event_id, entrant, eff, CAST(eff AS DOUBLE) / nullif(n, 0) AS slot_normalised, CAST(qual_slot AS DOUBLE) / nullif(n, 0) AS qual_normalised,
    CAST(cents - best AS DOUBLE) / nullif(best, 0) AS pct_off_best, eff - avg(eff) OVER (PARTITION BY event_id, grp) AS slot_delta_to_group FROM x""")
def event_relative_values(t):
    """Pit-lane style override of the slot, values over the field size, gap to the best, gap to the group mean."""
    d = w.attach_group(t.entries(), ["event_id"], t.hot_event, n=F.count("start_slot"), best=F.min("cents"))
    pit = (F.col("status") == "F") & (F.col("flag") == "N")
    d = d.withColumn("eff", F.when(pit, F.col("n") + 1).otherwise(F.col("start_slot").cast("long")))
    d = w.attach_group(d, ["event_id", "grp"], t.hot_event, mean_eff=F.avg("eff"))
    return d.select("event_id", "entrant", "eff", safe_divide("eff", "n").alias("slot_normalised"),
                    safe_divide("qual_slot", "n").alias("qual_normalised"),
                    safe_divide(F.col("cents") - F.col("best"), "best").alias("pct_off_best"),
                    (F.col("eff") - F.col("mean_eff")).alias("slot_delta_to_group"))


@query("group_in_event", """SELECT event_id, entrant, count(*) OVER g AS group_entries, avg(start_slot) OVER g AS group_avg_slot, min(start_slot) OVER g AS group_best_slot,
  avg(qual_slot) OVER g AS group_avg_qual FROM entries WINDOW g AS (PARTITION BY event_id, grp)""")
def group_in_event(t):
    return w.attach_group(t.entries(), ["event_id", "grp"], t.hot_event, group_entries=F.count(F.lit(1)), group_avg_slot=F.avg("start_slot"),
                          group_best_slot=F.min("start_slot"), group_avg_qual=F.avg("qual_slot")).select(
        "event_id", "entrant", "group_entries", "group_avg_slot", "group_best_slot", "group_avg_qual")


@query("rank_first", "SELECT event_id, entrant, row_number() OVER (PARTITION BY event_id ORDER BY score, entrant) AS predicted_order FROM entries")
def rank_first(t):
    return w.rank_first(t.entries(), "event_id", ["score", "entrant"], "predicted_order", t.hot_event).select("event_id", "entrant", "predicted_order")


@query("rank_average", """SELECT event_id, entrant, rank() OVER (PARTITION BY event_id ORDER BY score) + (count(*) OVER (PARTITION BY event_id, score) - 1) / 2.0 AS avg_rank
  FROM entries""".replace("/ 2.0", "/ CAST(2 AS DOUBLE)"))
def rank_average(t):
    return w.rank_average(t.entries(), "event_id", "score", "avg_rank", t.hot_event).select("event_id", "entrant", "avg_rank")


@query("baseline_rank", "SELECT event_id, entrant, row_number() OVER (PARTITION BY event_id ORDER BY qty DESC, entrant) AS rank FROM entries")
def baseline_rank(t):
    d = t.entries().withColumn("_down", -F.col("qty"))
    return w.rank_first(d, "event_id", ["_down", "entrant"], "rank", t.hot_event).select("event_id", "entrant", "rank")


@query("dedupe_first", """SELECT event_id, entrant, slot, cents, qty_sum FROM (SELECT * FROM kept_t WHERE rn = 1)""")
def dedupe_first(t):
    return t.lines().select("event_id", "entrant", "slot", "cents", "qty_sum")


@query("last_per_entrant", """SELECT entrant, event_id, CAST(event_date AS VARCHAR) AS event_date, position FROM (
  SELECT *, row_number() OVER (PARTITION BY entrant ORDER BY event_date DESC, event_id DESC) AS r FROM entries) WHERE r = 1""")
def last_per_entrant(t):
    d = t.entries().select("entrant", "event_date", "event_id", "position")
    return w.last_per(d, ["entrant"], EVENT_ORDER).withColumn("event_date", F.col("event_date").cast("string"))


@query("tail_mean", """SELECT entrant, avg(position) AS last_5_position, avg(points) AS last_5_points FROM (
  SELECT *, row_number() OVER (PARTITION BY entrant ORDER BY event_date DESC, event_id DESC) AS r FROM entries) WHERE r <= 5 GROUP BY entrant""")
def tail_mean(t):
    d = t.entries().select("entrant", "position", "points", (-F.unix_date("event_date")).alias("a"), (-F.col("event_id")).alias("b"))
    return w.top_k(d, ["entrant"], ["a", "b"], 5).groupBy("entrant").agg(
        F.avg("position").alias("last_5_position"), F.avg("points").alias("last_5_points"))


@query("next_event_in_season", "SELECT event_id, season, lead(event_id) OVER (PARTITION BY season ORDER BY event_date, event_id) AS next_event_id FROM events_t", base="events")
def next_event_in_season(t):
    return w.next_in(t.events(), ["season"], EVENT_ORDER, "event_id", "next_event_id").select("event_id", "season", "next_event_id")


@query("event_sequence", "SELECT event_id, row_number() OVER (ORDER BY event_date, event_id) - 1 AS event_index FROM events_t", base="events")
def event_sequence(t):
    return w.event_seq(t.events(), EVENT_ORDER, hot=t.hot_all).select("event_id", "event_index")


@query("validation_blocks", """SELECT event_id, CASE WHEN i < 8 THEN 'calibration' WHEN i < 15 THEN 'selection' ELSE 'report' END AS block FROM (
  SELECT event_id, row_number() OVER (ORDER BY event_date, event_id) - 1 AS i FROM events_t WHERE season = 1999)""", base="events")
def validation_blocks(t):
    v = t.events().filter(F.col("season") == 1999)
    return w.assign_blocks(v, EVENT_ORDER, {"calibration": 8, "selection": 7}, "report").select("event_id", "block")


@query("early_validation_blocks", """SELECT event_id, CASE WHEN i < 8 THEN 'selection' WHEN i < 15 THEN 'calibration' ELSE 'report' END AS block FROM (
  SELECT event_id, row_number() OVER (ORDER BY event_date, event_id) - 1 AS i FROM events_t WHERE season = 1999)""", base="events")
def early_validation_blocks(t):
    v = t.events().filter(F.col("season") == 1999)
    return w.assign_blocks(v, EVENT_ORDER, {"selection": 8, "calibration": 7}, "report").select("event_id", "block")


FOLDS = [("f1997", 1996, 1997), ("f1998", 1997, 1998)]


@query("temporal_folds", """SELECT fold, fold_role, count(*) AS n, count(DISTINCT event_id) AS events, min(season) AS first_season, max(season) AS last_season FROM (
  SELECT *, 'f1997' AS fold, CASE WHEN season <= 1996 THEN 'fit' WHEN season = 1997 THEN 'score' END AS fold_role FROM entries UNION ALL
  SELECT *, 'f1998', CASE WHEN season <= 1997 THEN 'fit' WHEN season = 1998 THEN 'score' END FROM entries) WHERE fold_role IS NOT NULL GROUP BY ALL""")
def temporal_folds(t):
    d = w.temporal_folds(t.entries(), "season", FOLDS)
    return d.groupBy("fold", "fold_role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("events"),
                                              F.min("season").alias("first_season"), F.max("season").alias("last_season"))


ALL_FOLDS = [(f"f{s}", s - 1, s) for s in range(1996, 1999)]


@query("expanding_folds", "SELECT fold, fold_role, count(*) AS n, count(DISTINCT event_id) AS events, min(season) AS first_season, max(season) AS last_season FROM (" + " UNION ALL ".join(
    f"SELECT *, '{name}' AS fold, CASE WHEN season <= {end} THEN 'fit' WHEN season = {score} THEN 'score' END AS fold_role FROM entries" for name, end, score in ALL_FOLDS)
    + ") WHERE fold_role IS NOT NULL GROUP BY ALL")
def expanding_folds(t):
    """Every fold that the training seasons allow."""
    d = w.temporal_folds(t.entries(), "season", ALL_FOLDS)
    return d.groupBy("fold", "fold_role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("events"),
                                              F.min("season").alias("first_season"), F.max("season").alias("last_season"))


@query("normalised_order", """SELECT event_id, entrant, (finish_order - 1) / CAST(greatest(count(*) OVER (PARTITION BY event_id) - 1, 1) AS DOUBLE) AS target FROM entries""")
def normalised_order(t):
    return w.normalised_order(t.entries(), "event_id", "finish_order", hot=t.hot_event).select("event_id", "entrant", "target")


@query("ranking_relevance", """SELECT event_id, entrant, count(*) OVER (PARTITION BY event_id) - finish_order + 1 AS relevance,
  max(position) OVER (PARTITION BY event_id) - position + 1 AS relevance_by_max FROM entries""")
def ranking_relevance(t):
    d = w.relevance(t.entries(), "event_id", "finish_order", hot=t.hot_event)
    return w.relevance(d, "event_id", "position", "relevance_by_max", True, t.hot_event).select("event_id", "entrant", "relevance", "relevance_by_max")


@query("split_label", "SELECT split, season, count(*) AS n FROM entries GROUP BY ALL")
def split_label(t):
    return t.entries().groupBy("split", "season").agg(F.count(F.lit(1)).alias("n"))


@query("top_k_members", "SELECT event_id, entrant, place FROM (SELECT event_id, entrant, row_number() OVER (PARTITION BY event_id ORDER BY score, entrant) AS place FROM entries) WHERE place <= 3")
def top_k_members(t):
    return w.top_k(t.entries().select("event_id", "entrant", "score"), "event_id", ["score", "entrant"], 3).select("event_id", "entrant", F.col("place").cast("long").alias("place"))


@query("best_row_per_group", """SELECT grp, entrant, event_id, qty, cents FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY qty DESC, cents, event_id, entrant) AS r FROM entries) WHERE r = 1""")
def best_row_per_group(t):
    d = t.entries().select("grp", (-F.col("qty")).alias("down"), "cents", "event_id", "entrant", "qty")
    return w.first_per(d, ["grp"], ["down", "cents", "event_id", "entrant"]).drop("down")


# --- rollups ---------------------------------------------------------------------------------

ROLLUP_SQL = """, g AS (SELECT event_id, event_date, season, grp, count(*) AS entries_n, sum(points) AS points, sum(points_finish) AS pf, sum(podium) AS pod,
  sum(win) AS wins, sum(dnf) AS dnfs, coalesce(sum(position), 0) AS finish_sum, sum(classified) AS classified, avg(position) AS avg_finish, avg(start_slot) AS avg_slot,
  avg(qual_slot) AS avg_qual, CAST(sum(dnf) AS DOUBLE) / count(*) AS dnf_rate FROM entries GROUP BY event_id, event_date, season, grp)"""


def group_rollup(t):
    d = rollups.group_event_rollup(
        t.entries(), "event_id", "grp", ["event_date", "season"], points=F.sum("points"), pf=F.sum("points_finish"), pod=F.sum("podium"),
        wins=F.sum("win"), dnfs=F.sum("dnf"), finish_sum=rollups.total_or_zero("position"), classified=F.sum("classified"),
        avg_finish=F.avg("position"), avg_slot=F.avg("start_slot"), avg_qual=F.avg("qual_slot"))
    return d.withColumnRenamed("entries", "entries_n").withColumn("dnf_rate", safe_divide("dnfs", "entries_n"))


@query("group_event_rollup", ROLLUP_SQL + """ SELECT event_id, grp, entries_n, CAST(points AS BIGINT) AS points, CAST(pf AS BIGINT) AS pf, CAST(pod AS BIGINT) AS pod,
  CAST(wins AS BIGINT) AS wins, CAST(dnfs AS BIGINT) AS dnfs, CAST(finish_sum AS BIGINT) AS finish_sum, CAST(classified AS BIGINT) AS classified,
  avg_finish, avg_slot, avg_qual, dnf_rate FROM g""")
def group_event_rollup(t):
    return group_rollup(t).drop("event_date", "season")


VENUE_SQL = """, v AS (SELECT event_id, event_date, venue, min(CASE WHEN win = 1 THEN start_slot END) AS winner_slot, avg(dnf) AS dnf_rate, avg(gained) AS avg_gained
  FROM entries GROUP BY event_id, event_date, venue)"""


def venue_rollup(t):
    return rollups.venue_event_rollup(t.entries(), "event_id", "venue", "win", "start_slot", ["event_date"], dnf_rate=F.avg("dnf"), avg_gained=F.avg("gained"))


@query("venue_event_rollup", VENUE_SQL + " SELECT event_id, venue, winner_slot, coalesce(CAST(winner_slot = 1 AS INTEGER), 0) AS first_slot_won, dnf_rate, avg_gained FROM v")
def venue_event_rollup(t):
    return venue_rollup(t).drop("event_date")


@query("venue_history", VENUE_SQL + f""" SELECT event_id, venue, row_number() OVER (PARTITION BY venue ORDER BY event_date, event_id) - 1 AS prior_events,
  {_mean('winner_slot', PRE, 'venue')} AS avg_winner_slot, {_mean("coalesce(CAST(winner_slot = 1 AS INTEGER), 0)", PRE, 'venue')} AS first_slot_win_rate,
  round({_mean('dnf_rate', PRE, 'venue')}, 6) AS dnf_rate, round({_mean('avg_gained', PRE, 'venue')}, 6) AS avg_gained FROM v""")
def venue_history(t):
    specs = [w.prior_count("prior_events"), w.prior_mean("avg_winner_slot", "winner_slot"), w.prior_mean("first_slot_win_rate", "first_slot_won"),
             w.prior_mean("h_dnf", "dnf_rate"), w.prior_mean("h_gained", "avg_gained")]
    return w.prior_features(venue_rollup(t), [(["venue"], specs)], EVENT_ORDER, t.hot_venue).select(
        "event_id", "venue", "prior_events", "avg_winner_slot", "first_slot_win_rate", F.round("h_dnf", 6).alias("dnf_rate"), F.round("h_gained", 6).alias("avg_gained"))


def _psum(c, keys="grp"):
    return f"coalesce(sum({c}) OVER (PARTITION BY {keys} ORDER BY event_date, event_id {PRE}), 0)"


def _ratio(a, b):
    return f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"


_RACES = "(row_number() OVER (PARTITION BY grp ORDER BY event_date, event_id) - 1)"
_SRACES = "(row_number() OVER (PARTITION BY grp, season ORDER BY event_date, event_id) - 1)"
RECENT = {"points_per_event": "points", "podiums_per_event": "pod", "wins_per_event": "wins", "dnf_rate": "dnf_rate", "avg_finish": "avg_finish",
          "avg_slot": "avg_slot", "avg_qual": "avg_qual"}


@query("group_history", ROLLUP_SQL + f""" SELECT event_id, grp, {_RACES} AS prior_events, CAST({_psum('entries_n')} AS BIGINT) AS prior_entries,
  {_ratio(_psum('points'), _RACES)} AS points_per_event, {_ratio(_psum('pf'), _psum('entries_n'))} AS points_finish_rate, {_ratio(_psum('pod'), _RACES)} AS podiums_per_event,
  {_ratio(_psum('wins'), _RACES)} AS wins_per_event, {_ratio(_psum('dnfs'), _psum('entries_n'))} AS dnf_rate_prior, {_ratio(_psum('finish_sum'), _psum('classified'))} AS avg_finish_prior,
  {_SRACES} AS season_events, CAST({_psum('points', 'grp, season')} AS BIGINT) AS season_points, {_ratio(_psum('points', 'grp, season'), _SRACES)} AS season_points_per_event,
  {_ratio(_psum('dnfs', 'grp, season'), _psum('entries_n', 'grp, season'))} AS season_dnf_rate,
  """ + ", ".join(f"round({_mean(c, f'ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING', 'grp')}, 6) AS recent_{n}_{k}" for n in (3, 5, 10) for k, c in RECENT.items()) + " FROM g")
def group_history(t):
    """Career and season ratios of prior sums, and recent means of per-event values."""
    sums = ["entries_n", "points", "pf", "pod", "wins", "dnfs", "finish_sum", "classified"]
    career = [w.prior_count("n"), *[w.prior_sum(f"c_{c}", c) for c in sums],
              *[w.prior_rolling_mean(f"recent_{n}_{k}", c, n) for n in (3, 5, 10) for k, c in RECENT.items()]]
    season = [w.prior_count("sn"), *[w.prior_sum(f"s_{c}", c) for c in ("entries_n", "points", "dnfs")]]
    g = group_rollup(t)
    g = materialize(g) if t.hot_group else g  # rows of large keys and all others are read apart
    d = w.prior_features(g, [(["grp"], career), (["grp", "season"], season)], EVENT_ORDER, t.hot_group, dealt=False)
    return d.select(
        "event_id", "grp", F.col("n").alias("prior_events"), F.col("c_entries_n").alias("prior_entries"),
        safe_divide("c_points", "n").alias("points_per_event"), safe_divide("c_pf", "c_entries_n").alias("points_finish_rate"),
        safe_divide("c_pod", "n").alias("podiums_per_event"), safe_divide("c_wins", "n").alias("wins_per_event"),
        safe_divide("c_dnfs", "c_entries_n").alias("dnf_rate_prior"), safe_divide("c_finish_sum", "c_classified").alias("avg_finish_prior"),
        F.col("sn").alias("season_events"), F.col("s_points").alias("season_points"), safe_divide("s_points", "sn").alias("season_points_per_event"),
        safe_divide("s_dnfs", "s_entries_n").alias("season_dnf_rate"),
        *[F.round(f"recent_{n}_{k}", 6).alias(f"recent_{n}_{k}") for n in (3, 5, 10) for k in RECENT])


# --- standings -------------------------------------------------------------------------------

STANDINGS_SQL = """, st AS (SELECT event_id, entrant, season, event_date, CAST(sum(points) OVER (PARTITION BY entrant, season ORDER BY event_date, event_id) AS BIGINT) AS season_points
  FROM entries)"""


def standings(t):
    """Points of an entrant in the season after each of its events."""
    d = w.prior_features(t.entries(), [(["entrant"], []), (["entrant", "season"], [w.prior_sum("season_points", "points")])], EVENT_ORDER, t.hot_entrant, inclusive=True, dealt=False)
    return d.select("event_id", "entrant", "season", "event_date", "season_points")


@query("standings_after_event", STANDINGS_SQL + " SELECT event_id, entrant, season_points FROM st")
def standings_after_event(t):
    return standings(t).select("event_id", "entrant", "season_points")


@query("lagged_standings", STANDINGS_SQL + """, nx AS (SELECT event_id, lead(event_id) OVER (PARTITION BY season ORDER BY event_date, event_id) AS next_id FROM events_t)
, en AS MATERIALIZED (SELECT event_id, entrant FROM entries), p AS MATERIALIZED (SELECT next_id AS event_id, entrant, season_points FROM st JOIN nx ON nx.event_id = st.event_id WHERE next_id IS NOT NULL)
  SELECT en.event_id, en.entrant, coalesce(p.season_points, 0) AS points_before FROM en LEFT JOIN p ON p.event_id = en.event_id AND p.entrant = en.entrant""")
def lagged_standings(t):
    d = joins.lag_join(t.entries().select("event_id", "entrant"), standings(t), t.events(), "event_id", "season", EVENT_ORDER, ["entrant"], ["season_points"])
    return d.select("event_id", "entrant", F.coalesce("season_points", F.lit(0)).alias("points_before"))


SEASON_END_SQL = """, fin AS (SELECT season, entrant, arg_max(season_points, (event_date, event_id)) AS season_points FROM st GROUP BY season, entrant)"""


@query("previous_season_standing", STANDINGS_SQL + SEASON_END_SQL + """ SELECT e.event_id, e.entrant, f.season_points AS previous_season_points
  FROM entries e LEFT JOIN fin f ON f.season + 1 = e.season AND f.entrant = e.entrant""")
def previous_season_standing(t):
    """Final standing of each entrant in the season before."""
    final = w.last_per(standings(t), ["season", "entrant"], EVENT_ORDER).select(
        (F.col("season") + 1).alias("season"), "entrant", F.col("season_points").alias("previous_season_points"))
    return joins.join_nullsafe(t.entries().select("event_id", "entrant", "season"), final, ["season", "entrant"], "left").drop("season")


@query("prior_season_last_event", STANDINGS_SQL + """, le AS (SELECT season, arg_max(event_id, (event_date, event_id)) AS event_id FROM events_t WHERE event_id IN (SELECT event_id FROM entries) GROUP BY season)
, en AS MATERIALIZED (SELECT event_id, entrant, season FROM entries), s AS MATERIALIZED (SELECT le.season + 1 AS season, st.entrant, st.season_points FROM st JOIN le ON le.event_id = st.event_id)
  SELECT en.event_id, en.entrant, s.season_points AS last_event_points FROM en LEFT JOIN s ON s.season = en.season AND s.entrant = en.entrant""")
def prior_season_last_event(t):
    """Standing recorded at the last event of the season before."""
    e = t.entries()
    ev = e.groupBy("event_id").agg(F.first("season").alias("season"), F.first("event_date").alias("event_date"))
    return joins.prior_season_join(e.select("event_id", "entrant", "season"), standings(t), ev, "event_id", "season", EVENT_ORDER, ["entrant"],
                                   {"last_event_points": "season_points"}).select("event_id", "entrant", "last_event_points")


@query("full_feature_table", ROLLUP_SQL + VENUE_SQL + STANDINGS_SQL + SEASON_END_SQL + f""", h AS (SELECT event_id, entrant, season, grp, venue, split, {_history_sql()} FROM entries),
  gh AS (SELECT event_id, grp, {_RACES} AS g_events, {_ratio(_psum('points'), _RACES)} AS g_points_per_event FROM g),
  vh AS (SELECT event_id, row_number() OVER (PARTITION BY venue ORDER BY event_date, event_id) - 1 AS v_events, {_mean('winner_slot', PRE, 'venue')} AS v_winner_slot FROM v)
  SELECT h.event_id, h.entrant, split, prior_entries, career_avg_finish, recent_5_avg_finish, h.season_points, venue_entries, group_entries, g_events, g_points_per_event, v_events, v_winner_slot,
    f.season_points AS previous_season_points FROM h JOIN gh USING (event_id, grp) JOIN vh USING (event_id)
  LEFT JOIN fin f ON f.season + 1 = h.season AND f.entrant = h.entrant WHERE h.season >= 1996""")
def full_feature_table(t):
    """Entrant, group, venue and season history joined; the first season is cut after the windows."""
    sets = entrant_keysets()
    used = ["event_id", "event_date", "season", "venue", "entrant", "grp", "split", "start_slot", "win", "points"]
    base = t.saved(*dict.fromkeys([*used, *[s.col for _, specs in sets for s in specs if s.col]]))
    h = w.prior_features(base, sets, EVENT_ORDER, t.hot_entrant, dealt=False)
    by_event = deal(base, t.hot_event)
    v = rollups.venue_event_rollup(by_event, "event_id", "venue", "win", "start_slot", ["event_date"])
    v = w.prior_features(v, [(["venue"], [w.prior_count("v_events"), w.prior_mean("v_winner_slot", "winner_slot")])], EVENT_ORDER, t.hot_venue, dealt=False).select("event_id", "v_events", "v_winner_slot")
    g = rollups.group_event_rollup(by_event, "event_id", "grp", ["event_date"], points=F.sum("points"))
    g = joins.lookup(g, deal(v, t.hot_event), "event_id", t.hot_event)  # on the narrow rows of the groups, which lie by event
    g = w.prior_features(g, [(["grp"], [w.prior_count("g_events"), w.prior_sum("_p", "points")])], EVENT_ORDER, t.hot_group, dealt=False)
    g = g.select("event_id", "grp", "g_events", safe_divide("_p", "g_events").alias("g_points_per_event"), "v_events", "v_winner_slot")
    s = base.groupBy("season", "entrant").agg(F.sum("points").alias("previous_season_points")).withColumn("season", F.col("season") + 1)
    d = join_dealt(h.filter(F.col("season") >= 1996), s, ["season", "entrant"], t.hot_entrant, "left")
    d = join_dealt(d, g, ["event_id", "grp"], t.hot_event)
    return d.select("event_id", "entrant", "split", "prior_entries", "career_avg_finish", "recent_5_avg_finish", "season_points", "venue_entries", "group_entries",
                    "g_events", "g_points_per_event", "v_events", "v_winner_slot", "previous_season_points")


@query("precedence_flags", """SELECT event_id, entrant, coalesce(start_slot, qual_slot, slot) AS first_known, CASE WHEN status = 'O' THEN start_slot ELSE qual_slot END AS preferred,
  coalesce(CAST(position <= 3 AS INTEGER), 0) AS podium, CAST(start_slot IS NULL AS INTEGER) AS missing_slot, CAST((qual_slot IS NOT NULL) OR flag = 'A' OR coalesce(start_slot > 5, false) AS INTEGER) AS any_flag FROM entries""")
def precedence_flags(t):
    from ..functions.expr import any_of, first_known, prefer_record

    return t.entries().select(
        "event_id", "entrant", first_known("start_slot", "qual_slot", "slot").alias("first_known"),
        prefer_record(F.col("status") == "O", "start_slot", "qual_slot").alias("preferred"), flag(F.col("position") <= 3).alias("podium"),
        flag(F.col("start_slot").isNull()).alias("missing_slot"),
        any_of(F.col("qual_slot").isNotNull(), F.col("flag") == "A", F.col("start_slot") > 5).alias("any_flag"))
