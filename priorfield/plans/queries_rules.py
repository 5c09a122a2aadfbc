"""Rules on evidence, outcomes, schedules and times; each query plants rows that break its rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from .queries_metrics import KEY
from .registry import query


@query("rule_evidence", """, e AS (SELECT *, CASE WHEN flag = 'R' THEN 'withdrawn' ELSE 'announced' END AS state, disc % 4 AS c FROM entries),
  k AS (SELECT event_id, entrant, CASE WHEN slot = 5 THEN grp + 1 ELSE grp END AS grp, unnest(CASE c WHEN 0 THEN ['entry_list'] WHEN 1 THEN ['season_registration', 'event_lineup'] WHEN 2 THEN ['season_registration'] ELSE ['entry_list', 'withdrawal', 'qualifying'] END) AS kind FROM e)
  SELECT 'evidence' AS rule, event_id || '|' || entrant AS key, 'neither entry list nor registration with lineup' AS detail FROM e WHERE slot = 5 OR c = 2
  UNION ALL SELECT 'withdrawal', event_id || '|' || entrant, 'status and withdrawal document disagree' FROM e WHERE (state = 'withdrawn') <> (c = 3 AND slot <> 5)
  UNION ALL SELECT 'evidence_kind', event_id || '|' || entrant, kind FROM k WHERE kind = 'qualifying'
  UNION ALL SELECT 'announced', CAST(event_id AS VARCHAR), 'no announced entry' FROM e GROUP BY event_id HAVING max(CAST(state = 'announced' AS INTEGER)) = 0""")
def rule_evidence(t):
    e = t.saved(*KEY, "grp", "flag", "disc", "slot").withColumn("state", F.when(F.col("flag") == "R", "withdrawn").otherwise("announced"))
    c = F.col("disc") % 4
    kinds = (F.when(c == 0, F.lit(["entry_list"])).when(c == 1, F.lit(["season_registration", "event_lineup"])).when(c == 2, F.lit(["season_registration"]))
             .otherwise(F.lit(["entry_list", "withdrawal", "qualifying"])))
    other = F.when(F.col("slot") == 5, F.col("grp") + 1).otherwise(F.col("grp")).alias("grp")
    return quality.check_evidence(e, e.select(*KEY, other, F.explode(kinds).alias("kind")), "event_id", "entrant", "grp", "state", "kind")


@query("rule_outcome_field", """, e AS (SELECT *, CASE WHEN flag = 'A' THEN 'DNS' ELSE flag END AS state, CASE WHEN flag = 'A' AND disc <> 4 THEN NULL ELSE finish_order END AS place, CASE WHEN flag = 'A' AND disc <> 5 THEN NULL WHEN disc = 6 THEN -1 ELSE 1 END AS gain FROM entries WHERE status = 'O'),
  x AS (SELECT event_id, entrant, grp, slot <> 3 AS late, disc FROM e WHERE (disc = 0 AND slot <= 3) OR (disc = 1 AND slot = 1)), y AS (SELECT *, event_id || '|' || entrant AS key FROM e)
  SELECT 'missing_result' AS rule, key, 'no result and no withdrawal after the cutoff' AS detail FROM y WHERE disc = 0 AND slot >= 3
  UNION ALL SELECT 'group', key, 'result of another group' FROM y WHERE disc <> 0 AND slot = 6
  UNION ALL SELECT 'non_start', key, 'non-starter with position or points' FROM y WHERE disc <> 0 AND state = 'DNS' AND (place IS NOT NULL OR coalesce(gain, 0) <> 0)
  UNION ALL SELECT 'points', key, 'points are negative or no number' FROM y WHERE disc <> 0 AND gain < 0
  UNION ALL SELECT 'unused_withdrawal', event_id || '|' || entrant, 'withdrawal without a missing result' FROM x WHERE disc <> 0""")
def rule_outcome_field(t):
    e = t.saved(*KEY, "grp", "flag", "status", "disc", "slot", "finish_order", "event_date").filter("status = 'O'")
    dns, disc = F.col("flag") == "A", F.col("disc")
    results = e.filter(disc != 0).select(
        *KEY, F.when(F.col("slot") == 6, F.col("grp") + 1).otherwise(F.col("grp")).alias("grp"), F.when(dns, "DNS").otherwise(F.col("flag")).alias("state"),
        F.when(~(dns & (disc != 4)), F.col("finish_order")).alias("place"), F.when(dns & (disc != 5), None).when(disc == 6, -1).otherwise(1).alias("gain"))
    gone = e.filter(((disc == 0) & (F.col("slot") <= 3)) | ((disc == 1) & (F.col("slot") == 1)))
    gone = gone.select(*KEY, "grp", F.date_add("event_date", F.when(F.col("slot") == 3, 0).otherwise(1)).alias("published"))
    return quality.check_outcome_field(e.withColumn("cutoff", F.col("event_date")), results, gone, "event_id", "entrant", "grp", "state", "place", "gain", "published", "cutoff")


@query("rule_schedule", """SELECT 'schedule' AS rule, CAST(event_id AS VARCHAR) AS key, 'event unknown or repeated in the calendar' AS detail FROM events_t WHERE event_id % 11 IN (0, 1)
  UNION ALL SELECT 'schedule', CAST(event_id AS VARCHAR), 'season' FROM events_t WHERE event_id % 11 NOT IN (0, 1) AND event_id % 7 = 0
  UNION ALL SELECT 'schedule', CAST(event_id AS VARCHAR), 'venue' FROM events_t WHERE event_id % 11 NOT IN (0, 1) AND event_id % 5 = 0
  UNION ALL SELECT 'schedule', CAST(event_id AS VARCHAR), 'race_start' FROM events_t WHERE event_id % 11 NOT IN (0, 1) AND event_id % 3 = 0 AND event_id % 2 = 0""", base="events")
def rule_schedule(t):
    c = t.events().select("event_id", "event_date", "season", "venue")
    i = F.col("event_id")
    day = F.date_add("event_date", F.when(i % 3 == 0, 1).otherwise(0)).cast("timestamp")
    s = c.select("event_id", (F.col("season") + (i % 7 == 0).cast("int")).alias("season"), F.when(i % 5 == 0, -1).otherwise(F.col("venue")).alias("venue"),
                 F.when(i % 2 == 0, day).alias("race_start"))
    calendar = c.filter(i % 11 != 0).unionByName(c.filter(i % 11 == 1))  # some missing, some twice
    return quality.check_schedule(s, calendar, "event_id", ["season", "venue"], "race_start", "event_date")


@query("rule_outcome_times", """, m AS (SELECT event_id || '|' || entrant AS key, * FROM entries) SELECT 'outcome_times' AS rule, key, 'not complete after the start' AS detail FROM m WHERE slot <= 2
  UNION ALL SELECT 'outcome_times', key, 'retrieved before complete' FROM m WHERE disc = 0 OR flag = 'N' UNION ALL SELECT 'outcome_times', key, 'no reviewer' FROM m WHERE flag IN ('A', 'R')
  UNION ALL SELECT 'outcome_times', key, 'provider not accepted' FROM m WHERE status = 'F'""")
def rule_outcome_times(t):
    done = F.expr("date_add(event_date, slot - 2)")
    d = t.entries().select(*KEY, "event_date", done.alias("completed"), F.when(F.col("flag") != "N", F.expr("date_add(event_date, slot - 3 + disc)")).alias("retrieved"),
                           F.when(F.col("flag") == "N", "ann").when(F.col("flag") == "A", " ").alias("reviewer"), F.col("status").alias("provider"))
    return quality.check_outcome_times(d, KEY, "event_date", "completed", "retrieved", "reviewer", "provider", ["O"])
