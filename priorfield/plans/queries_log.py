"""Observation-log operators. The log is made of the event stream: a user is a source, the
props text the content, the time of the event the time of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import obslog, windows as w
from ..session import materialize
from .registry import query

LOG_SQL = """WITH RECURSIVE log AS (SELECT event_id AS observation_id, user_id, event_type AS provider, 'https://' || event_type || '.example.org/' || user_id AS uri, sha256(props) AS sha256, ts AS retrieved_at,
  ts - INTERVAL (event_id % 50) HOUR AS published_at, CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL (event_id % 30) HOUR END AS reviewed_at, CASE WHEN event_id % 4 <> 0 THEN 'reviewer' END AS reviewed_by,
  CASE WHEN event_id % 5 = 0 THEN CAST(ts AS DATE) END AS claimed_day, CASE WHEN event_id % 7 <> 0 THEN 'document' END AS basis,
  min(ts) OVER (PARTITION BY user_id, props) AS first_observed_at, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_observation FROM events)"""

CUT_SQL, CUT = "TIMESTAMP '2024-01-20 00:00:00'", "2024-01-20 00:00:00"


def cut():
    return F.lit(CUT).cast("timestamp")


def hours(n):
    return F.make_dt_interval(hours=n.cast("int"))


def new_rows(t):
    e = t.read("events")
    kept = F.col("event_id") % 4 != 0
    return e.select(
        F.col("event_id").alias("observation_id"), "user_id", F.col("event_type").alias("provider"),
        F.concat(F.lit("https://"), "event_type", F.lit(".example.org/"), F.col("user_id").cast("string")).alias("uri"),
        F.col("props").cast("binary").alias("payload"), F.col("ts").alias("retrieved_at"), (F.col("ts") - hours(F.col("event_id") % 50)).alias("published_at"),
        F.when(kept, F.col("ts") + hours(F.col("event_id") % 30)).alias("reviewed_at"), F.when(kept, F.lit("reviewer")).alias("reviewed_by"),
        F.when(F.col("event_id") % 5 == 0, F.to_date("ts")).alias("claimed_day"), F.when(F.col("event_id") % 7 != 0, F.lit("document")).alias("basis"))


def log(t):
    return obslog.append_observations(None, new_rows(t), ["user_id"])


def secs(c):
    return F.unix_timestamp(c).alias(c)


@query("observation_log", LOG_SQL + " SELECT observation_id, user_id, sha256, epoch_us(first_observed_at) // 1000000 AS first_observed_at, previous_observation FROM log", base="")
def observation_log(t):
    return log(t).select("observation_id", "user_id", "sha256", secs("first_observed_at"), "previous_observation")


@query("append_reviews", LOG_SQL + """ SELECT observation_id, previous_observation, reviewed_by, epoch_us(retrieved_at) // 1000000 AS retrieved_at FROM log UNION ALL
  SELECT -observation_id - 1, observation_id, 'second', epoch_us(retrieved_at) // 1000000 FROM log WHERE reviewed_by IS NULL""", base="")
def append_reviews(t):
    """Unreviewed observations get a review that keeps their retrieval time."""
    d = log(t)
    r = d.filter(F.col("reviewed_by").isNull()).select((-F.col("observation_id") - 1).alias("observation_id"), F.col("observation_id").alias("reviews"), F.lit("second").alias("reviewed_by"),
                                                      (F.col("retrieved_at") + F.expr("INTERVAL 1 DAY")).alias("reviewed_at"))
    return obslog.append_reviews(d, r).select("observation_id", "previous_observation", "reviewed_by", secs("retrieved_at"))


AVAILABLE = f"published_at <= {CUT_SQL} AND retrieved_at <= {CUT_SQL} AND first_observed_at <= {CUT_SQL} AND (reviewed_at IS NULL OR reviewed_at <= {CUT_SQL})"
AGE = f"(epoch_us({CUT_SQL}) - epoch_us(retrieved_at)) / 1e6"


@query("available_asof", LOG_SQL + f" SELECT observation_id FROM log WHERE {AVAILABLE} AND {AGE} <= 864000", base="")
def available_asof(t):
    return obslog.available_asof(log(t), cut(), F.lit(864000)).select("observation_id")


@query("freshness_by_role", LOG_SQL + f" SELECT observation_id, provider FROM log WHERE {AVAILABLE} AND {AGE} <= CASE provider WHEN 'click' THEN 86400 WHEN 'view' THEN 604800 END", base="")
def freshness_by_role(t):
    return obslog.freshness(log(t), {"click": 86400, "view": 604800}, "provider", cut()).select("observation_id", "provider")


EDGES = """, prev AS (SELECT event_id AS src, lag(event_id) OVER (PARTITION BY user_id, props ORDER BY ts, event_id) AS dst FROM events)"""


@query("evidence_closure", "WITH RECURSIVE " + EDGES[2:] + """, cl AS (SELECT max(event_id) AS node FROM events GROUP BY user_id UNION SELECT dst FROM cl JOIN prev ON src = node WHERE dst IS NOT NULL) SELECT node FROM cl""", base="")
def evidence_closure(t):
    """From each source's last observation to everything it builds on (earlier same content)."""
    e = t.read("events")
    d = w.prior_features(e, [(["user_id"], []), (["user_id", "props"], [w.previous("dst", "event_id")])], ["ts", "event_id"], dealt=False)
    edges = d.filter(F.col("dst").isNotNull()).select(F.col("event_id").alias("src"), "dst")
    return obslog.evidence_closure(edges, e.groupBy("user_id").agg(F.max("event_id").alias("node")).select("node"))


@query("dependency_cycles", """WITH RECURSIVE nx AS (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
  ed AS (SELECT src, dst FROM nx WHERE r = 1 AND dst IS NOT NULL), wk AS (SELECT src AS a, dst AS b FROM ed UNION SELECT a, dst FROM wk JOIN ed ON src = b) SELECT src, dst FROM ed WHERE src IN (SELECT a FROM wk WHERE a = b)""", base="")
def dependency_cycles(t):
    """Each user points to the user of the next event of the same type after its first event."""
    e = t.read("events").select("event_id", "user_id", "event_type", "ts")
    d = w.next_in(e, ["event_type"], ["ts", "event_id"], "user_id", "dst")
    d = w.first_per(d, ["user_id"], ["ts", "event_id"]).filter(F.col("dst").isNotNull())
    return obslog.find_cycles(d.select(F.col("user_id").alias("src"), "dst"))


@query("tampered_observations", LOG_SQL + " SELECT observation_id FROM log WHERE observation_id % 97 = 5", base="")
def tampered_observations(t):
    """Payloads that no longer match the recorded hash; every 97th one is altered here."""
    d = log(t)
    changed = F.when(F.col("observation_id") % 97 == 5, F.concat(F.col("payload"), F.lit("x").cast("binary"))).otherwise(F.col("payload"))
    return obslog.tampered(d.withColumn("payload", changed)).select("observation_id")


@query("scope_mismatch", LOG_SQL + """ SELECT observation_id FROM log LEFT JOIN (SELECT user_id, max(event_type) AS top FROM events WHERE user_id % 3 <> 0 GROUP BY 1) USING (user_id) WHERE top IS NULL OR top <> provider""", base="")
def scope_mismatch(t):
    """Records whose source is unknown or whose provider is not the declared one."""
    e = t.read("events").filter(F.col("user_id") % 3 != 0).groupBy("user_id").agg(F.max("event_type").alias("provider"))
    return obslog.scope_mismatch(log(t), e, "user_id", ["provider"]).select("observation_id")


BOUNDS_SQL = """, b AS (SELECT *, CASE WHEN claimed_day IS NULL THEN published_at ELSE greatest(CAST(claimed_day AS TIMESTAMP) + INTERVAL 36 HOUR, published_at) END AS latest,
  CASE WHEN claimed_day IS NULL THEN published_at ELSE greatest(CAST(claimed_day AS TIMESTAMP) - INTERVAL 14 HOUR, published_at) END AS earliest FROM log)"""


@query("publication_bounds", LOG_SQL + BOUNDS_SQL + " SELECT observation_id, epoch_us(earliest) // 1000000 AS earliest, epoch_us(latest) // 1000000 AS latest FROM b", base="")
def publication_bounds(t):
    return obslog.publication_bounds(log(t)).select("observation_id", secs("earliest"), secs("latest"))


@query("unverified_claims", LOG_SQL + " SELECT observation_id FROM log WHERE reviewed_by IS NULL OR basis IS NULL", base="")
def unverified_claims(t):
    return obslog.unverified_claims(log(t)).select("observation_id")


CLASS = f"CASE WHEN latest <= {CUT_SQL} THEN 'before_or_at_cutoff' WHEN earliest > {CUT_SQL} THEN 'after_cutoff' ELSE 'ambiguous' END"


@query("publication_timing", LOG_SQL + BOUNDS_SQL + f" SELECT {CLASS} AS timing, count(*) AS n FROM b GROUP BY 1", base="")
def publication_timing(t):
    d = obslog.publication_bounds(log(t)).select(obslog.publication_timing(cut()).alias("timing"))
    return d.groupBy("timing").agg(F.count(F.lit(1)).alias("n"))


@query("recovered_timing", LOG_SQL + BOUNDS_SQL + f" SELECT observation_id, {CLASS} AS claimed_publication_timing, CAST(retrieved_at > {CUT_SQL} AS INTEGER) AS retrieved_after_cutoff, CAST(latest > retrieved_at AS INTEGER) AS window_beyond_retrieval FROM b", base="")
def recovered_timing(t):
    return obslog.assess_timing(obslog.publication_bounds(log(t)), cut()).select("observation_id", "claimed_publication_timing", "retrieved_after_cutoff", "window_beyond_retrieval")


@query("append_to_log", LOG_SQL + """, old AS (SELECT * FROM log WHERE observation_id % 3 <> 0), stored AS (SELECT observation_id, user_id, sha256, retrieved_at,
    min(retrieved_at) OVER (PARTITION BY user_id, sha256) AS first_observed_at, lag(observation_id) OVER (PARTITION BY user_id ORDER BY retrieved_at, observation_id) AS previous_observation FROM old),
  stored_2 AS (SELECT * FROM stored UNION ALL SELECT -observation_id - 1, user_id, sha256, retrieved_at, first_observed_at, observation_id FROM stored WHERE observation_id % 50 = 1),
  late AS (SELECT l.observation_id, l.user_id, l.sha256, l.retrieved_at, lag(l.observation_id) OVER (PARTITION BY l.user_id ORDER BY l.retrieved_at, l.observation_id) AS previous_observation,
    min(l.retrieved_at) OVER (PARTITION BY l.user_id, l.sha256) AS first_new FROM log l WHERE observation_id % 3 = 0),
  first_s AS (SELECT user_id, sha256, min(first_observed_at) AS first_old FROM stored_2 GROUP BY ALL), last_s AS (SELECT user_id, arg_max(observation_id, (retrieved_at, observation_id)) AS last_old FROM stored_2 GROUP BY 1)
  SELECT observation_id, epoch_us(first_observed_at) AS first_observed_at, previous_observation FROM stored_2
  UNION ALL SELECT observation_id, epoch_us(least(first_new, first_old)), coalesce(previous_observation, last_old) FROM late LEFT JOIN first_s USING (user_id, sha256) LEFT JOIN last_s USING (user_id)""", base="")
def append_to_log(t):
    """A log is stored, some of it reviewed, and the rest appended: stored rows keep their links."""
    new = new_rows(t)
    old = obslog.append_observations(None, new.filter(F.col("observation_id") % 3 != 0), ["user_id"])
    some = old.filter(F.col("observation_id") % 50 == 1)
    reviews = some.select((-F.col("observation_id") - 1).alias("observation_id"), F.col("observation_id").alias("reviews"), F.lit("second").alias("reviewed_by"), F.col("retrieved_at").alias("reviewed_at"))
    stored = materialize(obslog.append_reviews(old, reviews))
    d = obslog.append_observations(stored, new.filter(F.col("observation_id") % 3 == 0), ["user_id"])
    return d.select("observation_id", F.unix_micros(F.col("first_observed_at").cast("timestamp")).alias("first_observed_at"), "previous_observation")


@query("official_sources", LOG_SQL + """ SELECT observation_id FROM log WHERE observation_id % 6 IN (0, 3, 5) AND (provider IN ('purchase', 'signup') AND observation_id % 11 <> 0 OR provider = 'view')""", base="")
def official_sources(t):
    """Official by provider at its own host, or by approved host; some addresses have another
    scheme, a user part, a port, or another host."""
    d = log(t)
    kind, host = F.col("observation_id") % 6, F.concat("provider", F.lit(".example.org"))
    host = F.when((F.col("observation_id") % 11 == 0) & (F.col("provider") != "view"), F.lit("copy.example.net")).otherwise(host)
    start = F.when(kind == 1, "http://").when(kind == 2, "https://me:secret@").otherwise("https://")
    port = F.when(kind == 3, ":443").when(kind == 4, ":8080").otherwise("")
    d = d.withColumn("uri", F.concat(start, host, port, F.lit("/"), F.col("user_id").cast("string")))
    return obslog.official(d, {p: [f"{p}.example.org"] for p in ("purchase", "signup")}, ["view.example.org"]).select("observation_id")


@query("log_inventory", LOG_SQL + """, e AS (SELECT user_id, sha256, count(*) AS n, min(retrieved_at) AS first, count(reviewed_by) AS reviewed FROM log GROUP BY ALL)
  SELECT user_id, CAST(sum(n) AS BIGINT) AS observations, epoch_us(min(first)) // 1000000 AS first_observed_at, CAST(sum(reviewed) AS BIGINT) AS reviewed,
  CAST(sum(CAST(CAST(concat('0x', substr(sha256(sha256 || ':' || n), 1, 15)) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM e GROUP BY 1""", base="")
def log_inventory(t):
    return obslog.inventory(log(t), ["user_id"]).select("user_id", "observations", secs("first_observed_at"), "reviewed", "digest")
