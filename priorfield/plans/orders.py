"""Preset: the order tables read as event sequences.

An order is an event, a supplier in it an entrant, the supplier's nation its group, the
customer's nation the venue and the order year the season. Entrants of an order are ranked by
the price of their first line. Money is kept in cents and probabilities in 1/256 steps, so
sums are exact and do not depend on the order of addition.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.expr import flag
from ..operators.hot import HotGroups, deal, find_hot
from ..operators.joins import lookup
from ..operators.windows import first_per, rank_first
from ..session import materialize

EVENT_ORDER = ["event_date", "event_id"]
TRAIN_END, VALIDATION, TEST_START = 1998, 1999, 2000


class OrderTables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # Counted on two narrow columns of the raw lines: an upper bound for every later frame.
    @cached_property
    def hot_event(self) -> HotGroups:
        return find_hot(self.read("lineitem").select(F.col("l_orderkey").alias("event_id")), ["event_id"])

    @cached_property
    def hot_entrant(self) -> HotGroups:
        return find_hot(self.read("lineitem").select(F.col("l_suppkey").alias("entrant")), ["entrant"])

    @cached_property
    def hot_group(self) -> HotGroups:
        """Groups by their number of lines: counted per supplier first, then per nation."""
        n = self.read("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
        d = n.join(self.read("supplier").select("s_suppkey", F.col("s_nationkey").alias("grp")), "s_suppkey")
        return find_hot(d, ["grp"], weight="n")

    @cached_property
    def hot_venue(self) -> HotGroups:
        n = self.read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
        d = n.join(self.read("customer").select("c_custkey", F.col("c_nationkey").alias("venue")), "c_custkey")
        return find_hot(d, ["venue"], weight="n")

    @cached_property
    def hot_all(self) -> HotGroups:
        """The whole list of events as one group, for global sequences."""
        n = self.read("orders").select(F.lit(1).alias("_all"))
        return find_hot(n, ["_all"])

    def saved(self, *cols: str) -> DataFrame:
        """The history frame written once, for plans that read it in several branches."""
        d = self.entries()
        return materialize(d.select(*cols) if cols else d)

    def events(self) -> DataFrame:
        """One row per event: date, season, venue."""
        o = self.read("orders").select(
            F.col("o_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("event_date"), F.col("o_custkey").alias("c_custkey"))
        c = self.read("customer").select("c_custkey", F.col("c_nationkey").alias("venue"))
        return lookup(o, c, "c_custkey", find_hot(o, ["c_custkey"])).select(
            "event_id", "event_date", F.year("event_date").alias("season"), F.month("event_date").alias("month"), "venue")

    def lines(self) -> DataFrame:
        """One row per (event, entrant): its first line, and the quantity summed over all."""
        raw = self.read("lineitem").select(
            F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("entrant"), F.col("l_linenumber").alias("slot"),
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_partkey").alias("partkey"),
            F.col("l_quantity").cast("long").alias("qty"), F.round(F.col("l_discount") * 100).cast("int").alias("disc"),
            F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
        return first_per(deal(raw, self.hot_event), ["event_id", "entrant"], ["slot", "cents", "partkey"], qty_sum=F.sum("qty"))

    def entries(self) -> DataFrame:
        """The history frame: one row per (event, entrant) with outcomes."""
        s = self.read("supplier").select(F.col("s_suppkey").alias("entrant"), F.col("s_nationkey").alias("grp"))
        d = lookup(self.lines(), s, "entrant", self.hot_entrant)
        d = lookup(d, self.events(), "event_id", self.hot_event).filter(F.col("event_date").isNotNull())
        d = rank_first(d.withColumn("_down", -F.col("cents")), "event_id", ["_down", "entrant"], "finish_order",
                       self.hot_event).drop("_down")
        position = F.when(F.col("flag") != "R", F.col("finish_order"))
        points = F.greatest(F.col("qty_sum") - 25, F.lit(0))
        return d.select(
            "event_id", "event_date", "season", "month", "venue", "entrant", "grp", "slot", "cents", "partkey", "qty", "qty_sum",
            "disc", "flag", "status", "finish_order", position.alias("position"), points.alias("points"),
            flag(points > 0).alias("points_finish"), flag(position <= 3).alias("podium"), flag(position == 1).alias("win"),
            flag(F.col("flag") == "R").alias("dnf"), flag(position.isNotNull()).alias("classified"),
            F.when(F.col("status") == "O", F.col("slot")).alias("start_slot"),
            F.when(F.col("flag") != "A", F.col("slot")).alias("qual_slot"),
            (F.col("slot") - position).alias("gained"), (50 - F.col("qty")).alias("score"),
            ((F.col("qty") + 3) / 256.0).alias("p_win"), ((F.col("qty") + 1) / 128.0).alias("p_podium"),
            ((F.col("qty") + F.col("disc") + 1) / 64.0).alias("p_points"),
            F.when(F.col("season") <= TRAIN_END, "train").when(F.col("season") == VALIDATION, "validation")
            .when(F.col("season") >= TEST_START, "test").alias("split"))


# The same frames as SQL common table expressions, for checks against another engine.
EVENTS_SQL = """events_t AS (
  SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS event_date, CAST(year(o_orderdate) AS INTEGER) AS season,
         CAST(month(o_orderdate) AS INTEGER) AS month, c_nationkey AS venue
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey)"""

ENTRIES_SQL = EVENTS_SQL + """, lines_t AS (
  SELECT l_orderkey AS event_id, l_suppkey AS entrant, l_linenumber AS slot, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         l_partkey AS partkey, CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_discount * 100) AS INTEGER) AS disc,
         l_returnflag AS flag, l_linestatus AS status
  FROM lineitem), kept_t AS (
  SELECT *, CAST(sum(qty) OVER (PARTITION BY event_id, entrant) AS BIGINT) AS qty_sum,
         row_number() OVER (PARTITION BY event_id, entrant ORDER BY slot, cents, partkey, qty, disc, flag, status) AS rn
  FROM lines_t), ranked_t AS (
  SELECT k.* EXCLUDE (rn), e.event_date, e.season, e.month, e.venue, s_nationkey AS grp,
         row_number() OVER (PARTITION BY k.event_id ORDER BY cents DESC, entrant) AS finish_order
  FROM kept_t k JOIN events_t e ON e.event_id = k.event_id LEFT JOIN supplier ON s_suppkey = entrant WHERE rn = 1), entries AS (
  SELECT *, CASE WHEN flag <> 'R' THEN finish_order END AS position, greatest(qty_sum - 25, 0) AS points,
         CAST(qty_sum > 25 AS INTEGER) AS points_finish,
         CAST(flag <> 'R' AND finish_order <= 3 AS INTEGER) AS podium, CAST(flag <> 'R' AND finish_order = 1 AS INTEGER) AS win,
         CAST(flag = 'R' AS INTEGER) AS dnf, CAST(flag <> 'R' AS INTEGER) AS classified,
         CASE WHEN status = 'O' THEN slot END AS start_slot, CASE WHEN flag <> 'A' THEN slot END AS qual_slot,
         CASE WHEN flag <> 'R' THEN slot - finish_order END AS gained, 50 - qty AS score,
         CAST(qty + 3 AS DOUBLE) / 256 AS p_win, CAST(qty + 1 AS DOUBLE) / 128 AS p_podium, CAST(qty + disc + 1 AS DOUBLE) / 64 AS p_points,
         CASE WHEN season <= 1998 THEN 'train' WHEN season = 1999 THEN 'validation' ELSE 'test' END AS split
  FROM ranked_t)"""
