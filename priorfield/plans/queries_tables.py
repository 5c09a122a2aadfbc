"""Sources, projections, scalar expressions, joins, set operations, summaries and rules."""

from __future__ import annotations

import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions import expr as x
from ..operators import joins, quality, ranges, rollups, scoring, windows as w
from ..session import shared_dir
from ..sources import io
from .orders import EVENT_ORDER
from .registry import query


def _scratch(t, name):
    import uuid

    return f"{shared_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks -----------------------------------------------------------------------

@query("csv_tables", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders", base="")
def csv_tables(t):
    """Write a table as CSV and read it back with a declared schema."""
    d = _scratch(t, "csv")
    io.write_table(t.read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), f"{d}/orders.csv", "csv")
    return io.read_tables(t.spark, d, {"orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"})["orders"]


@query("partitioned_splits", "SELECT event_id, entrant, split, points FROM entries WHERE split IN ('train', 'validation')")
def partitioned_splits(t):
    """The feature table by split; the held-out folder is not read."""
    d = _scratch(t, "splits")
    io.write_feature_table(t.entries().select("event_id", "entrant", "points", "split"), d)
    return io.read_splits(t.spark, d, ["train", "validation"]).select("event_id", "entrant", "split", "points")


@query("feature_round_trip", "SELECT event_id, entrant, qty, disc, flag FROM entries")
def feature_round_trip(t):
    d = _scratch(t, "features")
    e = t.entries().select("event_id", "entrant", "qty", "disc", "flag")
    io.save_features(e, d)
    return io.load_features(t.spark, d, e.schema)


@query("bounded_read", """SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE year(o_orderdate) <= 1997) GROUP BY 1""", base="")
def bounded_read(t):
    o = t.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    end = datetime.datetime(1997, 12, 31, 23, 59, 59)
    got = io.read_bounded(o, {"lineitem": t.read("lineitem").select("l_orderkey")}, "l_orderkey", "o_orderdate", end)
    return got["lineitem"].groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("column_limited_read", "SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem GROUP BY 1", base="")
def column_limited_read(t):
    return t.read("lineitem").select("l_returnflag", "l_quantity").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("decision_records", "SELECT o_orderkey AS race_id, o_orderstatus AS reason FROM orders WHERE o_orderpriority = '1-URGENT'", base="")
def decision_records(t):
    """Decision records inside JSON documents, one document per customer."""
    d = _scratch(t, "records")
    r = F.struct(F.col("o_orderkey").alias("race_id"), F.col("o_orderstatus").alias("reason"))
    urgent = t.read("orders").filter(F.col("o_orderpriority") == "1-URGENT")
    part = F.floor(F.col("o_orderkey") / 1000)  # order keys are unique: at most 1000 records per document
    urgent.groupBy("o_custkey", part.alias("part")).agg(F.collect_list(r).alias("records")).select("records").write.json(d)
    return io.read_records(t.spark, d, "records array<struct<race_id:long,reason:string>>", ["race_id", "reason"], ["race_id"], lines=True)


@query("json_rows", """SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders""", base="")
def json_rows(t):
    """NaN and infinities become null in JSON text."""
    p = F.when(F.col("o_custkey") % 14 == 0, F.lit(float("nan"))).when(F.col("o_custkey") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("o_totalprice"))
    j = io.to_json_rows(t.read("orders").select("o_orderkey", p.alias("price")))
    return j.select(F.from_json("json", "o_orderkey long, price double").alias("j")).select("j.*")


@query("write_once", "SELECT o_orderkey, o_orderstatus, 'kept' AS state FROM orders", base="")
def write_once(t):
    """A second write to the same place is refused and leaves the first one alone."""
    d = _scratch(t, "once")
    o = t.read("orders").select("o_orderkey", "o_orderstatus")
    io.write_once(o, d)
    state = "overwritten"
    try:
        io.write_once(o, d)
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        state = "kept"
    return t.spark.read.parquet(d).withColumn("state", F.lit(state))


PAGE = "struct<total:long,offset:long,rows:array<struct<id:long,kind:string>>>"


def _pages(t):
    """Events as captured API pages: per user and day, pages of up to 5 rows."""
    d = t.read("events").select("event_id", "user_id", F.to_date("ts").cast("string").alias("day"), "event_type")
    d = w.rank_first(d, ["user_id", "day"], ["event_id"], "r")
    d = w.attach_group(d, ["user_id", "day"], n=F.count(F.lit(1)))
    page = F.floor((F.col("r") - 1) / 5).cast("long")
    g = d.groupBy("user_id", "day", "n", page.alias("page")).agg(
        F.collect_list(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("rows"))
    body = F.struct(F.col("n").alias("total"), (F.col("page") * 5).alias("offset"), "rows")
    return g.select("user_id", "day", F.to_json(body).alias("payload"))


@query("flatten_pages", """SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS total, event_id AS id, event_type AS kind FROM events""", base="")
def flatten_pages(t):
    d = io.flatten_pages(_pages(t), "payload", PAGE, "rows", ["user_id", "day"])
    return d.select("user_id", "day", "total", "item.id", "item.kind")


@query("page_conflicts", """SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events GROUP BY 1, 2 HAVING count(*) % 2 = 0""", base="")
def page_conflicts(t):
    """Captures whose declared total is wrong; here every even total is raised by one."""
    p = _pages(t)
    total = F.get_json_object("payload", "$.total").cast("long")
    wrong = F.regexp_replace(F.col("payload"), F.lit('"total":[0-9]+'), F.concat(F.lit('"total":'), (total + 1).cast("string")))
    p = p.withColumn("payload", F.when(total % 2 == 0, wrong).otherwise(F.col("payload")))
    return io.page_conflicts(p, "payload", PAGE, "rows", ["user_id", "day"]).select("user_id", "day")


@query("completed_ledger", """SELECT o_orderkey AS event_id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'left' ELSE 'right' END AS side FROM orders
  WHERE (o_orderkey IN (SELECT l_orderkey FROM lineitem)) <> (o_orderstatus = 'F')""", base="")
def completed_ledger(t):
    """Events with lines against the ledger of orders with status F."""
    done = t.read("lineitem").select(F.col("l_orderkey").alias("event_id"))
    declared = t.read("orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("event_id"))
    return io.completed_ledger(done, declared, "event_id")


@query("forecast_documents", """, m AS (SELECT event_id, entrant, p_win, p_podium, p_points, row_number() OVER (PARTITION BY event_id ORDER BY score, entrant) AS o FROM entries)
  SELECT CAST(event_id AS VARCHAR) AS snapshot_id, 'quantity' AS method, CAST(entrant AS VARCHAR) AS entrant, CAST(o AS INTEGER) AS predicted_order, 'raw' AS stage, p_win, p_podium, p_points FROM m
  UNION ALL SELECT CAST(event_id AS VARCHAR), 'order_only', CAST(entrant AS VARCHAR), CAST(o AS INTEGER), NULL, NULL, NULL, NULL FROM m""")
def forecast_documents(t):
    """Forecast documents written as JSON, read back and flattened; order-only methods carry no stage.

    A document holds at most 1000 entrants; larger events take several documents of one snapshot.
    """
    e = w.rank_first(t.entries(), "event_id", ["score", "entrant"], "o", t.hot_event)
    p = F.struct(F.col("p_win").alias("win"), F.col("p_podium").alias("podium"), F.col("p_points").alias("points"))
    row = [F.col("entrant").cast("string").alias("entrant"), F.col("o").cast("int").alias("predicted_order"), F.col("score").cast("double").alias("rank_score")]
    e = e.select("event_id", F.floor(F.col("o") / 1000).alias("part"), F.struct(*row, F.create_map(F.lit("raw"), p).alias("stages")).alias("full"),
                 F.struct(*row, F.lit(None).cast("map<string,struct<win:double,podium:double,points:double>>").alias("stages")).alias("bare"))
    g = e.groupBy("event_id", "part").agg(F.collect_list("full").alias("a"), F.collect_list("bare").alias("b"))
    docs = g.select(F.col("event_id").cast("string").alias("snapshot_id"), F.array(
        F.struct(F.lit("quantity").alias("method"), F.col("a").alias("drivers")), F.struct(F.lit("order_only").alias("method"), F.col("b").alias("drivers"))).alias("methods"))
    d = _scratch(t, "forecasts")
    docs.write.json(d)
    return io.flatten_forecasts(t.spark.read.schema(io.FORECAST_SCHEMA).json(d)).drop("rank_score")


# --- projections and scalar expressions ------------------------------------------------------

@query("project_rename", "SELECT o_orderkey AS race_id, o_custkey AS venue_key, o_orderpriority AS format FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998", base="")
def project_rename(t):
    d = t.read("orders").filter((F.col("o_orderdate") >= F.lit(datetime.datetime(1996, 1, 1))) & (F.col("o_orderdate") < F.lit(datetime.datetime(1999, 1, 1))))
    return d.select(F.col("o_orderkey").alias("race_id"), F.col("o_custkey").alias("venue_key"), F.col("o_orderpriority").alias("format"))


@query("eligible_rows", "SELECT event_id, entrant FROM entries WHERE classified = 1 AND split = 'train'")
def eligible_rows(t):
    return t.entries().filter((F.col("classified") == 1) & (F.col("split") == "train")).select("event_id", "entrant")


@query("number_parsing", """SELECT o_orderkey, try_cast(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS level, try_cast(o_orderpriority AS DOUBLE) AS bad,
  try_cast(o_totalprice AS DOUBLE) AS price, CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS strict_level FROM orders""", base="")
def number_parsing(t):
    level = F.split_part("o_orderpriority", F.lit("-"), F.lit(1))
    return t.read("orders").select("o_orderkey", x.number(level).alias("level"), x.number("o_orderpriority").alias("bad"),
                                   x.number(F.col("o_totalprice").cast("string")).alias("price"), x.strict_number(level).alias("strict_level"))


@query("date_parts", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, CAST(month(o_orderdate) AS INTEGER) AS month,
  round(date_diff('day', CAST('1970-06-15' AS DATE), CAST(o_orderdate AS DATE)) / 365.2425, 6) AS age,
  CAST(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS VARCHAR) AS parsed FROM orders""", base="")
def date_parts(t):
    d = t.read("orders").withColumn("born", F.lit("1970-06-15").cast("date"))
    text = F.when(F.col("o_orderstatus") == "F", F.lit("soon")).otherwise(x.iso_date("o_orderdate"))
    return d.select("o_orderkey", x.iso_date("o_orderdate").alias("iso"), F.month("o_orderdate").alias("month"),
                    F.round(x.age_years("born", F.to_date("o_orderdate")), 6).alias("age"), x.parse_date(text).cast("string").alias("parsed"))


@query("safe_arithmetic", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS DOUBLE) / nullif(round(l_discount * 100), 0) AS per_discount,
  CASE WHEN l_quantity % 10 = 0 THEN NULL ELSE l_quantity END AS finite, CAST(round_even(l_quantity / 2, 0) AS DOUBLE) AS half_even FROM lineitem""", base="")
def safe_arithmetic(t):
    q = F.when(F.col("l_quantity") % 10 == 0, F.lit(float("inf"))).otherwise(F.col("l_quantity"))
    return t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", x.safe_divide("l_quantity", F.round(F.col("l_discount") * 100)).alias("per_discount"),
                                     x.finite_or_null(q).alias("finite"), x.half_even(F.col("l_quantity") / 2).alias("half_even"))


@query("ten_digits", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(printf('%.10g', l_extendedprice / 7) AS DOUBLE) AS v FROM lineitem", base="")
def ten_digits(t):
    return t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", x.ten_digits(F.col("l_extendedprice") / 7).alias("v"))


@query("sigmoid_logit", """SELECT l_orderkey, l_linenumber, l_partkey, round(1 / (1 + exp(-least(greatest(l_quantity - 25, -35), 35))), 9) AS s,
  round(ln((l_quantity / 64) / (1 - l_quantity / 64)), 9) AS l FROM lineitem""", base="")
def sigmoid_logit(t):
    return t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(x.sigmoid(F.col("l_quantity") - 25), 9).alias("s"),
                                     F.round(x.logit(F.col("l_quantity") / 64), 9).alias("l"))


@query("zoned_timestamps", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN epoch_us(ts) // 1000000 ELSE epoch_us(ts) // 1000000 - 7200 END AS seconds,
  epoch_us(ts - INTERVAL 24 HOUR) // 1000000 AS cutoff FROM events""", base="")
def zoned_timestamps(t):
    """Text with a zone is taken to UTC; text without one is rejected."""
    zone = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "Z").otherwise("+02:00")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return t.read("events").select("event_id", F.unix_timestamp(x.utc_timestamp(text)).alias("seconds"), F.unix_timestamp(x.scheduled_cutoff("ts")).alias("cutoff"))


@query("identifier_patterns", """SELECT doc_id, CAST(regexp_full_match(source, '[A-Za-z0-9][A-Za-z0-9._-]{0,99}') AS INTEGER) AS id_ok, CAST(regexp_full_match(text, '[A-Za-z0-9][A-Za-z0-9._-]{0,99}') AS INTEGER) AS text_ok,
  CAST(regexp_full_match(sha256(text), '[0-9a-f]{64}') AS INTEGER) AS digest_ok, sha256(text) AS digest FROM documents""", base="")
def identifier_patterns(t):
    d = t.read("documents").withColumn("digest", F.sha2("text", 256))
    return d.select("doc_id", x.is_identifier("source").cast("int").alias("id_ok"), x.is_identifier("text").cast("int").alias("text_ok"),
                    x.is_digest("digest").cast("int").alias("digest_ok"), "digest")


PORTED = """regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || CASE page_id % 6 WHEN 0 THEN ':443' WHEN 3 THEN ':8080' ELSE '' END || regexp_extract(url, '^[a-z]+://[^/?#]+(.*)$', 1)"""


@query("url_rules", f"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host,
  CAST(regexp_matches(url, '^https://(thther[.]example[.]org|therha[.]example[.]com)(:443)?([/?#]|$)') AS INTEGER) AS listed FROM (SELECT page_id, """ + PORTED + """ AS url FROM pages)""", base="")
def url_rules(t):
    """Https addresses of listed hosts; every third page gets port 443 or 8080."""
    port = F.when(F.col("page_id") % 6 == 0, ":443").when(F.col("page_id") % 6 == 3, ":8080").otherwise("")
    p = t.read("pages").withColumn("url", F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1), port, F.regexp_extract("url", "^[a-z]+://[^/?#]+(.*)$", 1)))
    return p.select("page_id", x.url_host("url").alias("host"), x.flag(x.url_allowed("url", ["thther.example.org", "therha.example.com"])).alias("listed"))


@query("canonical_digest", """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS digest FROM orders""", base="")
def canonical_digest(t):
    return t.read("orders").select("o_orderkey", x.canonical_sha256("o_orderstatus", "o_orderkey", "o_custkey").alias("digest"))


@query("nested_membership", """SELECT event_id, CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 5 = user_id % 5 AS INTEGER) AS paired, CAST(event_type IN ('click', 'view') AS INTEGER) AS member,
  CASE event_type WHEN 'click' THEN 60 WHEN 'view' THEN 3600 ELSE 0 END AS limit_s, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""", base="")
def nested_membership(t):
    """JSON fields, pairs in an array, set equality of lists and map lookup with a default."""
    d = t.read("events").withColumn("k", F.from_json("props", "k long")["k"])
    d = d.withColumn("pairs", F.array(F.struct((F.col("k") % 5).alias("a"), F.col("event_type").alias("b")), F.struct(F.lit(-1).cast("long").alias("a"), F.lit("none").alias("b"))))
    d = d.withColumn("u", F.col("user_id") % 5).withColumn("limits", F.create_map(F.lit("click"), F.lit(60), F.lit("view"), F.lit(3600)))
    same = x.same_members(F.array_distinct(F.array(F.col("event_type"), F.lit("click"), F.lit("view"))), F.array(F.lit("view"), F.lit("click")))
    return d.select("event_id", x.has_pair("pairs", "u", "event_type").cast("int").alias("paired"), same.cast("int").alias("member"),
                    x.map_get("limits", "event_type", 0).alias("limit_s"), "k")


@query("display_text", """SELECT l_orderkey, l_linenumber, l_partkey, printf('%.3f', l_quantity / 8) AS fixed, CASE WHEN l_returnflag = 'R' THEN 'n/a' ELSE printf('%.1f%%', l_quantity / 50 * 100) END AS pct FROM lineitem""", base="")
def display_text(t):
    v = F.when(F.col("l_returnflag") != "R", F.col("l_quantity") / 50)
    return t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", x.fixed_digits(F.col("l_quantity") / 8, 3).alias("fixed"), x.percent(v).alias("pct"))


@query("display_names", """SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' ' || CAST(c_nationkey AS VARCHAR) AS name FROM customer""", base="")
def display_names(t):
    return t.read("customer").select("c_custkey", x.display_name(F.concat_ws("-", F.lower("c_mktsegment"), F.col("c_nationkey").cast("string"))).alias("name"))


@query("search_forecast", """SELECT event_id, entrant, s_name, grp, p_win FROM entries JOIN supplier ON s_suppkey = entrant WHERE lower(s_name || ' ' || grp) LIKE '%#00000001%'""")
def search_forecast(t):
    s = t.read("supplier").select(F.col("s_suppkey").alias("entrant"), "s_name")
    d = joins.lookup(t.entries().select("event_id", "entrant", "grp", "p_win"), s, "entrant", t.hot_entrant)
    return scoring.search_forecast(d, "#00000001", ["s_name", "grp"], "p_win", "entrant").select("event_id", "entrant", "s_name", "grp", "p_win")


# --- joins and set operations ----------------------------------------------------------------

@query("join_checked", "SELECT o_orderkey, c_nationkey, n_name FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey", base="")
def join_checked(t):
    c = t.read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    d = joins.join_checked(t.read("orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"], "inner")
    n = t.read("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.join_checked(d, n, ["c_nationkey"], "left").select("o_orderkey", "c_nationkey", "n_name")


@query("join_null_keys", """, a AS (SELECT start_slot AS k, count(*) AS n FROM entries GROUP BY 1), b AS (SELECT qual_slot AS k, count(*) AS m FROM entries GROUP BY 1)
  SELECT a.k, n, m FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def join_null_keys(t):
    e = t.entries()
    a = e.groupBy(F.col("start_slot").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = e.groupBy(F.col("qual_slot").alias("k")).agg(F.count(F.lit(1)).alias("m"))
    return joins.join_nullsafe(a, b, ["k"])


@query("calendar_join", """SELECT season, count(*) AS n, CAST(sum(CASE WHEN year(l_shipdate) = season THEN 1 ELSE 0 END) AS BIGINT) AS agree FROM lineitem JOIN events_t ON event_id = l_orderkey GROUP BY 1""", base="events")
def calendar_join(t):
    li = t.read("lineitem").select(F.col("l_orderkey").alias("event_id"), F.year("l_shipdate").alias("line_season"))
    d = joins.lookup(li, t.events().select("event_id", "season"), "event_id", t.hot_event).filter(F.col("season").isNotNull())
    return d.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("line_season") == F.col("season")).cast("long")).alias("agree"))


@query("calendar_disagreement", """SELECT 'agreement' AS rule, CAST(o_orderkey AS VARCHAR) AS key, 'season' AS detail FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  WHERE year(s) <> year(o_orderdate)""", base="")
def calendar_disagreement(t):
    first = t.read("lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.year(F.min("l_shipdate")).alias("season"))
    return quality.check_agreement(first, t.events().select("event_id", "season"), ["event_id"], ["season"])


@query("dimension_lookup", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand, s_nationkey FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey""", base="")
def dimension_lookup(t):
    d = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = t.read("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    s = t.read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return joins.lookup(joins.lookup(d, p, "l_partkey"), s, "l_suppkey", t.hot_entrant.renamed("l_suppkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_brand", "s_nationkey")


@query("map_winner_to_rows", """, w AS (SELECT event_id, min(entrant) AS winner FROM entries WHERE win = 1 GROUP BY 1) SELECT event_id, entrant, winner FROM entries LEFT JOIN w USING (event_id)""")
def map_winner_to_rows(t):
    return w.attach_group(t.entries(), ["event_id"], t.hot_event, winner=F.min(F.when(F.col("win") == 1, F.col("entrant")))).select("event_id", "entrant", "winner")


@query("semi_join", "SELECT event_id, venue FROM events_t WHERE event_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)", base="events")
def semi_join(t):
    k = t.read("lineitem").filter(F.col("l_quantity") == 50).select(F.col("l_orderkey").alias("event_id"))
    return joins.semi(t.events(), k, ["event_id"]).select("event_id", "venue")


@query("anti_join", "SELECT event_id, venue FROM events_t WHERE event_id NOT IN (SELECT l_orderkey FROM lineitem)", base="events")
def anti_join(t):
    return joins.anti(t.events(), t.read("lineitem").select(F.col("l_orderkey").alias("event_id")), ["event_id"]).select("event_id", "venue")


@query("aligned_join", """SELECT event_id, entrant, points, p_points FROM entries""")
def aligned_join(t):
    """Features and labels joined one to one, with equal key sets on both sides."""
    e = t.entries()
    f, y = e.select("event_id", "entrant", "p_points"), e.select("event_id", "entrant", "points")
    gaps = joins.key_diff(f, y, ["event_id", "entrant"])
    quality.strict(quality.report(gaps, "aligned", ["event_id", "entrant"], F.col("side")))
    return joins.join_checked(f, y, ["event_id", "entrant"], "inner", "one_to_one").select("event_id", "entrant", "points", "p_points")


@query("source_conflicts", """, a AS (SELECT season || ':' || venue AS k, min(event_date) AS d FROM events_t GROUP BY 1), b AS (SELECT season || ':' || grp AS k, min(event_date) AS d FROM entries GROUP BY 1)
  SELECT k, CAST(a.d AS VARCHAR) AS left_value, CAST(b.d AS VARCHAR) AS right_value FROM a FULL JOIN b USING (k) WHERE a.d IS DISTINCT FROM b.d""")
def source_conflicts(t):
    """First day of each venue and of each group in every season, from two sources."""
    def first(d, c):
        key = F.concat_ws(":", F.col("season").cast("string"), F.col(c).cast("string")).alias("k")
        return d.groupBy(key).agg(F.min("event_date").cast("string").alias("d"))

    return joins.source_conflicts(first(t.events(), "venue"), first(t.entries(), "grp"), "k", "d")


@query("exact_identity_lookup", """, r AS (SELECT season, entrant, grp, max(qty) AS best FROM entries WHERE season = 1998 GROUP BY ALL) SELECT e.event_id, e.entrant, r.best FROM entries e
  LEFT JOIN r ON r.season = e.season AND r.entrant = e.entrant AND r.grp = e.grp""")
def exact_identity_lookup(t):
    """Three keys must match; other seasons and groups are no fallback."""
    e = t.entries()
    r = e.filter(F.col("season") == 1998).groupBy("season", "entrant", "grp").agg(F.max("qty").alias("best"))
    return joins.join_nullsafe(e.select("event_id", "season", "entrant", "grp"), r, ["season", "entrant", "grp"], "left").select("event_id", "entrant", "best")


@query("overlay_corrections", "SELECT event_id, CASE WHEN month = 12 THEN season + 1 ELSE season END AS season, CASE WHEN month = 12 AND venue % 2 = 0 THEN -1 ELSE venue END AS venue FROM events_t", base="events")
def overlay_corrections(t):
    e = t.events().select("event_id", "season", "venue", "month")
    fix = e.filter(F.col("month") == 12).select("event_id", (F.col("season") + 1).alias("season"), F.when(F.col("venue") % 2 == 0, F.lit(-1)).alias("venue"))
    return joins.overlay(e, fix, ["event_id"], ["season", "venue"]).select("event_id", "season", "venue")


@query("enrich_entries", "SELECT event_id, entrant, CASE WHEN flag = 'N' THEN -5 ELSE grp END AS grp, CASE WHEN flag = 'A' THEN CAST(0.5 AS DOUBLE) ELSE s_acctbal END AS balance FROM entries JOIN supplier ON s_suppkey = entrant")
def enrich_entries(t):
    """Given values win over the registry."""
    d = t.entries().select("event_id", "entrant", F.when(F.col("flag") == "N", F.lit(-5)).alias("grp"), F.when(F.col("flag") == "A", F.lit(0.5)).alias("balance"))
    reg = t.read("supplier").select(F.col("s_suppkey").alias("entrant"), F.col("s_nationkey").alias("grp"), F.col("s_acctbal").alias("balance"))
    return joins.enrich(d, reg, ["entrant"], ["grp", "balance"])


@query("rebuilt_entries", """, a AS (SELECT event_id, entrant, start_slot FROM entries WHERE status = 'O'), b AS (SELECT event_id, entrant, qual_slot FROM entries WHERE flag <> 'A'),
  k AS (SELECT event_id, entrant FROM a UNION SELECT event_id, entrant FROM b) SELECT event_id, entrant, CASE WHEN a.event_id IS NOT NULL THEN start_slot ELSE qual_slot END AS slot, qual_slot
  FROM k LEFT JOIN a USING (event_id, entrant) LEFT JOIN b USING (event_id, entrant)""".replace("a.event_id IS NOT NULL", "a.start_slot IS NOT NULL"))
def rebuilt_entries(t):
    """Keys of both sources, slot record first, qualifying as the fallback."""
    e = t.entries()
    a = e.filter(F.col("status") == "O").select("event_id", "entrant", "start_slot", F.lit(1).alias("has"))
    b = e.filter(F.col("flag") != "A").select("event_id", "entrant", "qual_slot")
    key = ["event_id", "entrant"]
    d = joins.join_nullsafe(joins.join_nullsafe(joins.entrant_keys(a.select(*key), b.select(*key)), a, key, "left"), b, key, "left")
    return d.select(*key, x.prefer_record(F.col("has").isNotNull(), "start_slot", "qual_slot").alias("slot"), "qual_slot")


@query("entrant_key_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation", base="")
def entrant_key_union(t):
    return joins.entrant_keys(t.read("customer").select(F.col("c_nationkey").alias("k")), t.read("supplier").select(F.col("s_nationkey").alias("k")),
                              t.read("nation").select(F.col("n_nationkey").alias("k")))


@query("key_difference", """SELECT k, side FROM (SELECT o_orderkey AS k, 'left' AS side FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '2-HIGH' UNION ALL
  SELECT o_orderkey, 'right' FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority = '2-HIGH')""", base="")
def key_difference(t):
    o = t.read("orders").withColumnRenamed("o_orderkey", "k")
    return joins.key_diff(o.filter(F.col("o_orderstatus") == "F"), o.filter(F.col("o_orderpriority") == "2-HIGH"), ["k"])


@query("top_k_overlap", """, a AS (SELECT event_id, entrant FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score, entrant) AS r FROM entries) WHERE r <= 3)
  SELECT event_id, count(*) AS common FROM a JOIN entries USING (event_id, entrant) WHERE finish_order <= 3 GROUP BY 1""")
def top_k_overlap(t):
    e = t.entries().select("event_id", "entrant", "score", "finish_order")
    a = w.top_k(e, "event_id", ["score", "entrant"], 3).select("event_id", "entrant")
    return e.filter(F.col("finish_order") <= 3).join(a, ["event_id", "entrant"]).groupBy("event_id").agg(F.count(F.lit(1)).alias("common"))


@query("duplicate_members", """SELECT l_orderkey, l_linenumber, l_partkey, copies FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies FROM lineitem) WHERE copies > 1""", base="")
def duplicate_members(t):
    return joins.duplicates(t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


@query("union_batches", "SELECT batch, count(*) AS n, CAST(sum(points) AS BIGINT) AS points FROM (SELECT 'a' AS batch, points FROM entries WHERE season = 1997 UNION ALL SELECT 'b', points FROM entries WHERE season = 1998) GROUP BY 1")
def union_batches(t):
    e = t.entries()
    parts = [e.filter(F.col("season") == s).select(F.lit(b).alias("batch"), "points") for b, s in (("a", 1997), ("b", 1998))]
    return rollups.union_all(parts).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("points").alias("points"))


@query("union_season_batches", "SELECT CAST(season AS VARCHAR) AS batch, count(*) AS n, CAST(sum(points) AS BIGINT) AS points FROM entries GROUP BY 1")
def union_season_batches(t):
    """One batch for each season found in the table, so that no row is lost."""
    e = t.saved("season", "points")
    seasons = sorted((r["season"] for r in e.select("season").distinct().collect()), key=lambda s: (s is None, s)) or [None]
    parts = [e.filter(F.col("season").eqNullSafe(F.lit(s))).select(F.lit(s).cast("string").alias("batch"), "points") for s in seasons]
    return rollups.union_all(parts).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("points").alias("points"))


@query("table_difference", """SELECT event_id, entrant, 'qty' AS "column", CAST(qty AS DOUBLE) AS left_value, CAST(qty AS DOUBLE) + 0.5 AS right_value FROM entries WHERE slot = 2
  UNION ALL SELECT event_id, entrant, 'qual_slot', CAST(qual_slot AS DOUBLE), NULL FROM entries WHERE slot = 3 AND qual_slot IS NOT NULL""")
def table_difference(t):
    """Key-by-key comparison of two feature tables with a tolerance; null equals null."""
    a = t.entries().select("event_id", "entrant", "slot", "qty", "qual_slot", "start_slot")
    b = a.withColumn("qty", F.when(F.col("slot") == 2, F.col("qty") + 0.5).otherwise(F.col("qty") + 1e-12)).withColumn("qual_slot", F.when(F.col("slot") != 3, F.col("qual_slot")))
    return joins.table_diff(a, b, ["event_id", "entrant"], ["qty", "qual_slot", "start_slot"], atol=1e-9)


# --- summaries -------------------------------------------------------------------------------

@query("split_summary", """SELECT split, count(*) AS rows, CAST(sum(classified) AS BIGINT) AS eligible_rows, count(DISTINCT event_id) AS events, array_to_string(list_sort(list(DISTINCT season)), ',') AS seasons FROM entries GROUP BY 1""")
def split_summary(t):
    d = rollups.split_summary(t.entries(), "split", "event_id", "season", "classified")
    return d.withColumn("seasons", F.concat_ws(",", F.col("seasons").cast("array<string>")))


@query("null_profile", """SELECT 'position' AS "column", count(*) - count(position) AS nulls FROM entries UNION ALL SELECT 'start_slot', count(*) - count(start_slot) FROM entries UNION ALL
  SELECT 'qual_slot', count(*) - count(qual_slot) FROM entries UNION ALL SELECT 'gained', count(*) - count(gained) FROM entries""")
def null_profile(t):
    return rollups.null_profile(t.entries())


@query("value_counts", "SELECT lang, source, count(*) AS count FROM documents GROUP BY ALL", base="")
def value_counts(t):
    return rollups.value_counts(t.read("documents"), "lang", "source")


@query("crosstab", "SELECT flag, count(*) FILTER (status = 'F') AS \"F\", count(*) FILTER (status = 'O') AS \"O\" FROM entries GROUP BY 1")
def crosstab(t):
    return rollups.crosstab(t.entries(), "flag", "status", ["F", "O"])


@query("event_counts", "SELECT event_id, count(*) AS entries, CAST(sum(win) AS BIGINT) AS winners, CAST(sum(podium) AS BIGINT) AS podiums FROM entries GROUP BY 1")
def event_counts(t):
    return rollups.event_counts(t.entries(), "event_id", winners="win", podiums="podium")


@query("unseen_categories", """, v AS (SELECT DISTINCT split, 'slot' AS "column", CAST(slot AS VARCHAR) AS value FROM entries UNION SELECT DISTINCT split, 'cents', CAST(cents AS VARCHAR) FROM entries)
  SELECT split, "column", value FROM v WHERE split <> 'train' AND ("column", value) NOT IN (SELECT "column", value FROM v WHERE split = 'train')""")
def unseen_categories(t):
    return rollups.unseen_categories(t.entries(), "split", ["slot", "cents"])


@query("coverage_census", """, e AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS cust FROM events_t JOIN orders ON o_orderkey = event_id)
  SELECT season, count(*) AS events, count(cust) AS with_cust, CAST(sum(CASE WHEN event_id IN (SELECT l_orderkey FROM lineitem) THEN 1 ELSE 0 END) AS BIGINT) AS in_lines,
  CAST(sum(CASE WHEN event_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 1 ELSE 0 END) AS BIGINT) AS in_returns FROM e GROUP BY 1""", base="events")
def coverage_census(t):
    o = t.read("orders").select(F.col("o_orderkey").alias("event_id"), F.year("o_orderdate").alias("season"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("cust"))
    li = t.read("lineitem").withColumnRenamed("l_orderkey", "event_id")
    return rollups.coverage(o, "event_id", "season", ["cust"], {"lines": li, "returns": li.filter(F.col("l_returnflag") == "R")})


@query("outcome_coverage", """SELECT event_id, count(*) FILTER (status = 'O') AS announced, CAST(sum(CASE WHEN status = 'O' AND flag <> 'N' THEN 1 ELSE 0 END) AS BIGINT) AS with_result,
  CAST(sum(CASE WHEN status = 'O' AND flag <> 'N' THEN podium ELSE 0 END) AS BIGINT) AS positives, CAST(sum(CASE WHEN status <> 'O' AND flag <> 'N' THEN podium ELSE 0 END) AS BIGINT) AS positives_outside
  FROM entries WHERE status = 'O' OR flag <> 'N' GROUP BY 1""")
def outcome_coverage(t):
    e = t.entries()
    return rollups.outcome_coverage(e.filter(F.col("status") == "O"), e.filter(F.col("flag") != "N"), "event_id", "entrant", "podium")


@query("scope_aggregates", """SELECT coalesce(CAST(season AS VARCHAR), 'all') AS scope, count(*) AS rows, avg(qty) AS mean_qty, CAST(sum(points) AS BIGINT) AS points FROM entries GROUP BY GROUPING SETS ((), (season))""")
def scope_aggregates(t):
    return rollups.by_scope(t.entries(), "season", F.count(F.lit(1)).alias("rows"), F.avg("qty").alias("mean_qty"), F.sum("points").alias("points"))


@query("one_value_per_key", "SELECT entrant FROM entries GROUP BY 1 HAVING count(DISTINCT venue) > 1")
def one_value_per_key(t):
    return rollups.assert_constant(t.entries(), "entrant", "venue").select("entrant")


@query("one_split_per_event", """SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 AND entrant % 2 = 0 THEN 'other' ELSE split END AS split FROM entries) GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def one_split_per_event(t):
    """Events with several splits; some rows of every tenth event are put into another one here."""
    other = (F.col("event_id") % 10 == 0) & (F.col("entrant") % 2 == 0)
    return rollups.assert_constant(t.entries().withColumn("split", F.when(other, "other").otherwise(F.col("split"))), "event_id", "split")


@query("column_profile", """SELECT 'flag' AS "column", CAST(count(*) - count(flag) AS BIGINT) AS nulls, count(DISTINCT flag) AS distinct_values FROM entries UNION ALL SELECT 'start_slot', count(*) - count(start_slot), count(DISTINCT start_slot) FROM entries
  UNION ALL SELECT 'qty', count(*) - count(qty), count(DISTINCT qty) FROM entries UNION ALL SELECT 'partkey', 0, count(DISTINCT partkey) FROM entries""")
def column_profile(t):
    return rollups.distinct_profile(t.entries(), ["flag", "start_slot", "qty", "partkey"])


@query("constant_columns", """SELECT 'same' AS "column" FROM orders HAVING count(DISTINCT o_orderkey * 0) = 1""", base="")
def constant_columns(t):
    d = t.read("orders").select("o_orderstatus", "o_custkey", (F.col("o_orderkey") * 0).alias("same"))
    return rollups.constant_columns(d, ["o_orderstatus", "o_custkey", "same"])


@query("group_entry_counts", "SELECT event_id, grp, count(*) AS entries FROM entries GROUP BY ALL")
def group_entry_counts(t):
    return rollups.entry_counts(t.entries(), "event_id", "grp")


# --- rules -----------------------------------------------------------------------------------

@query("rule_unique", "SELECT 'unique' AS rule, l_orderkey || '|' || l_linenumber AS key, count(*) || ' copies' AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1", base="")
def rule_unique(t):
    return quality.check_unique(t.read("lineitem"), ["l_orderkey", "l_linenumber"])


@query("rule_not_null", """SELECT 'not_null' AS rule, event_id || '|' || entrant AS key, 'start_slot' AS detail FROM entries WHERE start_slot IS NULL UNION ALL
  SELECT 'not_null', event_id || '|' || entrant, 'position' FROM entries WHERE position IS NULL""")
def rule_not_null(t):
    return quality.check_not_null(t.entries(), ["event_id", "entrant"], ["start_slot", "position", "qty"])


@query("rule_event_counts", """SELECT 'event_counts' AS rule, CAST(event_id AS VARCHAR) AS key, 'win=' || sum(win) || ',podium=' || sum(podium) AS detail FROM entries GROUP BY event_id HAVING sum(win) <> 1 OR sum(podium) <> 3""")
def rule_event_counts(t):
    return quality.check_event_counts(t.entries(), "event_id", {"win": 1, "podium": 3})


@query("rule_contiguous", """SELECT 'contiguous' AS rule, CAST(event_id AS VARCHAR) AS key, 'order is not 1..n' AS detail FROM entries GROUP BY event_id
  HAVING NOT (coalesce(max(position), 0) = count(*) AND count(position) = count(*) AND count(DISTINCT position) = count(*))""")
def rule_contiguous(t):
    return quality.check_contiguous(t.entries(), "event_id", "position")


@query("rule_splits", """SELECT 'split_disjoint' AS rule, CAST(grp AS VARCHAR) AS key, 'event in two splits' AS detail FROM entries GROUP BY grp HAVING min(split) <> max(split)""")
def rule_splits(t):
    """Groups cross splits; the splits themselves follow each other in time."""
    return quality.check_splits(t.entries(), "split", "grp", "event_date", ["train", "validation", "test"])


@query("rule_probability", """SELECT 'probability' AS rule, event_id || '|' || entrant AS key, 'p' AS detail FROM entries WHERE qty > 40 OR start_slot IS NULL""")
def rule_probability(t):
    d = t.entries().withColumn("p", F.when(F.col("start_slot").isNotNull(), F.col("qty") / 40))
    return quality.check_probability(d, ["event_id", "entrant"], ["p", "p_win"])


@query("rule_official", """, f AS (SELECT event_id, sum(CAST(coalesce(position = 1, false) AS INTEGER)) AS w, sum(CAST(coalesce(position <= 3, false) AS INTEGER)) AS p FROM entries GROUP BY 1)
  SELECT 'event_counts' AS rule, CAST(event_id AS VARCHAR) AS key, 'winner=' || w || ',podium=' || p AS detail FROM f WHERE w <> 1 OR p <> 3""")
def rule_official(t):
    return quality.check_official(t.entries(), "event_id", "entrant", "position")


@query("rule_entries", """SELECT 'unique' AS rule, event_id || '|' || start_slot AS key, count(*) || ' copies' AS detail FROM entries WHERE start_slot IS NOT NULL GROUP BY event_id, start_slot HAVING count(*) > 1
  UNION ALL SELECT 'slot_or_pit', event_id || '|' || entrant, 'slot and pit lane' FROM entries WHERE start_slot IS NOT NULL AND flag = 'N'
  UNION ALL SELECT 'penalty', event_id || '|' || entrant, 'positions without a penalty' FROM entries WHERE disc > 0 AND podium = 0
  UNION ALL SELECT 'positive_time', event_id || '|' || entrant, 'time is not positive' FROM entries WHERE points <= 0""")
def rule_entries(t):
    d = t.entries().withColumn("pit", (F.col("flag") == "N").cast("int"))
    return quality.check_entries(d, "event_id", "entrant", "start_slot", "pit", "disc", "podium", ["points", "cents"])


@query("rule_chronology", """SELECT 'chronology' AS rule, l_orderkey || '|' || l_linenumber || '|' || l_partkey AS key, 'o_orderdate>l_shipdate' AS detail FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate > l_shipdate""", base="")
def rule_chronology(t):
    o = t.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    d = joins.lookup(t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"), o, "l_orderkey", t.hot_event.renamed("l_orderkey"))
    return quality.check_chronology(d, ["l_orderkey", "l_linenumber", "l_partkey"], ["o_orderdate", "l_shipdate"])


@query("rule_cutoff", """SELECT 'cutoff' AS rule, CAST(event_id AS VARCHAR) AS key, 'cutoff is not 24 h before the first session' AS detail FROM events WHERE user_id % 10 = 3""", base="")
def rule_cutoff(t):
    late = F.when(F.col("user_id") % 10 == 3, F.expr("ts - INTERVAL 23 HOURS")).otherwise(F.expr("ts - INTERVAL 24 HOURS"))
    return quality.check_cutoff(t.read("events").withColumn("cutoff", late), ["event_id"], "ts", "cutoff")


@query("rule_roster", """SELECT 'roster' AS rule, event_id || '|' || entrant AS key, CASE WHEN flag = 'N' THEN 'unknown status' WHEN status = 'F' THEN 'no evidence' ELSE 'withdrawal without a reason' END AS detail
  FROM entries WHERE flag = 'N' OR status = 'F' OR (flag = 'R' AND disc = 0)""")
def rule_roster(t):
    d = t.entries().withColumn("state", F.when(F.col("flag") == "A", "announced").when(F.col("flag") == "R", "withdrawn").otherwise("other"))
    d = d.withColumn("evidence", F.when(F.col("status") == "O", F.array(F.lit("doc")))).withColumn("reason", F.when(F.col("disc") > 0, "injury"))
    return quality.check_roster(d, "event_id", "entrant", "state", "evidence", "reason")


@query("rule_mapping", "SELECT 'mapping' AS rule, CAST(entrant AS VARCHAR) AS key, 'several values of flag' AS detail FROM entries GROUP BY entrant HAVING count(DISTINCT flag) > 1")
def rule_mapping(t):
    return quality.check_mapping(t.entries(), "entrant", "flag")


@query("interval_lookup", """WITH iv AS (SELECT p_partkey AS k, CAST(p_partkey * 7919 % 500 AS DOUBLE) * 1000 AS a, CAST(p_partkey * 7919 % 500 AS DOUBLE) * 1000 + (p_size % 5) * p_size * 100 AS b FROM part),
  m AS (SELECT o_orderkey, k, row_number() OVER (PARTITION BY o_orderkey ORDER BY a DESC, b, k) AS r FROM orders JOIN iv ON o_totalprice >= a AND o_totalprice < b)
  SELECT o.o_orderkey, k AS band FROM orders o LEFT JOIN m ON m.o_orderkey = o.o_orderkey AND r = 1""", base="")
def interval_lookup(t):
    """The innermost price band of every order; bands nest, touch and may be empty."""
    start = (F.col("p_partkey") * 7919 % 500).cast("double") * 1000
    bands = t.read("part").select("p_partkey", start.alias("a"), (start + F.col("p_size") % 5 * F.col("p_size") * 100).alias("b"))
    return ranges.interval_lookup(t.read("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", bands, "a", "b", "p_partkey", "band").select("o_orderkey", "band")
