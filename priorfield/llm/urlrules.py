"""URL rules by a sort-merge range join, in DataFrame operations only.

A rule is a host and a path prefix; it fits its host and all subdomains. A reversed host
("com.example.") turns "this host and its subdomains" into "keys that begin with it", so a rule
is the interval [key, key + 0xFF) of binary keys. Rules and points are sorted together by range;
the intervals nest, and after each interval start or end the stack of open rules is known. A point
takes the stack of the last start or end before it. Two sweeps are needed, because subdomains and
paths do not nest in one key: the first finds the open rule hosts of a host, the second the
innermost open path of each of these hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import materialize

#: The rules of the registered query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """The labels in reverse order, each with a dot behind it: subdomains begin with their domain."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def sweep(points: DataFrame, rules: DataFrame, point_key: str, rule_key: str, inner: str) -> DataFrame:
    """Give each point the ``inner`` value of the last interval start or end at or before its key.

    ``rules`` has a distinct ``rule_key`` and ``inner``: the state inside the rule, and ``outer``:
    the state after its end. Equal keys may lie in several range partitions; the state is carried
    over from one to the next through a table with one row per partition.
    """
    key = F.encode(F.col(rule_key), "UTF-8")
    payload = F.struct(*points.columns)
    events = (
        rules.select(key.alias("k"), F.lit(0).alias("order"), F.lit(0).cast("long").alias("tie"), F.struct(F.col(inner).alias("v")).alias("state"))
        .unionByName(rules.select(F.concat(key, F.unhex(F.lit("FF"))).alias("k"), F.lit(0).alias("order"), F.lit(0).cast("long").alias("tie"),
                                  F.struct(F.col("outer").alias("v")).alias("state")))
        .withColumn("point", F.lit(None).cast(points.select(payload).schema[0].dataType))
        .unionByName(points.select(F.encode(F.col(point_key), "UTF-8").alias("k"), F.lit(1).alias("order"),
                                   F.xxhash64(*points.columns).alias("tie"), payload.alias("point")), allowMissingColumns=True))
    # written, as the limits of the range partitions must be the same for both readers
    dealt = materialize(events.repartitionByRange("k", "order", "tie").withColumn("part", F.spark_partition_id()))
    place = F.struct("k", "order")
    last = dealt.filter("order = 0").groupBy("part").agg(F.max_by("state", place).alias("state"))
    parts = dealt.select("part").distinct().join(last, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    carried = parts.select("part", F.last("state", True).over(before).alias("carried"))
    so_far = Window.partitionBy("part").orderBy("k", "order").rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.withColumn("state", F.last("state", True).over(so_far)).filter("order = 1")
    found = inside.join(F.broadcast(carried), "part", "left")
    return found.select("point.*", F.coalesce("state", "carried")["v"].alias(inner))


def nested_hosts(rules: DataFrame) -> DataFrame:
    """Per rule host: the stack of rule hosts open inside it (itself included) and outside it."""
    hosts = rules.select("key").distinct()
    parts = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.")
    above = hosts.select(F.col("key").alias("own"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "."), F.lit(".")))).alias("key"))
    stack = above.join(hosts, "key").groupBy("own").agg(F.collect_set("key").alias("open_hosts"))
    return stack.select(F.col("own").alias("key"), "open_hosts", F.array_except("open_hosts", F.array("own")).alias("outer"))


def nested_paths(rules: DataFrame) -> DataFrame:
    """Per rule: the longest rule of the same host whose path its own path begins with, but itself.

    Only prefixes as long as some path of that host are looked up."""
    lengths = rules.groupBy("key").agg(F.collect_set(F.length("path")).alias("lengths"))
    tries = rules.join(lengths, "key").select("key", "path", F.explode(
        F.filter("lengths", lambda n: n < F.length("path"))).alias("n")).select("key", "path", F.expr("substring(path, 1, n)").alias("prefix"))
    outer = tries.join(rules.select("key", F.col("path").alias("prefix"), F.col("rule").alias("found")), ["key", "prefix"]).groupBy(
        "key", "path").agg(F.max_by("found", F.length("prefix")).alias("outer"))
    return rules.join(outer, ["key", "path"], "left").select(F.concat("key", "path").alias("path_key"), "rule", "outer")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge each url by the longest rule that fits it; else by ``default``.

    A rule fits its host and all subdomains if the url's path begins with the rule's path. The
    longest rule (host and path together) wins, then the longer host. Rules are lower-cased in the
    host; a null host or path counts as empty; of rules that repeat, ``block`` wins. Urls that are
    null or have no ``://`` have an empty host and path and get the default. One row out per row
    in, repeated rows included, with all input columns and ``host``, ``path``, ``rule`` (null if
    none fits) and ``verdict``; input columns of these names are replaced. An empty table of rules
    gives the default everywhere.
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*names, url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    plain = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").groupBy("host", "path").agg(
        F.max("verdict").alias("verdict"))
    plain = materialize(plain.select(host_key(F.col("host")).alias("key"), "path", F.struct(
        F.concat("host", "path").alias("text"), F.length("host").alias("host_length"), "verdict").alias("rule")))

    urls = rows.select("host", "path").distinct().withColumn("key", host_key(F.col("host")))
    hosts = sweep(urls, nested_hosts(plain), "key", "key", "open_hosts")
    tries = hosts.select("host", "path", F.explode("open_hosts").alias("open")).withColumn("path_key", F.concat("open", "path"))
    fits = sweep(tries, nested_paths(plain), "path_key", "path_key", "rule").filter("rule IS NOT NULL")
    rank = F.struct(F.length("rule.text"), F.col("rule.host_length"))
    best = fits.groupBy("host", "path").agg(F.max_by("rule", rank).alias("best"))
    # a url may be very common: rows take a salt, and the few columns of its verdict are copied per salt
    salts = 8
    keys = ["host", "path", "_salt"]
    spread = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = best.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, keys, "left").select(
        *names, "host", "path", F.col("best.text").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
