"""Append-only observation log: who said what, when it was published and when it was seen.

Columns: observation_id, provider, uri, payload (binary), sha256, published_at, retrieved_at,
first_observed_at, previous_observation, reviewed_at, reviewed_by, and claim columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import url_allowed
from ..session import materialize
from .hot import HotGroups, find_hot, join_same
from .windows import prior_features, previous

# Fixed values.
DAY_END_HOURS = 36   # end of a calendar day at UTC-12, counted from its UTC midnight
DAY_START_HOURS = 14  # start of a calendar day at UTC+14, before its UTC midnight
VERIFIED_BASIS = ("document", "provider_metadata")
SALTS = 16  # copies of a look-up row where keys are hot


def append_observations(log: DataFrame | None, new: DataFrame, source, hot: HotGroups | None = None) -> DataFrame:
    """Add observations; derive when the same content was first seen at the source and the
    previous observation of the source.

    Stored rows stay as they are. For the new rows only, the earliest stored time of their
    (source, content) and the latest stored row of their source are looked up.
    """
    d = new.withColumn("sha256", F.sha2("payload", 256))
    hot = find_hot(d, source) if hot is None else hot
    first = d.groupBy(*source, "sha256").agg(F.min("retrieved_at").alias("first_observed_at"))
    if log is not None:
        before = log.groupBy(*source, "sha256").agg(F.min("first_observed_at").alias("_stored"))
        first = join_same(first, before, [*source, "sha256"], "left").withColumn(
            "first_observed_at", F.least("first_observed_at", "_stored")).drop("_stored")
    if hot:  # one content may be most of a source: its rows take a salt
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
        d = d.withColumn("_salt", F.pmod(F.xxhash64("observation_id"), F.lit(SALTS)).cast("int"))
        d = join_same(d, first.select("*", salts), [*source, "sha256", "_salt"]).drop("_salt")
    else:
        d = join_same(d, first, [*source, "sha256"])
    d = prior_features(d, [(list(source), [previous("previous_observation", "observation_id")])],
                       ["retrieved_at", "observation_id"], hot)
    if log is None:
        return d
    last = log.groupBy(*source).agg(F.max_by("observation_id", F.struct("retrieved_at", "observation_id")).alias("_last"))
    d = join_same(d, last, list(source), "left").withColumn(
        "previous_observation", F.coalesce("previous_observation", "_last")).drop("_last")
    return log.select(*d.columns).unionByName(d)


def append_reviews(log: DataFrame, reviews: DataFrame) -> DataFrame:
    """A review is a new observation of the same content that keeps the original times.

    ``reviews``: observation_id (new), reviews (old id), reviewed_by, reviewed_at.
    """
    own = ["observation_id", "previous_observation", "reviewed_by", "reviewed_at"]
    kept = log.drop("previous_observation", "reviewed_by", "reviewed_at").withColumnRenamed("observation_id", "reviews")
    added = reviews.join(kept, "reviews").withColumnRenamed("reviews", "previous_observation")
    cols = [c for c in log.columns if c not in own] + own
    return log.select(*cols).unionByName(added.select(*cols))


def available_asof(log: DataFrame, cutoff, max_age_seconds, times=("published_at", "retrieved_at", "first_observed_at", "reviewed_at")) -> DataFrame:
    """Observations none of whose times is after the cutoff and that are fresh enough.

    ``cutoff`` and ``max_age_seconds`` may be columns, so limits per source role work too. Ages
    count microseconds; a negative limit is an error.
    """
    limit = max_age_seconds if isinstance(max_age_seconds, Column) else F.lit(max_age_seconds)
    limit = F.when(limit < 0, F.raise_error(F.lit("negative age limit")).cast("double")).otherwise(limit.cast("double"))
    known = reduce(lambda a, b: a & b, [F.col(t).isNull() | (F.col(t) <= cutoff) for t in times])
    age = F.unix_micros(cutoff) - F.unix_micros(F.col("retrieved_at").cast("timestamp"))
    return log.filter(known & (age <= limit * 1_000_000))


def freshness(log: DataFrame, limits: dict[str, int], role: str, cutoff) -> DataFrame:
    """Apply the freshness limit of each source role."""
    pairs = [x for k, v in limits.items() for x in (F.lit(k), F.lit(v))]
    return available_asof(log, cutoff, F.try_element_at(F.create_map(*pairs), F.col(role)))


def _links(edges: DataFrame, src: str, dst: str) -> tuple[DataFrame, bool]:
    """Distinct edges (a, b), written once, and whether every node has at most one outgoing edge."""
    e = materialize(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct())
    most = e.groupBy("a").count().agg(F.max("count")).first()[0]
    return e, (most or 0) <= 1


def _twice(jump: DataFrame) -> DataFrame:
    """Two jumps in a row."""
    return materialize(jump.join(jump.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")))


def evidence_closure(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Everything reachable from the roots, roots included.

    Where nodes have one outgoing edge, as in chains of revisions, jumps double their length each
    round, so rounds grow with the logarithm of the depth. Otherwise each round follows the newly
    found nodes only, and only these are written.
    """
    links, single = _links(edges, src, dst)
    seen = materialize(roots.select(F.col(roots.columns[0]).alias("node")).distinct())
    if single:
        jump, left = links, links.count()
        while left and not jump.isEmpty():  # a cycle never runs out of jumps: the number of links bounds the rounds
            seen = materialize(seen.union(jump.join(seen, jump["a"] == seen["node"]).select(F.col("b").alias("node"))).distinct())
            jump, left = _twice(jump), left // 2
        return seen
    front = seen
    while True:
        step = links.join(front, links["a"] == front["node"]).select(F.col("b").alias("node")).distinct()
        front = materialize(step.join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.union(front)


def find_cycles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges of dependency cycles. Empty on sound dependencies.

    Where nodes have one outgoing edge, these are the edges of nodes that a jump as long as the
    number of links still reaches, found by doubling. Otherwise nodes without incoming or outgoing
    edges are removed again and again, which leaves the cycles and also the links between them.
    """
    left, single = _links(edges, src, dst)
    size = left.count()
    if single:
        jump, steps = left, size
        while steps and not jump.isEmpty():
            jump, steps = _twice(jump), steps // 2
        return left.join(jump.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select(F.col("a").alias(src), F.col("b").alias(dst))
    while size:
        inner = left.join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        left = materialize(inner.join(inner.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b"))
        now = left.count()
        if now == size:
            break
        size = now
    return left.select(F.col("a").alias(src), F.col("b").alias(dst))


def tampered(log: DataFrame) -> DataFrame:
    return log.filter(~F.sha2("payload", 256).eqNullSafe(F.col("sha256")))


def scope_mismatch(log: DataFrame, events: DataFrame, event: str, fields) -> DataFrame:
    """Reviewed records that name an unknown event or disagree with it."""
    e = events.select(event, *[F.col(c).alias(f"_e_{c}") for c in fields]).withColumn("_found", F.lit(1))
    d = join_same(log, e, [event], "left")
    wrong = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in fields])
    return d.filter(F.col("_found").isNull() | wrong).select(*log.columns)


def publication_bounds(log: DataFrame, day: str = "claimed_day", exact: str = "published_at") -> DataFrame:
    """Earliest and latest possible publication. A day without a time zone spans UTC-12 to UTC+14,
    counted from its UTC midnight whatever the zone of the session."""
    d, t = F.timestamp_seconds(F.unix_date(day).cast("long") * 86_400), F.col(exact)
    late = d + F.make_dt_interval(hours=F.lit(DAY_END_HOURS))
    early = d - F.make_dt_interval(hours=F.lit(DAY_START_HOURS))
    return log.withColumn("latest", F.when(d.isNull(), t).otherwise(F.greatest(late, t))).withColumn(
        "earliest", F.when(d.isNull(), t).otherwise(F.greatest(early, t)))


def unverified_claims(log: DataFrame, day: str = "claimed_day", exact: str = "published_at", basis: str = "basis") -> DataFrame:
    """Claims without a reviewer, without any date, or whose time has no verified basis."""
    known = F.coalesce(F.col(basis).isin(*VERIFIED_BASIS), F.lit(False))
    return log.filter(F.col("reviewed_by").isNull() | (F.col(day).isNull() & F.col(exact).isNull()) | ~known)


def publication_timing(cutoff, earliest="earliest", latest="latest") -> Column:
    """Class of an uncertainty interval against the cutoff."""
    e, l = F.col(earliest), F.col(latest)
    return (F.when(e.isNull() & l.isNull(), "unknown").when(e.isNull() | l.isNull() | (e > l), "invalid")
            .when(l <= cutoff, "before_or_at_cutoff").when(e > cutoff, "after_cutoff").otherwise("ambiguous"))


def assess_timing(df: DataFrame, cutoff, retrieved: str = "retrieved_at", latest: str = "latest") -> DataFrame:
    """Research flags of a recovered source."""
    return df.select(
        "*", publication_timing(cutoff).alias("claimed_publication_timing"),
        (F.col(retrieved) > cutoff).cast("int").alias("retrieved_after_cutoff"),
        F.coalesce(F.col(latest) > F.col(retrieved), F.lit(False)).cast("int").alias("window_beyond_retrieval"))


def official(log: DataFrame, hosts: dict[str, list[str]], approved=(), uri: str = "uri", provider: str = "provider") -> DataFrame:
    """Records of an official provider at one of its own hosts, or at an approved host; the
    address must be https, without a user part and without a port but 443."""
    own = [(F.col(provider) == p) & url_allowed(uri, h) for p, h in hosts.items()]
    return log.filter(reduce(lambda a, b: a | b, own, url_allowed(uri, approved) if approved else F.lit(False)))


def inventory(log: DataFrame, by) -> DataFrame:
    """Per key: observations, first one, reviewed ones, and an order-free digest of the contents.

    The digest is the sum, as text, over different contents of a 60-bit hash of the content and
    the number of its observations; so no list of a whole key is built, and equal contents count.
    """
    each = log.groupBy(*by, "sha256").agg(
        F.count(F.lit(1)).alias("_n"), F.min("retrieved_at").alias("_first"), F.count("reviewed_by").alias("_reviewed"))
    own = F.conv(F.substring(F.sha2(F.concat_ws(":", "sha256", F.col("_n").cast("string")), 256), 1, 15), 16, 10)
    return each.groupBy(*by).agg(
        F.sum("_n").alias("observations"), F.min("_first").alias("first_observed_at"),
        F.sum("_reviewed").alias("reviewed"), F.sum(own.cast("decimal(38,0)")).cast("string").alias("digest"))
