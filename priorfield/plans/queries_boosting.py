"""Boosted stumps and rankers on histograms: first rounds against SQL, whole fits against what they must beat."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting, metrics, windows as w
from ..session import own_folder
from .queries_metrics import KEY
from .queries_models import normalised
from .registry import query

#: Rounds of the registered rankers (the operator's own number is 300).
RANKER_ROUNDS = 20
SPLITS = ["slot", "disc", "month"]  # few values each: edges are the middles between them
UNIT = 2 ** boosting.BITS


@query("first_stump", f""", r AS (SELECT avg(podium) AS r FROM entries WHERE split = 'train'),
  v AS (SELECT unnest(['slot', 'disc', 'month']) AS feature, unnest([slot, disc, month]) AS x, CAST(round((podium - r) * {UNIT}) AS HUGEINT) AS g, CAST(round(r * (1 - r) * {UNIT}) AS HUGEINT) AS h FROM entries, r WHERE split = 'train'),
  c AS (SELECT feature, x, sum(g) AS g, sum(h) AS h, count(*) AS n FROM v GROUP BY ALL),
  s AS (SELECT feature, (x + lead(x) OVER o) / CAST(2 AS DOUBLE) AS threshold, sum(g) OVER o / {UNIT}.0 AS gl, sum(h) OVER o / {UNIT}.0 AS hl, sum(n) OVER o AS rows_left, sum(g) OVER a / {UNIT}.0 AS ga, sum(h) OVER a / {UNIT}.0 AS ha FROM c WINDOW o AS (PARTITION BY feature ORDER BY x), a AS (PARTITION BY feature))
  SELECT feature, threshold, CAST(rows_left AS BIGINT) AS rows_left, round(CAST(gl AS DOUBLE), 6) AS gradient_left, round(CAST(hl AS DOUBLE), 6) AS weight_left,
  round(CAST(gl AS DOUBLE) * gl / (hl + 1) + CAST(ga - gl AS DOUBLE) * (ga - gl) / (ha - hl + 1), 5) AS gain FROM s WHERE threshold IS NOT NULL""")
def first_stump(t):
    """Every split that the first round can choose from, with its sums and gain."""
    d = t.entries().filter(F.col("split") == "train")
    edges = boosting.bin_edges(d, SPLITS, 12)
    y = F.col("podium").cast("double")
    rate = d.agg(F.avg(y)).first()[0] or 0.0
    rows = boosting.logistic_gradients(d.select(boosting.binned(SPLITS, edges).alias("bins"), y.alias("y"), F.log(F.lit(rate) / F.lit(1 - rate)).alias("score")), float(UNIT))
    cells = boosting.histogram(rows, boosting.Tree({}, {}), [1], list(range(len(SPLITS))), max(map(len, edges)) + 1)
    out = []
    for f, name in enumerate(SPLITS):
        sums = [[int(v) for v in s] for s in cells[1, f]]
        for b, edge in enumerate(edges[f]):
            (gl, gr), (hl, hr) = [(sum(s[:b + 1]) / UNIT, sum(s[b + 1:]) / UNIT) for s in sums[:2]]
            out.append((name, edge, sum(sums[2][:b + 1]), round(gl, 6), round(hl, 6), round(gl * gl / (hl + 1) + gr * gr / (hr + 1), 5)))
    return t.spark.createDataFrame(out, "feature string, threshold double, rows_left long, gradient_left double, weight_left double, gain double")


def _pairs_sql(weight):
    return f""", s AS (SELECT event_id, entrant, greatest(4 - finish_order, 0) AS y, -slot / CAST(4 AS DOUBLE) AS score FROM entries),
  p AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, entrant) AS place, row_number() OVER (PARTITION BY event_id ORDER BY y DESC) AS best FROM s),
  d AS (SELECT *, CASE WHEN place <= 3 THEN 1 / log2(place + 1) ELSE 0 END AS disc, sum(CASE WHEN best <= 3 THEN y / log2(best + 1) ELSE 0 END) OVER (PARTITION BY event_id) AS ideal FROM p),
  q AS (SELECT a.event_id, a.entrant AS up, b.entrant AS down, 1 / (1 + exp(a.score - b.score)) AS rho, {weight} AS w FROM d a JOIN d b ON a.event_id = b.event_id AND a.y > b.y AND least(a.place, b.place) <= 3),
  z AS (SELECT event_id, up, down, CAST(round(rho * w * {UNIT}) AS HUGEINT) AS g, CAST(round(rho * (1 - rho) * w * {UNIT}) AS HUGEINT) AS h FROM q),
  m AS (SELECT event_id, up AS entrant, g, h FROM z UNION ALL SELECT event_id, down, -g, h FROM z UNION ALL SELECT event_id, entrant, 0, 0 FROM d)
  SELECT event_id, entrant, round(CAST(sum(g) AS DOUBLE) / {UNIT}, 5) + 0 AS gradient, round(CAST(sum(h) AS DOUBLE) / {UNIT}, 5) AS weight FROM m GROUP BY ALL"""


def _pairs(t, weighted):
    d = t.entries().select(*KEY, F.greatest(4 - F.col("finish_order"), F.lit(0)).cast("double").alias("y"), (-F.col("slot") / 4.0).alias("score"),
                           F.col("entrant").alias("_row"), F.array(F.lit(0)).alias("bins"))
    d = d.join(boosting.ideal_gain(d, "event_id", "y", 3), "event_id")
    g = boosting.pair_gradients(d, "event_id", ["entrant"], 3, float(UNIT), weighted, t.hot_event)
    return g.groupBy("event_id", F.col("_row").alias("entrant")).agg(
        (F.round(F.sum("g") / UNIT, 5) + 0.0).alias("gradient"), F.round(F.sum("h") / UNIT, 5).alias("weight"))


@query("listwise_gradients", _pairs_sql("(a.y - b.y) * abs(a.disc - b.disc) / a.ideal"))
def listwise_gradients(t):
    """Gradients of NDCG@3 at scores by slot, for every entrant."""
    return _pairs(t, True)


@query("pairwise_gradients", _pairs_sql("CAST(1 AS DOUBLE)"))
def pairwise_gradients(t):
    """Gradients of equally weighted pairs with one of the first three by slot."""
    return _pairs(t, False)


def _measured(t, columns):
    d = t.saved(*columns)
    return d, d.filter(F.col("split") == "train"), d.filter(F.col("split") == "validation")


@query("histogram_stumps", """, r AS (SELECT avg(podium) AS r FROM entries WHERE split = 'train') SELECT count(*) AS rows, 60 AS trees, round(avg(-(podium * ln(r) + (1 - podium) * ln(1 - r))), 6) AS rate_log_loss, 1 AS better FROM entries, r WHERE split = 'validation'""")
def histogram_stumps(t):
    """Boosted stumps, 60 rounds: log loss of validation rows against that of the training rate."""
    _, fit, v = _measured(t, [*KEY, "split", "podium", "cents", "qty", "disc", "slot", "month", "start_slot", "qual_slot"])
    with own_folder(t.spark):
        m = boosting.fit_stump_classifier(fit, ["cents", "qty", "disc", "slot", "month", "start_slot", "qual_slot"], "podium")
    rate = fit.agg(F.avg("podium")).first()[0]
    p = m.probability(v).withColumn("rate", F.lit(rate))
    r = p.agg(F.count(F.lit(1)).alias("rows"), metrics.log_loss("podium", "p").alias("own"), metrics.log_loss("podium", "rate").alias("base"))
    return r.select("rows", F.lit(len(m.trees)).alias("trees"), F.round("base", 6).alias("rate_log_loss"), (F.col("own") < F.col("base")).cast("int").alias("better"))


@query("histogram_stump_ranker", """, nt AS (SELECT *, (finish_order - 1) / CAST(greatest(count(*) OVER (PARTITION BY event_id) - 1, 1) AS DOUBLE) AS y FROM entries), r AS (SELECT avg(y) AS r FROM nt WHERE split = 'train')
  SELECT count(*) AS rows, 80 AS trees, round(avg((y - r) * (y - r)), 6) AS mean_error, 1 AS better FROM nt, r WHERE split = 'validation'""")
def histogram_stump_ranker(t):
    """Boosted stumps on the normalised order, 80 rounds: squared error of validation rows against that of the mean."""
    d = normalised(t)
    fit, v = d.filter(F.col("split") == "train"), d.filter(F.col("split") == "validation")
    with own_folder(t.spark):
        m = boosting.fit_stump_regressor(fit, ["x1", "x2"], "y")
    mean = fit.agg(F.avg("y")).first()[0]
    r = m.transform(v, "own").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.pow(F.col("own") - F.col("y"), 2)).alias("own"), F.avg(F.pow(F.lit(mean) - F.col("y"), 2)).alias("base"))
    return r.select("rows", F.lit(len(m.trees)).alias("trees"), F.round("base", 6).alias("mean_error"), (F.col("own") < F.col("base")).cast("int").alias("better"))


def ndcg(d, event, order, gain, k):
    """Mean NDCG@k over the events that have gain."""
    own = w.top_k(d.select(event, gain, *order), event, order, k).groupBy(event).agg(F.sum(F.col(gain) / F.log2(F.col("place") + 1.0)).alias("own"))
    both = own.join(boosting.ideal_gain(d, event, gain, k), event).filter(F.col("_ideal") > 0)
    return both.agg(F.count(F.lit(1)).alias("events"), F.avg(F.col("own") / F.col("_ideal")).alias("ndcg"))


NDCG_SQL = f""", p AS (SELECT event_id, greatest(4 - finish_order, 0) AS y, row_number() OVER (PARTITION BY event_id ORDER BY slot, entrant) AS place, finish_order AS best FROM entries WHERE split = 'validation'),
  e AS (SELECT event_id, sum(CASE WHEN place <= 3 THEN y / log2(place + 1) ELSE 0 END) / sum(CASE WHEN best <= 3 THEN y / log2(best + 1) ELSE 0 END) AS n FROM p GROUP BY 1) SELECT count(*) AS events, {RANKER_ROUNDS} AS trees, round(avg(n), 6) AS slot_ndcg, 1 AS better FROM e"""


def _ranked(t, objective):
    gain = F.greatest(4 - F.col("finish_order"), F.lit(0))
    d = t.saved(*KEY, "split", "finish_order", "cents", "qty", "disc", "slot").withColumn("gain", gain)
    v = d.filter(F.col("split") == "validation")
    with own_folder(t.spark):
        m = boosting.fit_ranker(d.filter(F.col("split") == "train"), ["cents", "qty", "disc", "slot"], "gain", "event_id", ["entrant"], objective,
                                rounds=RANKER_ROUNDS, k=10, max_features=4, hot=t.hot_event)
    own = ndcg(m.transform(v).withColumn("_down", -F.col("score")), "event_id", ["_down", "entrant"], "gain", 3)
    slot = ndcg(v, "event_id", ["slot", "entrant"], "gain", 3).withColumnRenamed("ndcg", "slot_ndcg")
    return own.join(slot, "events").select("events", F.lit(len(m.trees)).alias("trees"), F.round("slot_ndcg", 6).alias("slot_ndcg"), (F.col("ndcg") > F.col("slot_ndcg")).cast("int").alias("better"))


@query("listwise_ranker", NDCG_SQL)
def listwise_ranker(t):
    """Boosted trees on NDCG@10: NDCG@3 of validation events against that of the order by slot."""
    return _ranked(t, "ndcg")


@query("boosted_pairwise_ranker", NDCG_SQL)
def boosted_pairwise_ranker(t):
    """Boosted trees on equally weighted pairs, measured alike."""
    return _ranked(t, "pairwise")
