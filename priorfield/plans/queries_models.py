"""Preprocessing, training, selection, batch scoring and scoring of forecasts."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.expr import MISSING_TOKEN
from ..operators import joins, metrics, models, prep, quality, rollups, scoring, windows as w
from ..operators.hot import deal
from ..session import materialize, shared_dir
from ..sources import io
from .orders import EVENT_ORDER
from .queries_metrics import KEY, LONG_SQL, LOSS, METHOD_SQL, MONO_SQL, PLATT_SQL, RECONCILE_SQL, SIZED_SQL, methods_long, rounded
from .registry import query

COLS = ["position", "start_slot", "qty", "gained"]


def train(t):
    return t.entries().filter(F.col("split") == "train")


MEDIAN_SQL = ", md AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(median({c}) AS DOUBLE) AS median FROM entries WHERE split = 'train'" for c in COLS) + ")"
STATS_SQL = MEDIAN_SQL + ", sx AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", any_value(median) AS median, avg(coalesce({c}, median)) AS mean, stddev_pop(coalesce({c}, median)) AS scale, max(CAST({c} IS NULL AS INTEGER)) AS indicator FROM entries JOIN md ON md."column" = '{c}' WHERE split = 'train'""" for c in COLS) + ")"


@query("exact_median", MEDIAN_SQL + ' SELECT "column", median FROM md')
def exact_median(t):
    return prep.exact_median(train(t), COLS)


@query("fit_preprocessing", STATS_SQL + ' SELECT "column", median, round(mean, 8) AS mean, round(scale, 8) AS scale, indicator FROM sx')
def fit_preprocessing(t):
    return rounded(prep.fit_stats(train(t), COLS), ["mean", "scale"], 8)


@query("apply_preprocessing", STATS_SQL + " SELECT event_id, entrant, " + ", ".join(
    f"""round((coalesce({c}, (SELECT median FROM sx WHERE "column" = '{c}')) - (SELECT mean FROM sx WHERE "column" = '{c}')) / (SELECT scale FROM sx WHERE "column" = '{c}'), 6) AS {c}""" for c in COLS)
    + ", " + ", ".join(f"CAST({c} IS NULL AS DOUBLE) AS {c}__missing" for c in COLS if c != "qty") + " FROM entries WHERE split = 'validation'")
def apply_preprocessing(t):
    """Statistics of training rows, saved and read back, applied to validation rows."""
    path = f"{shared_dir(t.spark).rstrip('/')}/stats-{uuid.uuid4().hex}"
    prep.save_fit(prep.fit_stats(train(t), COLS), path)
    d = prep.apply_stats(t.entries().filter(F.col("split") == "validation").select(*KEY, *COLS), prep.load_fit(t.spark, path))
    return rounded(d, COLS)


@query("category_levels", f"""SELECT DISTINCT 'flag' AS "column", flag AS level FROM entries WHERE split = 'train' UNION SELECT DISTINCT 'start', coalesce(CAST(start_slot AS VARCHAR), '{MISSING_TOKEN}') FROM entries WHERE split = 'train'""")
def category_levels(t):
    return prep.category_levels(train(t).withColumn("start", F.col("start_slot")), ["flag", "start"])


@query("one_hot", """, lv AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT coalesce(CAST(start_slot AS VARCHAR), '__MISSING__') AS v FROM entries WHERE split = 'train' AND slot <= 3))
  SELECT event_id, entrant, CAST(coalesce(i, (SELECT count(*) FROM lv)) AS INTEGER) AS hot, CAST((SELECT count(*) FROM lv) + 2 AS INTEGER) AS width FROM (SELECT *, coalesce(CAST(start_slot AS VARCHAR), '__MISSING__') AS v FROM entries WHERE split = 'validation') LEFT JOIN lv USING (v)""")
def one_hot(t):
    """Levels of training rows with slots up to 3; later slots fall into the unknown bucket."""
    def cats(d):
        return prep.fill_categories(d.select(*KEY, "slot", "qty", F.col("start_slot").alias("start")), ["start"])

    m = prep.encoder(["qty"], ["start"]).fit(cats(train(t)).filter(F.col("slot") <= 3))
    d = m.transform(cats(t.entries().filter(F.col("split") == "validation")))
    a = vector_to_array("start__hot")
    return d.select(*KEY, (F.array_position(a, 1.0) - 1).cast("int").alias("hot"), (F.size(vector_to_array("features"))).alias("width"))


@query("class_weights", """, k AS (SELECT count(*) AS n, sum(win) AS pos FROM entries) SELECT win, count(*) AS rows, round(sum(CASE WHEN win = 1 THEN n / (2 * CAST(pos AS DOUBLE)) ELSE n / (2 * CAST(n - pos AS DOUBLE)) END), 4) AS total FROM entries, k GROUP BY 1""")
def class_weights(t):
    return models.class_weights(t.entries(), "win").groupBy("win").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("weight"), 4).alias("total"))


def features(d):
    return d.select(*KEY, "event_date", "season", "split", "win", "podium", "points_finish", "finish_order", (F.col("cents") / 1e7).alias("price"), (F.col("qty") / 64.0).alias("amount"), (F.col("disc") / 16.0).alias("rebate"))


FEATURES = ("price", "amount", "rebate")
LOGIT_SQL = PLATT_SQL.format(by="", it="", src="lg", l2="0.01 * (SELECT count(*) FROM lg)", on="true").replace("ln(least(greatest(p, 1e-8), 1 - 1e-8) / (1 - least(greatest(p, 1e-8), 1 - 1e-8)))", "p")


@query("logistic_regression", ", lg AS (SELECT CAST(cents AS DOUBLE) / 1e6 AS p, podium AS y FROM entries WHERE split = 'train')" + LOGIT_SQL + " SELECT round(a, 4) AS slope, round(b, 4) AS intercept FROM it WHERE i = 30")
def logistic_regression(t):
    """Optimum of the L2-penalised mean loss with one feature."""
    d = models.assemble(train(t).withColumn("x", F.col("cents") / 1e6), ["x"])
    m = models.fit_logistic(d, "podium", 0.01)
    return t.spark.createDataFrame([(round(float(m.coefficients[0]), 4), round(float(m.intercept), 4))], "slope double, intercept double")


NORM_SQL = ", nt AS (SELECT *, (finish_order - 1) / CAST(greatest(count(*) OVER (PARTITION BY event_id) - 1, 1) AS DOUBLE) AS y, CAST(cents AS DOUBLE) / 1e7 AS x1, CAST(qty AS DOUBLE) / 64 AS x2, CAST(count(*) OVER (PARTITION BY event_id) AS DOUBLE) AS n FROM entries)"
SOLVE = "(c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12) AS w1, (c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12) AS w2"


def normalised(t):
    d = w.normalised_order(t.saved(*KEY, "split", "finish_order", "cents", "qty"), "event_id", "finish_order", "y", t.hot_event)
    return d.withColumn("x1", F.col("cents") / 1e7).withColumn("x2", F.col("qty") / 64.0)


@query("ridge_ranker", NORM_SQL + f""", m AS (SELECT avg(y) AS m FROM nt WHERE split = 'train'), k AS (SELECT sum(x1 * x1) + 5 AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) + 5 AS s22, sum(x1 * (y - m)) AS c1, sum(x2 * (y - m)) AS c2, any_value(m) AS m FROM nt, m WHERE split = 'train'),
  w AS (SELECT {SOLVE}, m FROM k) SELECT event_id, entrant, round(w1 * x1 + w2 * x2 + m, 5) AS score FROM nt, w WHERE split = 'validation'""")
def ridge_ranker(t):
    d = normalised(t)
    m, mean = models.fit_ridge(models.assemble(d.filter(F.col("split") == "train"), ["x1", "x2"]), "y", 5.0)
    p = m.transform(models.assemble(d.filter(F.col("split") == "validation"), ["x1", "x2"]))
    return p.select(*KEY, F.round(F.col("prediction") + F.lit(mean), 5).alias("score"))


@query("pairwise_ranker", NORM_SQL + f""", ce AS (SELECT n, x1 - avg(x1) OVER e AS x1, x2 - avg(x2) OVER e AS x2, y - avg(y) OVER e AS y FROM nt WHERE split = 'train' WINDOW e AS (PARTITION BY event_id)),
  k AS (SELECT sum(n * x1 * x1) AS s11, sum(n * x1 * x2) AS s12, sum(n * x2 * x2) AS s22, sum(n * x1 * y) AS c1, sum(n * x2 * y) AS c2 FROM ce), w AS (SELECT {SOLVE} FROM k) SELECT round(w1, 5) AS w1, round(w2, 5) AS w2 FROM w""")
def pairwise_ranker(t):
    """Linear ranker whose loss covers every pair of every event."""
    m = models.fit_pairwise(normalised(t).filter(F.col("split") == "train"), "event_id", ["x1", "x2"], "y", hot=t.hot_event)
    return t.spark.createDataFrame([(round(float(m.coefficients[0]), 5), round(float(m.coefficients[1]), 5))], "w1 double, w2 double")


def _scored(t, fit, y="podium", **params):
    d = models.assemble(features(t.saved()), FEATURES)
    return models.probability(fit(d.filter(F.col("split") == "train"), y, **params), d.filter(F.col("split") == "validation")).select(*KEY, "p")


@query("weighted_logistic")
def weighted_logistic(t):
    d = models.assemble(features(t.saved()), FEATURES)
    m = models.fit_logistic(models.class_weights(d.filter(F.col("split") == "train"), "win"), "win", weight="weight", c=1.0)
    return models.probability(m, d.filter(F.col("split") == "validation")).select(*KEY, "p")


@query("boosted_stumps")
def boosted_stumps(t):
    return _scored(t, models.fit_stumps, rounds=5)


@query("random_forest")
def random_forest(t):
    return _scored(t, models.fit_forest, trees=5, depth=4)


@query("boosted_trees")
def boosted_trees(t):
    return _scored(t, models.fit_boosted, rounds=5)


@query("stump_ranker")
def stump_ranker(t):
    d = models.assemble(normalised(t), ["x1", "x2"])
    return models.fit_stump_ranker(d.filter(F.col("split") == "train"), "y", 5).transform(d.filter(F.col("split") == "validation")).select(*KEY, F.col("prediction").alias("score"))


@query("relevance_ranker")
def relevance_ranker(t):
    d = models.assemble(w.relevance(normalised(t), "event_id", "finish_order", "gain", hot=t.hot_event), ["x1", "x2"])
    m = models.fit_relevance_ranker(d.filter(F.col("split") == "train"), "gain", rounds=5)
    return m.transform(d.filter(F.col("split") == "validation")).select(*KEY, (-F.col("prediction")).alias("score"))


def grid():
    return models.candidate_grid({"small": ("price",), "full": FEATURES}, {"logistic": [{"l2": 0.01}, {"l2": 0.1}], "forest": [{"trees": 3, "depth": 3}]})


TARGETS = ["win", "podium", "points_finish"]


def expanding_folds(d):
    """One fold for each season but the first: fit on all seasons before it, score it."""
    seasons = sorted(r["season"] for r in d.select("season").filter(F.col("season").isNotNull()).distinct().collect())
    return [(f"f{score}", end, score) for end, score in zip(seasons, seasons[1:])]


def cross_validated(d):
    return models.temporal_cv(d, TARGETS, grid(), expanding_folds(d), "season")


@query("temporal_cv")
def temporal_cv(t):
    """All candidates and targets over all folds that the training seasons allow."""
    return cross_validated(features(t.saved().filter(F.col("split") == "train")))


CV_SQL = f""", cv AS (SELECT target, slot % 3 AS family, 's' || slot AS candidate, season AS fold, avg({LOSS}) AS log_loss, avg((p - y) * (p - y)) AS brier FROM l JOIN entries USING (event_id, entrant, season) WHERE season <= 1998 GROUP BY ALL),
  mn AS (SELECT target, family, candidate, round(avg(log_loss), 9) AS log_loss, round(avg(brier), 9) AS brier, count(*) AS folds FROM cv GROUP BY ALL), bs AS (SELECT *, row_number() OVER (PARTITION BY target, family ORDER BY log_loss, brier, candidate) AS r FROM mn)"""


def cv_table(t):
    """A comparison table made of the data: candidates are slots, folds are seasons."""
    from .queries_metrics import long_targets

    d = long_targets(t.entries().filter(F.col("season") <= 1998), ["slot"])
    return d.groupBy("target", (F.col("slot") % 3).alias("family"), F.concat(F.lit("s"), F.col("slot").cast("string")).alias("candidate"), F.col("season").alias("fold")).agg(
        metrics.log_loss("y", "p").alias("log_loss"), metrics.brier("y", "p").alias("brier"))


@query("select_best", LONG_SQL + CV_SQL + " SELECT target, family, candidate, log_loss, brier, folds FROM bs WHERE r = 1")
def select_best(t):
    return rounded(models.select_best(cv_table(t), ["target", "family"]), ["log_loss", "brier"], 9)


@query("audit_selection", LONG_SQL + CV_SQL + " SELECT target, family, 's1' AS candidate, candidate AS best FROM bs WHERE r = 1 AND candidate <> 's1'")
def audit_selection(t):
    """Saved choices against the table; here every family claims candidate s1."""
    cv = cv_table(t)
    frozen = cv.select("target", "family").distinct().withColumn("candidate", F.lit("s1"))
    return models.audit_selection(cv, frozen, ["target", "family"])


@query("select_family")
def select_family(t):
    """For every target each family's best candidate by cross-validation, calibrated, and the family chosen."""
    d = features(t.saved())
    fit = d.filter(F.col("split") == "train")
    v = d.filter(F.col("split") == "validation")
    blocks = w.split_blocks(v.select("event_id", "event_date").distinct(), EVENT_ORDER, "event_date", {"calibration": 8 / 22, "selection": 7 / 22}, "report").select("event_id", "block")
    v = v.join(blocks, "event_id")
    named = {c.name: c for c in grid()}
    best = models.select_best(cross_validated(fit), ["target", "family"]).collect()
    return rollups.union_all([models.select_family(fit, v.filter(F.col("block") == "calibration"), v.filter(F.col("block") == "selection"), [y],
                                                   {r["family"]: named[r["candidate"]] for r in best if r["target"] == y})[0] for y in TARGETS])


@query("model_round_trip", "SELECT count(*) AS compared, CAST(0 AS BIGINT) AS differ, count(*) FILTER (event_id % 10 = 0) AS planted FROM entries")
def model_round_trip(t):
    """A saved and reloaded pipeline against the original: rows compared, rows that differ, and rows
    found to differ after a change to every tenth event."""
    d = prep.fill_categories(t.entries().select(*KEY, "qty", "disc", "flag"), ["flag"])
    m = prep.encoder(["qty", "disc"], ["flag"]).fit(d)
    path = f"{shared_dir(t.spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    m.save(path)
    a = m.transform(d).select(*KEY, vector_to_array("features").alias("a"))
    b = PipelineModel.load(path).transform(d).select(*KEY, vector_to_array("features").alias("b"))
    wrong = F.when(F.col("event_id") % 10 == 0, F.transform("b", lambda v: v + 1)).otherwise(F.col("b"))
    both = a.join(b, KEY)
    return both.agg(F.count(F.lit(1)).alias("compared"), F.count(F.when(F.col("a") != F.col("b"), F.lit(1))).alias("differ"),
                    F.count(F.when(F.col("a") != wrong, F.lit(1))).alias("planted"))


# --- scoring ---------------------------------------------------------------------------------

STAGE_IN = ", bl AS (SELECT event_id, entrant, CAST(0.75 AS DOUBLE) * (CAST(qty + 3 AS DOUBLE) / 257 * 0.9 + 0.05) + CAST(0.25 AS DOUBLE) * (slot + 1) / 67 AS p_win, CAST(0.75 AS DOUBLE) * (CAST(qty + 1 AS DOUBLE) / 131 * 0.9 + 0.05) + CAST(0.25 AS DOUBLE) * (slot + 8) / 67 AS p_podium, CAST(0.75 AS DOUBLE) * (CAST(qty + disc + 1 AS DOUBLE) / 67 * 0.9 + 0.05) + CAST(0.25 AS DOUBLE) * (slot + 16) / 67 AS p_points FROM entries)"


def _stage_sql():
    raw = {"win": "CAST(qty + 3 AS DOUBLE) / 257", "podium": "CAST(qty + 1 AS DOUBLE) / 131", "points": "CAST(qty + disc + 1 AS DOUBLE) / 67"}
    k = {"win": 1, "podium": 8, "points": 16}

    def row(stage, e, src):
        return f"SELECT event_id, entrant, '{stage}' AS stage, " + ", ".join(f"round({e(r)}, 7) AS p_{r}" for r in raw) + f" FROM {src}"

    return STAGE_IN + MONO_SQL.format(src="bl") + RECONCILE_SQL + " " + " UNION ALL ".join([
        row("raw", lambda r: raw[r], "entries"), row("calibrated", lambda r: f"{raw[r]} * 0.9 + 0.05", "entries"), row("rank_calibrated", lambda r: f"(slot + {k[r]}) / CAST(67 AS DOUBLE)", "entries"),
        row("blended", lambda r: f"p_{r}", "bl"), row("reconciled", lambda r: f"p_{r}", "r3")])


def staged(t):
    e = t.entries()
    e = e.select(*KEY, "slot", "score", ((F.col("qty") + 3) / 257.0).alias("w"), ((F.col("qty") + 1) / 131.0).alias("d"), ((F.col("qty") + F.col("disc") + 1) / 67.0).alias("o"))
    raw = {"win": "w", "podium": "d", "points": "o"}
    cal = {r: F.col(c) * 0.9 + 0.05 for r, c in raw.items()}
    rank = {r: (F.col("slot") + k) / 67.0 for r, k in (("win", 1), ("podium", 8), ("points", 16))}
    return scoring.score_stages(e, "event_id", raw, cal, rank, 0.25, [*KEY, "score", "slot"], t.hot_event)


@query("score_stages", _stage_sql())
def score_stages(t):
    return rounded(staged(t).drop("score", "slot"), ["p_win", "p_podium", "p_points"], 7)


@query("field_totals", _stage_sql().replace(", 7)", ", 15)").replace(" SELECT event_id, entrant, 'raw'", ", al AS (SELECT event_id, entrant, 'raw'", 1) + """), ft AS (SELECT event_id, stage, sum(p_win) AS win, sum(p_podium) AS podium, sum(p_points) AS points FROM al GROUP BY ALL)
  SELECT event_id, stage, unnest(['win', 'podium', 'points']) AS target, round(unnest([win, podium, points]), 6) AS total FROM ft""")
def field_totals(t):
    """Quota totals per event, stage and target."""
    return rounded(rollups.field_totals(staged(t), "event_id", "stage", p={r: f"p_{r}" for r in scoring.ROLES}), ["total"])


@query("selected_combination", LONG_SQL + METHOD_SQL + " SELECT method, target, count(*) AS n, sum(p) AS total FROM (SELECT method, target, p FROM ml UNION ALL SELECT 'selected_combination', target, p FROM ml WHERE (target = 'win' AND method = 'slot') OR (target <> 'win' AND method = 'formula')) GROUP BY ALL")
def selected_combination(t):
    """Add the method that takes a chosen family per target."""
    sel = t.spark.createDataFrame([("win", "slot"), ("podium", "formula"), ("points_finish", "formula")], "target string, method string")
    d = scoring.combine_families(methods_long(t), sel, KEY)
    return d.groupBy("method", "target").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total"))


@query("predicted_orders", "SELECT event_id, entrant, 'quantity' AS method, row_number() OVER (PARTITION BY event_id ORDER BY score, slot, entrant) AS predicted_order FROM entries UNION ALL SELECT event_id, entrant, 'slot', row_number() OVER (PARTITION BY event_id ORDER BY slot, entrant) FROM entries")
def predicted_orders(t):
    e = t.entries()
    a = scoring.predicted_order(e, "event_id", "score", ["slot", "entrant"], t.hot_event)
    b = scoring.predicted_order(e, "event_id", "slot", ["entrant"], t.hot_event)
    return scoring.stack_methods({"quantity": a, "slot": b}).select(*KEY, "method", "predicted_order")


@query("batch_quality", """, b AS (SELECT * FROM entries WHERE split = 'test') SELECT 'null:position' AS item, count(*) - count(position) AS amount FROM b UNION ALL SELECT 'null:start_slot', count(*) - count(start_slot) FROM b UNION ALL
  SELECT 'first_time_entrants', (SELECT count(DISTINCT partkey) FROM b WHERE partkey NOT IN (SELECT partkey FROM entries WHERE split = 'validation'))""")
def batch_quality(t):
    e = t.entries()
    return scoring.batch_quality(e.filter(F.col("split") == "test"), "partkey", e.filter(F.col("split") == "validation"), ["position", "start_slot", "qty"])


@query("reproducibility", "SELECT count(*) AS compared, CAST(0 AS BIGINT) AS differ, count(*) FILTER (event_id % 10 = 0) AS planted FROM entries")
def reproducibility(t):
    """Stored scores against a fresh run, with no tolerance."""
    cols = ["p_win", "p_podium", "p_points"]

    def run():
        return staged(t).filter(F.col("stage") == "reconciled").select(*KEY, *cols)

    path = f"{shared_dir(t.spark).rstrip('/')}/scores-{uuid.uuid4().hex}"
    io.save_features(run(), path)
    return joins.diff_counts(io.load_features(t.spark, path), materialize(run()), KEY, cols, F.col("event_id") % 10 == 0, total=t.hot_event.total)


@query("favourites", """, o AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY slot, entrant) AS po FROM entries), f AS (SELECT event_id, arg_max(entrant, (p_win, -entrant)) AS favourite, arg_min(entrant, (po, entrant)) AS ranked_first FROM o GROUP BY 1)
  SELECT *, CAST(favourite = ranked_first AS INTEGER) AS agree FROM f""")
def favourites(t):
    d = scoring.predicted_order(t.entries(), "event_id", "slot", ["entrant"], t.hot_event)
    return scoring.favourites(d, ["event_id"], "entrant", "p_win", "predicted_order")


def forecast_long(t, e=None):
    e = t.entries() if e is None else e
    a = scoring.predicted_order(e, "event_id", "score", ["entrant"], t.hot_event).withColumn("stage", F.lit("raw"))
    b = scoring.predicted_order(e, "event_id", "slot", ["entrant"], t.hot_event).withColumn("stage", F.lit("raw"))
    for p in ("p_win", "p_podium", "p_points"):
        b = b.withColumn(p, F.col(p) / 2)
    cols = [*KEY, "stage", "predicted_order", "p_win", "p_podium", "p_points"]
    return scoring.stack_methods({"quantity": a.select(*cols), "slot": b.select(*cols)})


def _loss(y, p):
    return f"avg(-({y} * ln(least(greatest({p}, 1e-12), 1 - 1e-12)) + (1 - {y}) * ln(1 - least(greatest({p}, 1e-12), 1 - 1e-12))))"


FORECAST_SQL = SIZED_SQL + """, fl AS (SELECT *, 'quantity' AS method, row_number() OVER (PARTITION BY event_id ORDER BY score, entrant) AS po, p_win AS a, p_podium AS b, p_points AS c FROM n UNION ALL
  SELECT *, 'slot', row_number() OVER (PARTITION BY event_id ORDER BY slot, entrant), p_win / 2, p_podium / 2, p_points / 2 FROM n)"""


@query("score_forecasts", FORECAST_SQL + f""" SELECT event_id, method, 'raw' AS stage, round({_loss('win', 'a')}, 6) AS win_log_loss, round(avg((a - win) * (a - win)), 6) AS win_brier, round({_loss('podium', 'b')}, 6) AS podium_log_loss, round(avg((b - podium) * (b - podium)), 6) AS podium_brier,
  round({_loss('points_finish', 'c')}, 6) AS points_log_loss, round(avg((c - points_finish) * (c - points_finish)), 6) AS points_brier, round(avg(abs(po - finish_order)), 6) AS mae,
  round(1 - 6 * CAST(sum((po - finish_order) * (po - finish_order)) AS DOUBLE) / nullif(CAST(max(size) * (max(size) * max(size) - 1) AS DOUBLE), 0), 6) AS spearman, max(CAST(po = 1 AND win = 1 AS INTEGER)) AS winner_top1,
  round(CAST(sum(CAST(po <= 3 AND podium = 1 AS INTEGER)) AS DOUBLE) / nullif(sum(podium), 0), 6) AS podium_overlap FROM fl GROUP BY event_id, method""")
def score_forecasts(t):
    e = deal(t.saved(*KEY, "slot", "score", "p_win", "p_podium", "p_points", "finish_order", "position", "points"), t.hot_event)
    d = scoring.score_forecasts(forecast_long(t, e), e.select(*KEY, "finish_order", "position", "points"), "event_id", "entrant", t.hot_event)
    return rounded(d, [c for c in d.columns if c not in ("event_id", "method", "stage", "winner_top1")])


@query("rule_forecast", SIZED_SQL + """, q AS (SELECT event_id, 'quantity' AS method, n.* EXCLUDE (event_id) FROM n)
  SELECT 'nested' AS rule, event_id || '|quantity|raw|' || entrant AS key, 'probabilities do not nest' AS detail FROM q WHERE p_win > p_podium + 1e-6 OR p_podium > p_points + 1e-6
  UNION ALL SELECT 'quota', event_id || '|quantity|raw', 'sum differs from the quota' FROM q GROUP BY event_id HAVING abs(sum(p_win) - 1) > 1e-6 OR abs(sum(p_podium) - least(3, count(*))) > 1e-6 OR abs(sum(p_points) - least(10, count(*))) > 1e-6
  UNION ALL SELECT 'order_only', event_id || '|slot|raw|' || entrant, 'carries a probability' FROM q
  UNION ALL SELECT 'roster_match', event_id || '|' || entrant, 'right' FROM q WHERE status = 'F'""")
def rule_forecast(t):
    """Forecasts of two methods; the slot method is declared order-only, the roster is status O."""
    roster = t.entries().filter(F.col("status") == "O").select(*KEY)
    return quality.check_forecast(forecast_long(t), roster, "event_id", "method", "entrant", "stage", "p_win", "p_podium", "p_points", "predicted_order", ["slot"])


@query("rule_outcomes", """SELECT 'points' AS rule, event_id || '|' || entrant AS key, 'points missing or negative' AS detail FROM entries WHERE gained IS NULL OR gained < 0
  UNION ALL SELECT 'event_counts', CAST(event_id AS VARCHAR), 'winner=' || sum(win) FROM entries GROUP BY event_id HAVING sum(win) <> 1
  UNION ALL SELECT 'roster_match', event_id || '|' || entrant, 'right' FROM entries WHERE slot > 5""")
def rule_outcomes(t):
    e = t.entries()
    return quality.check_outcomes(e, e.filter(F.col("slot") <= 5), "event_id", "entrant", "finish_order", "position", "gained")


@query("report_table", LONG_SQL + METHOD_SQL + f" SELECT method, count(*) FILTER (target = 'win') AS rows, " + ", ".join(
    f"round(avg({LOSS}) FILTER (target = '{y}'), 6) AS {y}_log_loss, round(avg((p - y) * (p - y)) FILTER (target = '{y}'), 6) AS {y}_brier" for y in ("win", "podium", "points_finish")) + " FROM ml WHERE season >= 2000 GROUP BY 1")
def report_table(t):
    """Held-out report: one row per method, one column per target and measure."""
    d = methods_long(t).filter(F.col("season") >= 2000)
    aggs = [F.count(F.when(F.col("target") == "win", 1)).alias("rows")]
    for y in ("win", "podium", "points_finish"):
        here = F.col("target") == y
        aggs += [F.round(F.avg(F.when(here, metrics.log_loss_row("y", "p"))), 6).alias(f"{y}_log_loss"),
                 F.round(F.avg(F.when(here, F.pow(F.col("p") - F.col("y"), 2))), 6).alias(f"{y}_brier")]
    return d.groupBy("method").agg(*aggs)
