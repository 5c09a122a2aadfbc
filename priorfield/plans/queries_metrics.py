"""Probability, ranking, consistency and calibration metrics, baselines, reconciliation, bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baselines, bootstrap, calibrate, metrics, reconcile as rec, rollups, scoring, windows as w
from .orders import EVENT_ORDER
from .registry import query

KEY = ["event_id", "entrant"]
TARGETS = {"p_win": "win", "p_podium": "podium", "p_points": "points_finish"}
METRIC_COLS = ["mae", "spearman", "kendall", "ndcg_3", "ndcg_10", "winner_top1", "podium_overlap", "podium_set_exact", "podium_order_exact", "points_top10_overlap"]


def rounded(df, cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def long_targets(d, extra=()):
    """One row per (entry, target) with label y and probability p."""
    cells = F.array(*[F.struct(F.lit(y).alias("target"), F.col(y).alias("y"), F.col(p).alias("p")) for p, y in TARGETS.items()])
    return d.select(*KEY, "season", *extra, F.explode(cells).alias("_c")).select(*KEY, "season", *extra, "_c.*")


LONG_SQL = """, l AS (SELECT event_id, entrant, season, 'win' AS target, win AS y, p_win AS p FROM entries UNION ALL SELECT event_id, entrant, season, 'podium', podium, p_podium FROM entries
  UNION ALL SELECT event_id, entrant, season, 'points_finish', points_finish, p_points FROM entries), s AS (SELECT *, 'all' AS scope FROM l UNION ALL SELECT *, CAST(season AS VARCHAR) FROM l)"""
LOSS = "-(y * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (1 - y) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12)))"


def scoped(t):
    return metrics.with_scopes(long_targets(t.saved(*KEY, "season", *TARGETS, *TARGETS.values())), "season")


@query("log_loss_brier", LONG_SQL + f" SELECT scope, target, round(avg({LOSS}), 8) AS log_loss, avg((p - y) * (p - y)) AS brier FROM s GROUP BY ALL")
def log_loss_brier(t):
    return scoped(t).groupBy("scope", "target").agg(F.round(metrics.log_loss("y", "p"), 8).alias("log_loss"), metrics.brier("y", "p").alias("brier"))


AUC_SQL = """, r AS (SELECT scope, target, y, rank() OVER (PARTITION BY scope, target ORDER BY p) + (count(*) OVER (PARTITION BY scope, target, p) - 1) / CAST(2 AS DOUBLE) AS r FROM s)"""


@query("roc_auc", LONG_SQL + AUC_SQL + """ SELECT scope, target, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / CAST(2 AS DOUBLE)) / (CAST(sum(y) AS DOUBLE) * (count(*) - sum(y))), 9) AS roc_auc FROM r GROUP BY ALL""")
def roc_auc(t):
    return rounded(metrics.roc_auc(scoped(t), "y", "p", ["scope", "target"]), ["roc_auc"], 9)


@query("average_precision", LONG_SQL + """, o AS (SELECT scope, target, y, sum(y) OVER z AS tp, row_number() OVER z AS n FROM s WINDOW z AS (PARTITION BY scope, target ORDER BY p DESC, event_id, entrant ROWS UNBOUNDED PRECEDING))
  SELECT scope, target, round(sum(CAST(tp AS DOUBLE) / n) FILTER (y = 1) / sum(y), 8) AS average_precision FROM o GROUP BY ALL""")
def average_precision(t):
    return rounded(metrics.average_precision(scoped(t), "y", "p", ["scope", "target"], KEY), ["average_precision"], 8)


BIN = "1 + " + " + ".join(f"CAST(p >= CAST({e!r} AS DOUBLE) AS INTEGER)" for e in metrics.EDGES[1:10])


@query("expected_calibration_error", LONG_SQL + f""", b AS (SELECT scope, target, {BIN} AS bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy FROM s WHERE p BETWEEN 0 AND 1 GROUP BY ALL)
  SELECT scope, target, round(sum(abs(sp - sy)) / sum(n), 9) AS ece_10 FROM b GROUP BY ALL""")
def expected_calibration_error(t):
    return rounded(metrics.ece(scoped(t), "y", "p", ["scope", "target"]), ["ece_10"], 9)


@query("calibration_table", LONG_SQL + f""", b AS (SELECT scope, target, {BIN} AS bin, count(*) AS count, avg(p) AS mp, avg(y) AS oy FROM s GROUP BY ALL)
  SELECT scope, target, bin, round((bin - 1) * CAST(0.1 AS DOUBLE), 6) AS lower, round(bin * CAST(0.1 AS DOUBLE), 6) AS upper, count, round(mp, 9) AS mean_prediction, round(oy, 9) AS observed_rate, round(mp - oy, 9) AS calibration_gap FROM b""")
def calibration_table(t):
    d = metrics.calibration_table(scoped(t), "y", "p", ["scope", "target"])
    return rounded(rounded(d, ["lower", "upper"]), ["mean_prediction", "observed_rate", "calibration_gap"], 9)


PLATT_SQL = """, c AS (SELECT {by} p, ln(least(greatest(p, 1e-8), 1 - 1e-8) / (1 - least(greatest(p, 1e-8), 1 - 1e-8))) AS z, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS pos FROM {src} GROUP BY ALL),
  it AS (SELECT {by} 0 AS i, CAST(0 AS DOUBLE) AS a, ln((sum(pos) / sum(n)) / (1 - sum(pos) / sum(n))) AS b FROM c GROUP BY ALL UNION ALL
  SELECT {by} i + 1, a - (gz * h - hz * g) / (hzz * h - hz * hz), b - (hzz * g - hz * gz) / (hzz * h - hz * hz) FROM (
    SELECT {by} i, a, b, sum((n * q - pos) * z) + {l2} * a AS gz, sum(n * q - pos) AS g, sum(n * q * (1 - q) * z * z) + {l2} AS hzz, sum(n * q * (1 - q) * z) AS hz, sum(n * q * (1 - q)) + 1e-8 AS h FROM (
      SELECT {it} it.i, it.a, it.b, c.z, c.n, c.pos, 1 / (1 + exp(-least(greatest(it.a * c.z + it.b, -35), 35))) AS q FROM it JOIN c ON {on}) GROUP BY {by} i, a, b) WHERE i < 30)"""


def platt_sql(by, src, l2):
    return PLATT_SQL.format(by="".join(f"{b}, " for b in by), it="".join(f"it.{b}, " for b in by), src=src, l2=l2,
                            on=" AND ".join(f"it.{b} = c.{b}" for b in by) or "true")


@query("platt_fit", LONG_SQL + platt_sql(["scope", "target"], "s", "1e-3") + " SELECT scope, target, round(a, 6) AS slope, round(b, 6) AS intercept FROM it WHERE i = 30")
def platt_fit(t):
    return rounded(calibrate.fit_platt(scoped(t), "p", "y", ["scope", "target"]), ["slope", "intercept"])


@query("binary_metrics", LONG_SQL + platt_sql(["target"], "l", "1e-3") + AUC_SQL.replace("FROM s)", "FROM s WHERE scope = 'all')") + f""", m AS (SELECT target, count(*) AS rows, round(avg({LOSS}), 8) AS log_loss, avg((p - y) * (p - y)) AS brier, avg(y) AS prevalence,
  avg(p) AS mean_prediction FROM l GROUP BY 1), u AS (SELECT target, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / CAST(2 AS DOUBLE)) / (CAST(sum(y) AS DOUBLE) * (count(*) - sum(y))), 8) AS roc_auc FROM r GROUP BY 1),
  o AS (SELECT target, y, sum(y) OVER z AS tp, row_number() OVER z AS n FROM l WINDOW z AS (PARTITION BY target ORDER BY p DESC, event_id, entrant ROWS UNBOUNDED PRECEDING)),
  v AS (SELECT target, round(sum(CAST(tp AS DOUBLE) / n) FILTER (y = 1) / sum(y), 8) AS average_precision FROM o GROUP BY 1), bb AS (SELECT target, {BIN} AS bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy FROM l GROUP BY ALL),
  e AS (SELECT target, round(sum(abs(sp - sy)) / sum(n), 8) AS ece_10 FROM bb GROUP BY 1), pl AS (SELECT target, round(a, 6) AS calibration_slope, round(b, 6) AS calibration_intercept FROM it WHERE i = 30)
  SELECT * FROM m JOIN u USING (target) JOIN v USING (target) JOIN e USING (target) JOIN pl USING (target)""")
def binary_metrics(t):
    d = metrics.binary_metrics(long_targets(t.saved(*KEY, "season", *TARGETS, *TARGETS.values())), "y", "p", ["target"], KEY)
    return rounded(rounded(d, ["log_loss", "roc_auc", "average_precision", "ece_10"], 8), ["calibration_slope", "calibration_intercept"])


# --- ranking ---------------------------------------------------------------------------------

RANK_SQL = """, rk AS (SELECT *, rank() OVER (PARTITION BY event_id ORDER BY score) + (count(*) OVER (PARTITION BY event_id, score) - 1) / CAST(2 AS DOUBLE) AS pr, row_number() OVER (PARTITION BY event_id ORDER BY score, entrant) AS pi,
    count(*) OVER (PARTITION BY event_id) AS n FROM entries),
  pairs AS (SELECT a.event_id, sum(CAST((a.finish_order - b.finish_order) * (a.score - b.score) > 0 AS INTEGER)) AS c, sum(CAST((a.finish_order - b.finish_order) * (a.score - b.score) < 0 AS INTEGER)) AS d
    FROM entries a JOIN entries b ON a.event_id = b.event_id AND a.finish_order < b.finish_order GROUP BY 1),
  ev AS (SELECT event_id, avg(abs(finish_order - pr)) AS mae, CASE WHEN isfinite(corr(finish_order, pr)) THEN corr(finish_order, pr) END AS spearman,
    sum(CASE WHEN pi <= 3 THEN (n - finish_order + 1) / log2(pi + 1) END) / sum(CASE WHEN finish_order <= 3 THEN (n - finish_order + 1) / log2(finish_order + 1) END) AS ndcg_3,
    sum(CASE WHEN pi <= 10 THEN (n - finish_order + 1) / log2(pi + 1) END) / sum(CASE WHEN finish_order <= 10 THEN (n - finish_order + 1) / log2(finish_order + 1) END) AS ndcg_10,
    CAST(sum(CAST(pi = 1 AND finish_order = 1 AS INTEGER)) AS DOUBLE) AS winner_top1, sum(CAST(pi <= 3 AND finish_order <= 3 AS INTEGER)) / CAST(3 AS DOUBLE) AS podium_overlap,
    CAST(sum(CAST(pi <= 3 AND finish_order <= 3 AS INTEGER)) = least(3, max(n)) AS INTEGER) AS podium_set_exact, CAST(sum(CAST(pi <= 3 AND pi = finish_order AS INTEGER)) = least(3, max(n)) AS INTEGER) AS podium_order_exact,
    sum(CAST(pi <= 10 AND finish_order <= 10 AS INTEGER)) / CAST(least(10, max(n)) AS DOUBLE) AS points_top10_overlap FROM rk GROUP BY 1),
  em AS (SELECT ev.*, CAST(c - d AS DOUBLE) / nullif(c + d, 0) AS kendall, season FROM ev LEFT JOIN pairs USING (event_id) JOIN events_t USING (event_id))"""


def event_metrics(t, with_kendall=True):
    return metrics.event_ranking(t.entries(), "event_id", "finish_order", "score", ["entrant"], t.hot_event, with_kendall)


@query("event_ranking_metrics", RANK_SQL + " SELECT event_id, round(mae, 6) AS mae, round(spearman, 6) AS spearman, round(kendall, 6) AS kendall, round(ndcg_3, 6) AS ndcg_3, round(ndcg_10, 6) AS ndcg_10, winner_top1, round(podium_overlap, 6) AS podium_overlap, "
       "CAST(podium_set_exact AS DOUBLE) AS podium_set_exact, CAST(podium_order_exact AS DOUBLE) AS podium_order_exact, round(points_top10_overlap, 6) AS points_top10_overlap FROM em")
def event_ranking_metrics(t):
    return rounded(event_metrics(t), METRIC_COLS)


@query("kendall", RANK_SQL + " SELECT event_id, CAST(coalesce(c, 0) AS BIGINT) AS concordant, CAST(coalesce(d, 0) AS BIGINT) AS discordant, kendall FROM em LEFT JOIN pairs USING (event_id)")
def kendall(t):
    return metrics.kendall(t.entries(), "event_id", "finish_order", "score", t.hot_event)


@query("mean_over_events", RANK_SQL + " SELECT coalesce(CAST(season AS VARCHAR), 'all') AS scope, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRIC_COLS) + " FROM em GROUP BY GROUPING SETS ((), (season))")
def mean_over_events(t):
    d = event_metrics(t).join(t.events().select("event_id", "season"), "event_id")
    return rounded(metrics.mean_over_events(metrics.with_scopes(d, "season"), METRIC_COLS, ["scope"]), METRIC_COLS)


@query("rankable_rank_metrics", """, k AS (SELECT *, rank() OVER (PARTITION BY event_id ORDER BY score) + (count(*) OVER (PARTITION BY event_id, score) - 1) / CAST(2 AS DOUBLE) AS pr FROM entries WHERE position IS NOT NULL)
  SELECT event_id, round(avg(abs(position - pr)), 6) AS mae FROM k GROUP BY 1""")
def rankable_rank_metrics(t):
    """Rank error over rows that have an order."""
    d = t.entries().filter(F.col("position").isNotNull())
    d = w.rank_average(d, "event_id", "score", "pr", t.hot_event)
    return d.groupBy("event_id").agg(F.round(F.avg(F.abs(F.col("position") - F.col("pr"))), 6).alias("mae"))


PLACES = ", ".join(f"row_number() OVER (PARTITION BY event_id ORDER BY {p} DESC, entrant) AS r{i}" for i, p in enumerate(("p_win", "p_podium", "p_points")))
CONS_SQL = f""", c AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY finish_order, entrant) AS r, {PLACES} FROM entries),
  ce AS (SELECT event_id, count(*) AS size, CAST(sum(CAST(p_win > p_podium + 1e-9 OR p_podium > p_points + 1e-9 AS INTEGER)) AS BIGINT) AS violations, abs(sum(p_win) - 1) AS win_sum_error, abs(sum(p_podium) - 3) AS podium_sum_error,
  abs(sum(p_points) - 10) AS points_sum_error, CAST(sum(CAST(r = 1 AND r0 = 1 AS INTEGER)) AS DOUBLE) AS winner_rank_alignment, round(sum(CAST(r <= 3 AND r1 <= 3 AS INTEGER)) / CAST(3 AS DOUBLE), 9) AS podium_rank_top3_overlap,
  round(sum(CAST(r <= 10 AND r2 <= 10 AS INTEGER)) / CAST(least(10, count(*)) AS DOUBLE), 9) AS points_rank_top10_overlap FROM c GROUP BY 1)"""


def _consistency(t, field_quotas=False):
    return metrics.consistency(t.entries(), "event_id", "p_win", "p_podium", "p_points", "finish_order", ["entrant"], t.hot_event, field_quotas)


@query("event_consistency", CONS_SQL + " SELECT * FROM ce")
def event_consistency(t):
    return rounded(_consistency(t), ["podium_rank_top3_overlap", "points_rank_top10_overlap"], 9)


@query("consistency_summary", CONS_SQL + """ SELECT round(CAST(sum(violations) AS DOUBLE) / sum(size), 9) AS hierarchy_violation_rate, round(avg(win_sum_error), 9) AS mean_abs_win_sum_error, round(avg(podium_sum_error), 9) AS mean_abs_podium_sum_error,
  round(avg(points_sum_error), 9) AS mean_abs_points_sum_error, round(avg(winner_rank_alignment), 9) AS winner_rank_alignment, round(avg(podium_rank_top3_overlap), 6) AS podium_rank_top3_overlap, round(avg(points_rank_top10_overlap), 6) AS points_rank_top10_overlap FROM ce""")
def consistency_summary(t):
    d = metrics.consistency_summary(_consistency(t))
    return rounded(rounded(d, d.columns[:5], 9), d.columns[5:], 6)


@query("field_quota_errors", """SELECT event_id, abs(sum(p_win) - 1) AS win_sum_error, abs(sum(p_podium) - least(3, count(*))) AS podium_sum_error, abs(sum(p_points) - least(10, count(*))) AS points_sum_error FROM entries GROUP BY 1""")
def field_quota_errors(t):
    return _consistency(t, True).select("event_id", "win_sum_error", "podium_sum_error", "points_sum_error")


@query("winner_cohorts", """, wn AS (SELECT event_id, min(entrant) AS cohort FROM entries WHERE win = 1 GROUP BY 1), l AS (SELECT cohort, win AS y, p_win AS p FROM entries JOIN wn USING (event_id))
  SELECT cohort, count(*) AS rows, round(avg({LOSS}), 8) AS log_loss, avg((p - y) * (p - y)) AS brier FROM l GROUP BY 1""".replace("{LOSS}", LOSS))
def winner_cohorts(t):
    d = metrics.winner_cohorts(t.entries(), "event_id", "win", "entrant")
    return d.groupBy("cohort").agg(F.count(F.lit(1)).alias("rows"), F.round(metrics.log_loss("win", "p_win"), 8).alias("log_loss"), metrics.brier("win", "p_win").alias("brier"))


@query("winner_audit", """, a AS (SELECT event_id, sum(y) AS w, sum(p) AS s, sum({LOSS}) AS l, count(*) AS n, min(CASE WHEN y = 1 THEN entrant END) AS winner FROM (SELECT event_id, entrant, win AS y, p_win AS p FROM entries) GROUP BY 1)
  SELECT count(*) AS events, CAST(min(w) AS BIGINT) AS min_winners, CAST(max(w) AS BIGINT) AS max_winners, min(s) AS min_total, max(s) AS max_total, CAST(count(DISTINCT winner) = 1 AS INTEGER) AS same_winner, round(sum(l) / sum(n), 8) AS log_loss FROM a""".replace("{LOSS}", LOSS))
def winner_audit(t):
    return rounded(rollups.winner_audit(t.entries(), "event_id", "entrant", "win", "p_win"), ["log_loss"], 8)


METHOD_SQL = """, ml AS (SELECT event_id, entrant, season, target, y, p, 'formula' AS method FROM l UNION ALL SELECT event_id, entrant, season, target, y, CAST(slot AS DOUBLE) / 8, 'slot' FROM l JOIN entries USING (event_id, entrant, season)),
  ms AS (SELECT *, 'all' AS scope FROM ml UNION ALL SELECT *, CAST(season AS VARCHAR) FROM ml)"""


def methods_long(t, d=None):
    """One row per (entry, target, method), made in one pass over the saved entries, or over ``d``."""
    d = t.saved(*KEY, "season", "slot", *TARGETS, *TARGETS.values()) if d is None else d
    cells = F.array(*[F.struct(F.lit(y).alias("target"), F.col(y).alias("y"), q.alias("p"), F.lit(m).alias("method"))
                      for p, y in TARGETS.items() for m, q in (("formula", F.col(p)), ("slot", F.col("slot") / 8.0))])
    return d.select(*KEY, "season", F.explode(cells).alias("_c")).select(*KEY, "season", "_c.*")


@query("scope_metrics", LONG_SQL + METHOD_SQL + f""", m AS (SELECT scope, method, target, count(*) AS rows, round(avg({LOSS}), 8) AS log_loss, avg((p - y) * (p - y)) AS brier, avg(y) AS prevalence, avg(p) AS mean_prediction FROM ms GROUP BY ALL),
  r AS (SELECT scope, method, target, y, rank() OVER (PARTITION BY scope, method, target ORDER BY p) + (count(*) OVER (PARTITION BY scope, method, target, p) - 1) / CAST(2 AS DOUBLE) AS r FROM ms),
  u AS (SELECT scope, method, target, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / CAST(2 AS DOUBLE)) / (CAST(sum(y) AS DOUBLE) * (count(*) - sum(y))), 8) AS roc_auc FROM r GROUP BY ALL),
  o AS (SELECT scope, method, target, y, sum(y) OVER z AS tp, row_number() OVER z AS n FROM ms WINDOW z AS (PARTITION BY scope, method, target ORDER BY p DESC, event_id, entrant ROWS UNBOUNDED PRECEDING)),
  v AS (SELECT scope, method, target, round(sum(CAST(tp AS DOUBLE) / n) FILTER (y = 1) / sum(y), 8) AS average_precision FROM o GROUP BY ALL),
  bb AS (SELECT scope, method, target, {BIN} AS bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy FROM ms GROUP BY ALL), e AS (SELECT scope, method, target, round(sum(abs(sp - sy)) / sum(n), 8) AS ece_10 FROM bb GROUP BY ALL)
  SELECT * FROM m JOIN u USING (scope, method, target) JOIN v USING (scope, method, target) JOIN e USING (scope, method, target)""")
def scope_metrics(t):
    d = metrics.scope_metrics(methods_long(t), "season", "y", "p", KEY)
    return rounded(d, ["log_loss", "roc_auc", "average_precision", "ece_10"], 8)


@query("flatten_metrics", LONG_SQL + f""", m AS (SELECT target, round(avg({LOSS}), 8) AS log_loss, avg((p - y) * (p - y)) AS brier FROM l GROUP BY 1) SELECT target, 'log_loss' AS metric, log_loss AS value FROM m UNION ALL SELECT target, 'brier', brier FROM m""")
def flatten_metrics(t):
    """Wide metrics as (target, metric, value) rows."""
    d = long_targets(t.entries()).groupBy("target").agg(F.round(metrics.log_loss("y", "p"), 8).alias("log_loss"), metrics.brier("y", "p").alias("brier"))
    return d.unpivot(["target"], ["log_loss", "brier"], "metric", "value")


@query("metric_slice", LONG_SQL + METHOD_SQL + """, m AS (SELECT scope, method, target, avg((p - y) * (p - y)) AS brier FROM ms GROUP BY ALL) SELECT scope, method, brier, max(brier) OVER (PARTITION BY scope) AS field_max FROM m WHERE target = 'podium'""")
def metric_slice(t):
    """One target's slice of the metric table with the scope's maximum, as a chart scales it."""
    from ..operators.joins import field_maximum

    d = metrics.with_scopes(methods_long(t).filter(F.col("target") == "podium"), "season")
    m = d.groupBy("scope", "method").agg(metrics.brier("y", "p").alias("brier"))
    return field_maximum(m, ["scope"], "brier", "field_max")


@query("prediction_pivot", LONG_SQL + METHOD_SQL + """ SELECT event_id, entrant, target, max(p) FILTER (method = 'formula') AS formula_p, max(p) FILTER (method = 'slot') AS slot_p FROM ml GROUP BY ALL""")
def prediction_pivot(t):
    # read once, so not saved: all rows of an event already lie in one task
    return scoring.pivot_methods(methods_long(t, t.entries()), [*KEY, "target"], "method", ["formula", "slot"], ["p"])


@query("stage_shift", """, z AS (SELECT *, (p_win + 1) / 2 AS q FROM entries) SELECT 'raw' AS stage, avg(p_win) AS mean_probability, CAST(0 AS DOUBLE) AS max_shift FROM z UNION ALL SELECT 'lifted', avg(q), max(abs(q - p_win)) FROM z""")
def stage_shift(t):
    d = t.entries().select(*KEY, F.explode(F.array(F.struct(F.lit("raw").alias("stage"), F.col("p_win").alias("p")),
                                                    F.struct(F.lit("lifted").alias("stage"), ((F.col("p_win") + 1) / 2).alias("p")))).alias("s")).select(*KEY, "s.*")
    return metrics.stage_shift(d, "stage", "p", "raw", KEY)


# --- reconciliation --------------------------------------------------------------------------

@query("monotone_rows", """SELECT event_id, entrant, round(least(a, (a + b) / 2, (a + b + c) / 3), 9) AS low, round(greatest(least((a + b) / 2, (a + b + c) / 3), least(b, (b + c) / 2)), 9) AS mid, round(greatest(c, (b + c) / 2, (a + b + c) / 3), 9) AS high
  FROM (SELECT event_id, entrant, p_points AS a, p_podium AS b, p_win AS c FROM entries)""")
def monotone_rows(t):
    low, mid, high = rec.monotone_row("p_points", "p_podium", "p_win")
    return t.entries().select(*KEY, F.round(low, 9).alias("low"), F.round(mid, 9).alias("mid"), F.round(high, 9).alias("high"))


def project_sql(src, out, value, upper, quota):
    """The exact projection in SQL: the shift is the last corner whose total reaches the target."""
    return f""", {out}_c AS (SELECT event_id, {value} - {upper} AS pos, 1 AS step FROM {src} UNION ALL SELECT event_id, {value}, -1 FROM {src}),
  {out}_g AS (SELECT event_id, pos, sum(step) AS step FROM {out}_c GROUP BY ALL), {out}_u AS (SELECT event_id, sum({upper}) AS cap, least(CAST(least({quota}, count(*)) AS DOUBLE), sum({upper})) AS goal FROM {src} GROUP BY 1),
  {out}_r AS (SELECT event_id, pos, sum(step) OVER o AS act, sum(step * pos) OVER o AS moved FROM {out}_g WINDOW o AS (PARTITION BY event_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
  {out}_t AS (SELECT event_id, pos, act, cap + moved - act * pos AS total, goal FROM {out}_r JOIN {out}_u USING (event_id)),
  {out}_s AS (SELECT event_id, coalesce(max(pos) FILTER (total >= goal), min(pos)) AS pos FROM {out}_t GROUP BY 1),
  {out}_l AS (SELECT event_id, CASE WHEN act > 0 AND total >= goal THEN pos + (total - goal) / act ELSE pos END AS shift FROM {out}_s JOIN {out}_t USING (event_id, pos)),
  {out} AS (SELECT s.* EXCLUDE ({value}), least(greatest({value} - shift, 0), {upper}) AS {value} FROM {src} s JOIN {out}_l USING (event_id))"""


RECONCILE_SQL = project_sql("r0", "r1", "p_points", "one", 10) + project_sql("r1", "r2", "p_podium", "p_points", 3) + project_sql("r2", "r3", "p_win", "p_podium", 1)
MONO_SQL = """, r0 AS (SELECT event_id, entrant, CAST(1 AS DOUBLE) AS one, least(a, (a + b) / 2, (a + b + c) / 3) AS p_win, greatest(least((a + b) / 2, (a + b + c) / 3), least(b, (b + c) / 2)) AS p_podium, greatest(c, (b + c) / 2, (a + b + c) / 3) AS p_points
  FROM (SELECT event_id, entrant, p_win AS a, p_podium AS b, p_points AS c FROM {src}))"""


@query("bounded_sum_projection", ", r0 AS (SELECT event_id, entrant, p_points, CAST(1 AS DOUBLE) AS one FROM entries)" + project_sql("r0", "r1", "p_points", "one", 10) + " SELECT event_id, entrant, round(p_points, 8) AS p FROM r1")
def bounded_sum_projection(t):
    d = t.entries().select(*KEY, "p_points", F.lit(1.0).alias("one"))
    d = w.attach_group(d, ["event_id"], t.hot_event, n=F.count(F.lit(1))).withColumn("quota", F.least(F.lit(10), F.col("n")))
    return rec.project_bounded_sum(d, "event_id", "p_points", "one", "quota", "p", t.hot_event).select(*KEY, F.round("p", 8).alias("p"))


@query("reconciled_probabilities", ", pq AS (SELECT event_id, entrant, CAST(qty + 3 AS DOUBLE) / 257 AS p_win, CAST(qty + 1 AS DOUBLE) / 131 AS p_podium, CAST(qty + disc + 1 AS DOUBLE) / 67 AS p_points FROM entries)" + MONO_SQL.format(src="pq") + RECONCILE_SQL + " SELECT event_id, entrant, round(p_win, 8) AS p_win, round(p_podium, 8) AS p_podium, round(p_points, 8) AS p_points FROM r3")
def reconciled_probabilities(t):
    e = t.entries().select(*KEY, ((F.col("qty") + 3) / 257.0).alias("p_win"), ((F.col("qty") + 1) / 131.0).alias("p_podium"),
                           ((F.col("qty") + F.col("disc") + 1) / 67.0).alias("p_points"))
    return rounded(rec.reconcile(e, "event_id", hot=t.hot_event), list(TARGETS), 8)


@query("reconciled_invariants", """SELECT event_id, count(*) AS n, 0 AS violations, CAST(1 AS DOUBLE) AS win, CAST(least(3, count(*)) AS DOUBLE) AS podium, CAST(least(10, count(*)) AS DOUBLE) AS points FROM entries GROUP BY 1""")
def reconciled_invariants(t):
    """After reconciliation every event sums to its quotas and nothing is out of order."""
    d = rec.reconcile(t.entries().select(*KEY, "p_win", "p_podium", "p_points"), "event_id", hot=t.hot_event)
    bad = (F.col("p_win") > F.col("p_podium") + 1e-9) | (F.col("p_podium") > F.col("p_points") + 1e-9) | (F.col("p_win") < 0) | (F.col("p_points") > 1)
    return d.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("int")).cast("int").alias("violations"), F.round(F.sum("p_win"), 6).alias("win"),
                                     F.round(F.sum("p_podium"), 6).alias("podium"), F.round(F.sum("p_points"), 6).alias("points"))


# --- baselines -------------------------------------------------------------------------------

SIZED_SQL = ", n AS (SELECT *, count(*) OVER (PARTITION BY event_id) AS size FROM entries)"


@query("baseline_scores", SIZED_SQL + """ SELECT event_id, entrant, CAST(coalesce(start_slot, qual_slot, size + 1) AS DOUBLE) AS slot_score, CAST(coalesce(qual_slot, start_slot, size + 1) AS DOUBLE) AS qualifying_score,
  round(0.6 * coalesce(start_slot / size, 1) + 0.25 * coalesce(position, start_slot, size) / size + 0.15 * coalesce(gained, size) / size, 9) AS form_score,
  CAST(-coalesce(position, slot, 30) AS DOUBLE) AS recent_form, coalesce(points, 0) + 0.5 * coalesce(gained, 0) AS group_form FROM n""".replace("0.6 *", "CAST(0.6 AS DOUBLE) *").replace("start_slot / size", "CAST(start_slot AS DOUBLE) / size").replace("+ 0.5 *", "+ CAST(0.5 AS DOUBLE) *"))
def baseline_scores(t):
    d = w.attach_group(t.entries(), ["event_id"], t.hot_event, size=F.count(F.lit(1))).withColumn("sn", F.col("start_slot") / F.col("size"))
    b = baselines
    return d.select(*KEY, b.slot_score("start_slot", "qual_slot", "size").alias("slot_score"), b.qualifying_score("start_slot", "qual_slot", "size").alias("qualifying_score"),
                    F.round(b.form_score("sn", "position", "start_slot", "gained", "size"), 9).alias("form_score"),
                    b.recent_form("position", "slot").cast("double").alias("recent_form"), b.group_form("points", "gained").alias("group_form"))


SOFT_SQL = """, b AS (SELECT *, min(score) OVER (PARTITION BY event_id) AS best, count(*) OVER (PARTITION BY event_id) AS size FROM entries),
  ex AS (SELECT event_id, entrant, size, exp(greatest(-(score - best) / CAST(0.65 AS DOUBLE), -30)) AS e1, exp(greatest(-(score - best) / CAST(1.5 AS DOUBLE), -30)) AS e2, exp(greatest(-(score - best) / CAST(4.0 AS DOUBLE), -30)) AS e3 FROM b),
  qt AS (SELECT event_id, entrant, least(greatest(e1 / sum(e1) OVER ev, 1e-8), 1 - 1e-8) AS p_win, least(greatest(e2 / sum(e2) OVER ev * least(3, size), 1e-8), 1 - 1e-8) AS p_podium,
    least(greatest(e3 / sum(e3) OVER ev * least(10, size), 1e-8), 1 - 1e-8) AS p_points FROM ex WINDOW ev AS (PARTITION BY event_id))"""


@query("quota_softmax", SOFT_SQL + MONO_SQL.format(src="qt") + RECONCILE_SQL + " SELECT event_id, entrant, round(p_win, 6) AS p_win, round(p_podium, 6) AS p_podium, round(p_points, 6) AS p_points FROM r3")
def quota_softmax(t):
    return rounded(baselines.quota_probabilities(t.entries().select(*KEY, "score"), "event_id", "score", t.hot_event).drop("score"), list(TARGETS), 6)


@query("uniform_quota", """SELECT event_id, entrant, round(least(1 / CAST(n AS DOUBLE), 1), 6) AS p_win, round(least(3, n) / CAST(n AS DOUBLE), 6) AS p_podium, round(least(10, n) / CAST(n AS DOUBLE), 6) AS p_points FROM (SELECT *, count(*) OVER (PARTITION BY event_id) AS n FROM entries)""")
def uniform_quota(t):
    return rounded(baselines.uniform_probabilities(t.entries().select(*KEY), "event_id", t.hot_event), list(TARGETS), 6)


RATE_SQL = """, tr AS (SELECT * FROM entries WHERE split = 'train'), pr AS (SELECT avg(win) AS w, avg(podium) AS p, avg(points_finish) AS f FROM tr),
  rt AS (SELECT {key}, (sum(win) + {wt} * any_value(w)) / (count(*) + {wt}) AS w1, (sum(podium) + {wt} * any_value(p)) / (count(*) + {wt}) AS p1, (sum(points_finish) + {wt} * any_value(f)) / (count(*) + {wt}) AS f1 FROM tr, pr GROUP BY {key})"""


@query("slot_frequency", RATE_SQL.format(key="slot", wt="CAST(8 AS DOUBLE)") + """, lk AS (SELECT event_id, entrant, coalesce(w1, w) AS p_win, coalesce(p1, p) AS p_podium, coalesce(f1, f) AS p_points FROM (SELECT * FROM entries WHERE split = 'validation') LEFT JOIN rt USING (slot), pr)"""
       + MONO_SQL.format(src="lk") + RECONCILE_SQL + " SELECT event_id, entrant, round(p_win, 6) AS p_win, round(p_podium, 6) AS p_podium, round(p_points, 6) AS p_points FROM r3")
def slot_frequency(t):
    """Smoothed rate of each start slot on training rows, looked up on validation rows, reconciled."""
    e = t.saved().drop(*TARGETS)
    d = baselines.rate_probabilities(e.filter(F.col("split") == "train"), e.filter(F.col("split") == "validation"), "slot", TARGETS, 8.0)
    return rounded(rec.reconcile(d.select(*KEY, *TARGETS), "event_id", hot=t.hot_event), list(TARGETS), 6)


@query("prior_rate", ", tr AS (SELECT avg(win) AS p_win, avg(podium) AS p_podium, avg(points_finish) AS p_points FROM entries WHERE split = 'train') SELECT event_id, entrant, round(tr.p_win, 9) AS p_win, round(tr.p_podium, 9) AS p_podium, round(tr.p_points, 9) AS p_points FROM entries, tr WHERE split <> 'train'")
def prior_rate(t):
    e = t.saved().drop(*TARGETS)
    d = baselines.prior_rate(e.filter(F.col("split") == "train"), e.filter(F.col("split") != "train"), TARGETS)
    return rounded(d.select(*KEY, *TARGETS), list(TARGETS), 9)


@query("rank_rate", """, e2 AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY qty DESC, entrant) AS rank FROM entries)""" + RATE_SQL.format(key="rank", wt="CAST(20 AS DOUBLE)").replace("FROM entries", "FROM e2")
       + """ SELECT event_id, entrant, rank, round(coalesce(w1, w), 9) AS p_win, round(coalesce(p1, p), 9) AS p_podium, round(coalesce(f1, f), 9) AS p_points FROM (SELECT * FROM e2 WHERE split = 'validation') LEFT JOIN rt USING (rank), pr""")
def rank_rate(t):
    e = t.saved().drop(*TARGETS)
    d = baselines.rank_rate(e.filter(F.col("split") == "train"), e.filter(F.col("split") == "validation"), "event_id", "entrant", "qty", TARGETS)
    return rounded(d.select(*KEY, "rank", *TARGETS), list(TARGETS), 9)


# --- calibration -----------------------------------------------------------------------------

@query("identity_calibration", "SELECT event_id, entrant, least(greatest(CAST(qty - 1 AS DOUBLE) / 49, 1e-8), 1 - 1e-8) AS p FROM entries")
def identity_calibration(t):
    return t.entries().select(*KEY, calibrate.bounded((F.col("qty") - 1) / 49.0).alias("p"))


@query("platt_apply", ", l AS (SELECT p_points AS p, points_finish AS y FROM entries WHERE split = 'train')" + platt_sql([], "l", "1e-3") +
       """ SELECT event_id, entrant, round(1 / (1 + exp(-(a * ln(p_points / (1 - p_points)) + b))), 6) AS p FROM entries, it WHERE i = 30""")
def platt_apply(t):
    e = t.saved(*KEY, "split", "p_points", "points_finish")
    fits = calibrate.fit_platt(e.filter(F.col("split") == "train"), "p_points", "points_finish")
    return calibrate.apply_platt(e.select(*KEY, "p_points"), "p_points", fits, out="p").select(*KEY, F.round("p", 6).alias("p"))


ISO_SQL = """, c AS (SELECT p_points AS x, CAST(sum(podium) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM entries WHERE split = 'train' GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY x) AS i, sum(s) OVER (ORDER BY x) AS cs, sum(n) OVER (ORDER BY x) AS cn FROM c),
  jk AS (SELECT j.i AS j, k.i AS k, (k.cs - j.cs + j.s) / (k.cn - j.cn + j.n) AS m FROM o j JOIN o k ON k.i >= j.i), lo AS (SELECT j, k, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS m FROM jk),
  fit AS (SELECT k AS i, max(m) AS v FROM lo GROUP BY 1), st AS (SELECT x, least(greatest(v, 1e-8), 1 - 1e-8) AS v FROM fit JOIN o USING (i))"""


@query("isotonic_apply", ISO_SQL + """ SELECT event_id, entrant, round(coalesce(st.v, (SELECT min(v) FROM st)), 8) AS p FROM entries ASOF LEFT JOIN st ON entries.p_points >= st.x""")
def isotonic_apply(t):
    """Step lookup of the isotonic fit on training rows."""
    e = t.saved(*KEY, "split", "p_points", "podium")
    levels = calibrate.fit_isotonic(e.filter(F.col("split") == "train"), "p_points", "podium")
    return calibrate.apply_isotonic(e.select(*KEY, "p_points"), "p_points", levels, "p").select(*KEY, F.round("p", 8).alias("p"))


CAL = ", l AS (SELECT p_points AS p, podium AS y FROM entries WHERE split = 'train')"


@query("calibrator_choice", ISO_SQL.replace(", c AS", ", ic AS").replace("FROM c)", "FROM ic)") + CAL + platt_sql([], "l", "1e-3") + f""", q AS (SELECT podium AS y, least(greatest(p_points, 1e-8), 1 - 1e-8) AS a0,
  least(greatest(1 / (1 + exp(-(a * ln(p_points / (1 - p_points)) + b))), 1e-8), 1 - 1e-8) AS b0, coalesce(st.v, (SELECT min(v) FROM st)) AS c0 FROM (SELECT * FROM entries, it WHERE i = 30 AND split = 'validation') e ASOF LEFT JOIN st ON e.p_points >= st.x),
  s AS (SELECT 'none' AS calibrator, round(avg({LOSS.replace('p,', 'a0,')}), 6) AS selection_log_loss FROM q UNION ALL SELECT 'platt', round(avg({LOSS.replace('p,', 'b0,')}), 6) FROM q UNION ALL SELECT 'isotonic', round(avg({LOSS.replace('p,', 'c0,')}), 6) FROM q)
  SELECT calibrator, selection_log_loss, CAST(row_number() OVER (ORDER BY selection_log_loss, calibrator) = 1 AS INTEGER) AS chosen FROM s""")
def calibrator_choice(t):
    e = t.saved("split", "p_points", "podium")
    name, _, losses = calibrate.select_calibrator(e.filter(F.col("split") == "train"), e.filter(F.col("split") == "validation"), "p_points", "podium")
    rows = [(n, round(v, 6), int(n == name)) for n, v in losses]
    return t.spark.createDataFrame(rows, "calibrator string, selection_log_loss double, chosen int")


@query("platt_gate", ", l AS (SELECT p_podium AS p, podium AS y FROM entries WHERE split = 'train')" + platt_sql([], "l", "0.01") + f""", g AS (SELECT p, y, a, b, 1 / (1 + exp(-(a * ln(p / (1 - p)) + b))) AS q FROM l, it WHERE i = 30)
  SELECT round(any_value(a), 6) AS slope, round(any_value(b), 6) AS intercept, round(avg({LOSS}), 6) AS loss_raw, round(avg({LOSS.replace('p,', 'q,')}), 6) AS loss_platt,
  CAST(any_value(a) BETWEEN 0 AND 5 AND avg({LOSS}) - avg({LOSS.replace('p,', 'q,')}) > 0.001 AS INTEGER) AS use FROM g""")
def platt_gate(t):
    r = calibrate.platt_gate(t.entries().filter(F.col("split") == "train"), "p_podium", "podium")
    row = [tuple(round(v, 6) if isinstance(v, float) else v for v in r.values())]
    return t.spark.createDataFrame(row, "slope double, intercept double, loss_raw double, loss_platt double, use int")


@query("rank_probabilities", ", l AS (SELECT 1 / (1 + exp(5 * (score / CAST(64 AS DOUBLE) - 0.5))) AS p, podium AS y FROM entries WHERE split = 'train')" + platt_sql([], "l", "1e-3") +
       " SELECT event_id, entrant, round(1 / (1 + exp(-(a * (-5 * (score / CAST(64 AS DOUBLE) - 0.5)) + b))), 6) AS p FROM entries, it WHERE i = 30 AND split = 'validation'")
def rank_probabilities(t):
    e = t.entries().withColumn("rscore", F.col("score") / 64.0)
    d = calibrate.rank_probabilities(e.filter(F.col("split") == "validation"), "rscore", {"p": "podium"}, e.filter(F.col("split") == "train"))
    return d.select(*KEY, F.round("p", 6).alias("p"))


def _blend_sql():
    parts = []
    for a in calibrate.ALPHAS:
        n = str(int(a * 100))
        src = f""", bl AS (SELECT event_id, entrant, (1 - {a}) * p_win + {a} * (slot + 1) / CAST(64 AS DOUBLE) AS p_win, (1 - {a}) * p_podium + {a} * (slot + 8) / CAST(64 AS DOUBLE) AS p_podium, (1 - {a}) * p_points + {a} * (slot + 16) / CAST(64 AS DOUBLE) AS p_points FROM entries WHERE split = 'validation')"""
        ys = f"""(SELECT avg({LOSS.replace('p,', 'r3.p_win,').replace('y ', 'win ').replace('- y)', '- win)')}) + avg({LOSS.replace('p,', 'r3.p_podium,').replace('y ', 'podium ').replace('- y)', '- podium)')}) + avg({LOSS.replace('p,', 'r3.p_points,').replace('y ', 'points_finish ').replace('- y)', '- points_finish)')}) AS s FROM r3 JOIN entries USING (event_id, entrant))"""
        body = (src + MONO_SQL.format(src="bl") + RECONCILE_SQL + f", out AS (SELECT s / 3 AS s FROM {ys})").replace("r0", f"r0_{n}").replace("r1", f"r1_{n}").replace("r2", f"r2_{n}").replace("r3", f"r3_{n}").replace("bl", f"bl_{n}").replace(" out ", f" out_{n} ")
        parts.append((a, n, body))
    return "".join(b for _, _, b in parts) + " " + " UNION ALL ".join(f"SELECT CAST({a} AS DOUBLE) AS alpha, round(s, 6) AS mean_log_loss FROM out_{n}" for a, n, _ in parts)


@query("blend_choice", _blend_sql().replace("bl_0e", "ble"))
def blend_choice(t):
    """Loss of each blend weight after reconciliation."""
    e = t.entries().filter(F.col("split") == "validation")
    for r, k in (("win", 1), ("podium", 8), ("points", 16)):
        e = e.withColumn(f"r_{r}", (F.col("slot") + k) / 64.0)
    d = calibrate.blend_losses(e, "event_id", {"win": "p_win", "podium": "p_podium", "points": "p_points"}, {r: f"r_{r}" for r in ("win", "podium", "points")},
                               {"win": "win", "podium": "podium", "points": "points_finish"})
    return rounded(d, ["mean_log_loss"])


# --- bootstrap -------------------------------------------------------------------------------

REPS = 2000
_WEIGHT = "CASE " + " ".join(f"WHEN x < '{v}' THEN {k}" for k, v in enumerate(bootstrap.limits())) + f" ELSE {len(bootstrap.limits())} END"
BOOT = """, src AS MATERIALIZED (SELECT * FROM {src}), pairs_of AS (SELECT src.*, pair, md5('{seed}:' || pair || ':' || event_id) AS h FROM src, (SELECT unnest(range(0, {reps}, 2)) AS pair)),
  number AS (SELECT *, pair AS rep, substr(h, 1, 15) AS x FROM pairs_of UNION ALL SELECT *, pair + 1, substr(h, 16, 15) FROM pairs_of),
  dr AS (SELECT *, """ + _WEIGHT + """ AS w FROM number)"""


def _wmean(c):
    return f"sum(w * {c}) / nullif(sum(CASE WHEN {c} IS NOT NULL THEN w END), 0) AS {c}"


def _event_losses(t):
    return t.entries().groupBy("event_id", "event_date").agg(
        F.avg(F.pow(F.col("p_podium") - F.col("podium"), 2)).alias("brier"), F.avg(F.col("podium").cast("double")).alias("rate"),
        F.sum(F.pow(F.col("p_podium") - F.col("podium"), 2)).alias("loss_sum"), F.sum("podium").alias("hits"), F.count(F.lit(1)).alias("rows"))


EVENT_LOSS_SQL = ", ev AS (SELECT event_id, event_date, avg((p_podium - podium) * (p_podium - podium)) AS brier, avg(podium) AS rate, sum((p_podium - podium) * (p_podium - podium)) AS loss_sum, sum(podium) AS hits, count(*) AS rows FROM entries GROUP BY ALL)"


@query("bootstrap_mean", EVENT_LOSS_SQL + BOOT.format(src="ev", seed=11, reps=REPS) + f""", r AS (SELECT rep, {_wmean("brier")}, {_wmean("rate")} FROM dr GROUP BY 1)
  SELECT 'brier' AS metric, round((SELECT avg(brier) FROM ev), 6) AS estimate, round(quantile_cont(brier, 0.025), 6) AS lower_95, round(quantile_cont(brier, 0.975), 6) AS upper_95 FROM r
  UNION ALL SELECT 'rate', round((SELECT avg(rate) FROM ev), 6), round(quantile_cont(rate, 0.025), 6), round(quantile_cont(rate, 0.975), 6) FROM r""")
def bootstrap_mean(t):
    return rounded(bootstrap.bootstrap_mean(_event_losses(t), "event_id", ["brier", "rate"], REPS, 11), ["estimate", "lower_95", "upper_95"])


@query("bootstrap_pooled", EVENT_LOSS_SQL + BOOT.format(src="ev", seed=12, reps=REPS) + """, r AS (SELECT rep, sum(w * loss_sum) / sum(w * rows) AS brier, CAST(sum(w * hits) AS DOUBLE) / sum(w * rows) AS rate FROM dr GROUP BY 1)
  SELECT 'brier' AS metric, round((SELECT sum(loss_sum) / sum(rows) FROM ev), 6) AS estimate, round(quantile_cont(brier, 0.025), 6) AS lower_95, round(quantile_cont(brier, 0.975), 6) AS upper_95 FROM r
  UNION ALL SELECT 'rate', round((SELECT CAST(sum(hits) AS DOUBLE) / sum(rows) FROM ev), 6), round(quantile_cont(rate, 0.025), 6), round(quantile_cont(rate, 0.975), 6) FROM r""")
def bootstrap_pooled(t):
    return rounded(bootstrap.bootstrap_pooled(_event_losses(t), "event_id", {"brier": "loss_sum", "rate": "hits"}, "rows", REPS, 12), ["estimate", "lower_95", "upper_95"])


@query("ranking_intervals", RANK_SQL + BOOT.format(src="em", seed=13, reps=REPS) + f""", r AS (SELECT rep, {_wmean("mae")}, {_wmean("spearman")}, {_wmean("winner_top1")}, {_wmean("podium_overlap")} FROM dr GROUP BY 1)
  SELECT metric, round(estimate, 6) AS estimate, round(lo, 6) AS lower_95, round(hi, 6) AS upper_95 FROM (
  SELECT 'mae' AS metric, (SELECT avg(mae) FROM src) AS estimate, quantile_cont(mae, 0.025) AS lo, quantile_cont(mae, 0.975) AS hi FROM r UNION ALL SELECT 'spearman', (SELECT avg(spearman) FROM src), quantile_cont(spearman, 0.025), quantile_cont(spearman, 0.975) FROM r
  UNION ALL SELECT 'winner_top1', (SELECT avg(winner_top1) FROM src), quantile_cont(winner_top1, 0.025), quantile_cont(winner_top1, 0.975) FROM r UNION ALL SELECT 'podium_overlap', (SELECT avg(podium_overlap) FROM src), quantile_cont(podium_overlap, 0.025), quantile_cont(podium_overlap, 0.975) FROM r)""")
def ranking_intervals(t):
    d = event_metrics(t, False)
    return rounded(bootstrap.bootstrap_mean(d, "event_id", ["mae", "spearman", "winner_top1", "podium_overlap"], REPS, 13), ["estimate", "lower_95", "upper_95"])
