"""Probability, ranking, consistency and calibration metrics, per scope or per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import materialize
from .hot import HotGroups, find_hot, join_same
from .windows import attach_group, prior_count, prior_features, prior_sum, rank_average, rank_first

# Bin edges as 0.1 steps in double arithmetic, so that 0.3, 0.6 and 0.7 fall below
# their edge.
EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]


def with_scopes(df: DataFrame, season: str) -> DataFrame:
    """Each row once in scope 'all' and once in its season's scope."""
    return df.withColumn("scope", F.explode(F.array(F.lit("all"), F.col(season).cast("string"))))


def log_loss_row(y: str, p: str) -> Column:
    q = F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1 - 1e-12))
    return -(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))


def log_loss(y: str, p: str) -> Column:
    return F.avg(log_loss_row(y, p))


def brier(y: str, p: str) -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), F.lit(2)))


def bin_of(p: str) -> Column:
    """1..10; a value on an edge belongs to the upper bin."""
    return sum(((F.col(p) >= F.lit(e)).cast("int") for e in EDGES[1:10]), F.lit(1))


def roc_auc(df: DataFrame, y: str, p: str, by, hot: HotGroups | None = None) -> DataFrame:
    """Area under the curve by average ranks, from counts per distinct score.

    With large keys the counts are written once and large keys are looked for among them: they may be few."""
    by = list(by)
    c = df.groupBy(*by, p).agg(F.sum(F.col(y).cast("long")).alias("_pos"),
                               F.sum((1 - F.col(y)).cast("long")).alias("_neg"))
    if hot is None or hot:
        c, hot = materialize(c), None
    c = prior_features(c, [(by, [prior_sum("_below", "_neg")])], [p], hot)
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return c.groupBy(*by).agg(F.try_divide(wins, pairs).alias("roc_auc"))


def average_precision(df: DataFrame, y: str, p: str, by, tiebreak, hot: HotGroups | None = None) -> DataFrame:
    """Ties follow the stated row order."""
    by = list(by)
    d = df.select(*by, y, (-F.col(p)).alias("_down"), *tiebreak)
    d = prior_features(d, [(by, [prior_sum("_tp", y), prior_count("_seen")])], ["_down", *tiebreak], hot, dealt=False)
    gain = F.when(F.col(y) == 1, (F.col("_tp") + 1) / (F.col("_seen") + 1))
    return d.groupBy(*by).agg(F.try_divide(F.sum(gain), F.sum(y).cast("double")).alias("average_precision"))


def ece(df: DataFrame, y: str, p: str, by) -> DataFrame:
    """Expected calibration error over ten bins; values outside [0, 1] count in no bin."""
    by = list(by)
    inside = F.col(p).between(0.0, 1.0)
    b = df.groupBy(*by, F.when(inside, bin_of(p)).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(p).alias("_p"), F.sum(y).alias("_y"))
    gap = F.when(F.col("_bin").isNotNull(), F.abs(F.col("_p") - F.col("_y")))
    return b.groupBy(*by).agg((F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("_n")).alias("ece_10"))


def calibration_table(df: DataFrame, y: str, p: str, by) -> DataFrame:
    """Ten bins with count, mean prediction, observed rate and gap; empty bins are left out."""
    t = df.groupBy(*by, bin_of(p).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg(p).alias("mean_prediction"),
        F.avg(F.col(y).cast("double")).alias("observed_rate"))
    edges = F.array(*[F.lit(e) for e in EDGES])
    return t.select(*by, "bin", F.get(edges, F.col("bin") - 1).alias("lower"),
                    F.get(edges, F.col("bin")).alias("upper"), "count", "mean_prediction", "observed_rate",
                    (F.col("mean_prediction") - F.col("observed_rate")).alias("calibration_gap"))


def binary_metrics(df: DataFrame, y: str, p: str, by, tiebreak, calibration: bool = True) -> DataFrame:
    """All probability metrics, one row per value of ``by``."""
    from .calibrate import fit_platt

    by = list(by)
    hot = find_hot(df, by)
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), log_loss(y, p).alias("log_loss"), brier(y, p).alias("brier"),
        F.avg(F.col(y).cast("double")).alias("prevalence"), F.avg(p).alias("mean_prediction"))
    parts = [roc_auc(df, y, p, by, hot), average_precision(df, y, p, by, tiebreak, hot), ece(df, y, p, by)]
    if calibration:
        fits = fit_platt(df, p, y, by)
        parts.append(fits.select(*by, F.col("slope").alias("calibration_slope"),
                                 F.col("intercept").alias("calibration_intercept")))
    for part in parts:  # one row per scope on both sides
        out = join_same(out, part, by, "left")
    return out


# --- ranking, one row per event --------------------------------------------------------------

def kendall(df: DataFrame, event: str, actual: str, score: str, hot: HotGroups | None = None) -> DataFrame:
    """(concordant - discordant) / (both) over untied pairs, without forming a pair.

    Two different orders first differ at one binary digit. Counting, per digit and common
    leading digits, how many rows with 0 and with 1 come before each score counts every pair once.
    """
    hot = find_hot(df, [event]) if hot is None else hot
    d = df.select(event, F.col(actual).alias("_a"), F.col(score).alias("_s")).filter("_a IS NOT NULL")
    if not isinstance(df.schema[actual].dataType, (T.IntegerType, T.LongType)):  # 1.2 and 1.8 are no tie: take the place of each value
        levels = d.select(event, "_a").distinct()
        levels = prior_features(levels, [([event], [prior_count("_level")])], ["_a"], hot)
        d = join_same(d, levels, [event, "_a"]).drop("_a").withColumnRenamed("_level", "_a")
    d = d.withColumn("_a", F.col("_a").cast("long"))
    d = attach_group(d, [event], hot, _top=F.max("_a"))
    digits = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.col("_top"), F.lit(1)))).cast("int"))
    d = d.withColumn("_digit", F.explode(digits))
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_digit"))
    part = F.floor(F.col("_a") / unit).cast("long")
    d = d.select(event, "_s", "_digit", F.floor(part / 2).cast("long").alias("_lead"), (part % 2).alias("_bit"))
    c = d.groupBy(event, "_digit", "_lead", "_s").agg(
        F.sum(1 - F.col("_bit")).alias("_n0"), F.sum("_bit").alias("_n1"))
    keys = [event, "_digit", "_lead"]
    c = prior_features(c, [([event], []), (keys, [prior_sum("_b0", "_n0"), prior_sum("_b1", "_n1")])], ["_s", "_digit", "_lead"], hot)
    t = c.groupBy(event).agg(F.sum(F.col("_n1") * F.col("_b0")).alias("concordant"),
                             F.sum(F.col("_n0") * F.col("_b1")).alias("discordant"))
    both = F.col("concordant") + F.col("discordant")
    return t.withColumn("kendall", F.try_divide((F.col("concordant") - F.col("discordant")).cast("double"), both))


def ndcg(k: int, actual: str, place: str, ideal: str, size: str) -> Column:
    """Linear gain size - order + 1, log2 discount; rows carry their predicted and ideal place."""
    gain = F.col(size) - F.col(actual) + 1
    got = F.sum(F.when(F.col(place) <= k, gain / F.log2(F.col(place) + 1)))
    best = F.sum(F.when(F.col(ideal) <= k, gain / F.log2(F.col(ideal) + 1)))
    return F.try_divide(got, best)


def overlap(k: int, a: str, b: str) -> Column:
    return F.sum(((F.col(a) <= k) & (F.col(b) <= k)).cast("int"))


def event_ranking(df: DataFrame, event: str, actual: str, score: str, tiebreak,
                  hot: HotGroups | None = None, with_kendall: bool = True) -> DataFrame:
    """Every ranking metric, one row per event."""
    hot = find_hot(df, [event]) if hot is None else hot
    d = rank_average(df, event, score, "_pred", hot)
    d = rank_first(d, event, [score, *tiebreak], "_place", hot)
    d = rank_first(d, event, [actual, *tiebreak], "_ideal", hot)
    d = attach_group(d, [event], hot, _size=F.count(F.lit(1)))
    few = F.least(F.lit(3), F.first("_size"))
    in_order = F.sum(((F.col("_place") <= 3) & (F.col("_place") == F.col("_ideal"))).cast("int"))
    out = d.groupBy(event).agg(
        F.avg(F.abs(F.col(actual) - F.col("_pred"))).alias("mae"),
        F.try_divide(F.covar_pop(F.col(actual), "_pred"), F.stddev_pop(actual) * F.stddev_pop("_pred")).alias("spearman"),
        ndcg(3, actual, "_place", "_ideal", "_size").alias("ndcg_3"),
        ndcg(10, actual, "_place", "_ideal", "_size").alias("ndcg_10"),
        overlap(1, "_place", "_ideal").cast("double").alias("winner_top1"),
        (overlap(3, "_place", "_ideal") / 3.0).alias("podium_overlap"),
        (overlap(3, "_place", "_ideal") == few).cast("double").alias("podium_set_exact"),
        (in_order == few).cast("double").alias("podium_order_exact"),
        (overlap(10, "_place", "_ideal") / F.least(F.lit(10), F.first("_size"))).alias("points_top10_overlap"),
    )
    if with_kendall:
        k = kendall(df, event, actual, score, hot).select(event, "kendall")
        out = join_same(out, k, [event], "left")
    return out


def mean_over_events(per_event: DataFrame, metrics, by=()) -> DataFrame:
    """Mean over events, where undefined values are ignored."""
    return per_event.groupBy(*by).agg(
        *[F.avg(F.when(~F.isnan(F.col(m).cast("double")), F.col(m))).alias(m) for m in metrics])


def consistency(df: DataFrame, event: str, win: str, podium: str, points: str, score: str, tiebreak,
                hot: HotGroups | None = None, field_quotas: bool = False) -> DataFrame:
    """Nesting violations, sum errors and agreement of rank with probability, per event.

    Sum errors compare with 1, 3 and 10 whatever the field size; ``field_quotas`` compares with
    min(quota, size) instead.
    """
    hot = find_hot(df, [event]) if hot is None else hot
    d = df.withColumn("_bad", ((F.col(win) > F.col(podium) + 1e-9) | (F.col(podium) > F.col(points) + 1e-9)).cast("int"))
    d = rank_first(d, event, [score, *tiebreak], "_r", hot)
    for p, name in ((win, "_rw"), (podium, "_rp"), (points, "_rt")):
        d = rank_first(d.withColumn("_down", -F.col(p)), event, ["_down", *tiebreak], name, hot).drop("_down")
    n = F.count(F.lit(1))

    def goal(k):
        return F.least(F.lit(k), n) if field_quotas else F.lit(k)

    return d.groupBy(event).agg(
        n.alias("size"), F.sum("_bad").alias("violations"),
        F.abs(F.sum(win) - goal(1)).alias("win_sum_error"),
        F.abs(F.sum(podium) - goal(3)).alias("podium_sum_error"),
        F.abs(F.sum(points) - goal(10)).alias("points_sum_error"),
        overlap(1, "_r", "_rw").cast("double").alias("winner_rank_alignment"),
        (overlap(3, "_r", "_rp") / 3.0).alias("podium_rank_top3_overlap"),
        (overlap(10, "_r", "_rt") / F.least(F.lit(10), n)).alias("points_rank_top10_overlap"),
    )


def consistency_summary(per_event: DataFrame) -> DataFrame:
    return per_event.agg(
        (F.sum("violations") / F.sum("size")).alias("hierarchy_violation_rate"),
        F.avg("win_sum_error").alias("mean_abs_win_sum_error"),
        F.avg("podium_sum_error").alias("mean_abs_podium_sum_error"),
        F.avg("points_sum_error").alias("mean_abs_points_sum_error"),
        F.avg("winner_rank_alignment").alias("winner_rank_alignment"),
        F.avg("podium_rank_top3_overlap").alias("podium_rank_top3_overlap"),
        F.avg("points_rank_top10_overlap").alias("points_rank_top10_overlap"))


def scope_metrics(long: DataFrame, season: str, y: str, p: str, tiebreak, calibration: bool = False) -> DataFrame:
    """Probability metrics for every (scope, method, target) of a long prediction table."""
    return binary_metrics(with_scopes(long, season), y, p, ["scope", "method", "target"], tiebreak, calibration)


def winner_cohorts(df: DataFrame, event: str, winner_flag: str, entrant: str) -> DataFrame:
    """Attach to each row the winner of its event; events without a winner are left out."""
    winners = df.filter(F.col(winner_flag) == 1).groupBy(event).agg(F.min(entrant).alias("cohort"))
    return join_same(df, winners, [event])


def stage_shift(long: DataFrame, stage: str, p: str, base_stage: str, keys, by=()) -> DataFrame:
    """Mean per stage, and the largest move of a row between one stage and each other."""
    base = long.filter(F.col(stage) == base_stage).select(*keys, *by, F.col(p).alias("_base"))
    d = join_same(long, base, [*keys, *by], "left")
    return d.groupBy(*by, stage).agg(F.avg(p).alias("mean_probability"),
                                     F.max(F.abs(F.col(p) - F.col("_base"))).alias("max_shift"))
