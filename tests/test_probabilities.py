"""Metrics, reconciliation and calibration against direct recomputation, plain and chunked."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from priorfield.operators import bootstrap, calibrate, metrics, models, reconcile as rec, rollups, scoring
from priorfield.operators import hot as hot_module
from priorfield.operators.hot import find_hot


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    sizes = [1, 2, 5, 12, 40]
    rows, i = [], 0
    for e, n in enumerate(sizes):
        order = rng.permutation(n) + 1
        for k in range(n):
            p = rng.random(3)
            rows.append((e, i, int(order[k]), float(rng.integers(0, 8)), float(p[0]), float(p[1]), float(p[2]), int(rng.random() < p[0])))
            i += 1
    cols = ["event", "id", "actual", "score", "p_win", "p_podium", "p_points", "y"]
    return pd.DataFrame(rows, columns=cols), spark.createDataFrame(rows, "event long, id long, actual long, score double, p_win double, p_podium double, p_points double, y int")


def project(v, target, upper):
    lo, hi = (v - upper).min() - 1, v.max() + 1
    target = min(target, upper.sum())
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(v - mid, 0, upper).sum() > target else (lo, mid)
    return np.clip(v - (lo + hi) / 2, 0, upper)


def monotone(row):
    v = list(row)
    best = None
    for split in ([1, 1, 1], [2, 1], [1, 2], [3]):  # least squares over all poolings
        out, at = [], 0
        for n in split:
            out += [sum(v[at:at + n]) / n] * n
            at += n
        if all(a <= b + 1e-15 for a, b in zip(out, out[1:])):
            err = sum((a - b) ** 2 for a, b in zip(out, v))
            if best is None or err < best[0]:
                best = (err, out)
    return best[1]


@pytest.mark.parametrize("limit", [1000, 10])
def test_reconcile(frame, limit):
    pdf, df = frame
    got = rec.reconcile(df, "event", hot=find_hot(df, ["event"], limit)).toPandas().sort_values("id")
    want = []
    for _, g in pdf.groupby("event"):
        m = np.array([monotone(r) for r in g[["p_win", "p_podium", "p_points"]].to_numpy()])
        n = len(g)
        m[:, 2] = project(m[:, 2], min(10, n), np.ones(n))
        m[:, 1] = project(m[:, 1], min(3, n), m[:, 2])
        m[:, 0] = project(m[:, 0], 1, m[:, 1])
        want.append(m)
    np.testing.assert_allclose(got[["p_win", "p_podium", "p_points"]].to_numpy(), np.vstack(want), atol=1e-9)


@pytest.mark.parametrize("limit", [1000, 10])
def test_event_ranking(frame, limit):
    pdf, df = frame
    got = metrics.event_ranking(df, "event", "actual", "score", ["id"], find_hot(df, ["event"], limit)).toPandas().set_index("event")
    for e, g in pdf.groupby("event"):
        a, s = g.actual.to_numpy(), g.score.to_numpy()
        pred = g.score.rank().to_numpy()
        c = sum((a[i] - a[j]) * (s[i] - s[j]) > 0 for i in range(len(a)) for j in range(i))
        d = sum((a[i] - a[j]) * (s[i] - s[j]) < 0 for i in range(len(a)) for j in range(i))
        k = (c - d) / (c + d) if c + d else np.nan
        np.testing.assert_allclose(float(got.loc[e, "kendall"] if got.loc[e, "kendall"] is not None else np.nan), k)
        np.testing.assert_allclose(got.loc[e, "mae"], np.abs(a - pred).mean())
        place, n = np.argsort(pred, kind="mergesort"), len(a)
        top = min(3, n)
        gain = n - a + 1.0
        disc = np.log2(np.arange(2, top + 2))
        ideal = np.argsort(a, kind="mergesort")
        np.testing.assert_allclose(got.loc[e, "ndcg_3"], (gain[place[:top]] / disc).sum() / (gain[ideal[:top]] / disc).sum())
        assert got.loc[e, "podium_overlap"] == pytest.approx(len(set(place[:3]) & set(ideal[:3])) / 3)
        assert got.loc[e, "podium_set_exact"] == float(set(place[:3]) == set(ideal[:3]))
        assert got.loc[e, "podium_order_exact"] == float(np.array_equal(place[:3], ideal[:3]))
        assert got.loc[e, "winner_top1"] == float(place[0] == ideal[0])


@pytest.mark.parametrize("limit", [1000, 7])
def test_binary_metrics(frame, limit):
    pdf, df = frame
    d = df.withColumn("all", F.lit(1)).withColumn("p", F.round("p_win", 1))
    hot = find_hot(d, ["all"], limit)
    y, p = pdf.y.to_numpy(), pdf.p_win.round(1).to_numpy()
    r = pd.Series(p).rank().to_numpy()
    pos, neg = y.sum(), (1 - y).sum()
    auc = metrics.roc_auc(d, "y", "p", ["all"], hot).first()["roc_auc"]
    assert auc == pytest.approx((r[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg))
    ap = metrics.average_precision(d, "y", "p", ["all"], ["id"], hot).first()["average_precision"]
    s = y[np.argsort(-p, kind="mergesort")]
    assert ap == pytest.approx((np.cumsum(s) / np.arange(1, len(s) + 1) * s).sum() / pos)
    bins = np.minimum(np.digitize(p, np.linspace(0, 1, 11)[1:-1]), 9)
    want = sum(abs(p[bins == b].sum() - y[bins == b].sum()) for b in range(10)) / len(p)
    assert metrics.ece(d, "y", "p", ["all"]).first()["ece_10"] == pytest.approx(want)


def test_calibrators(frame):
    pdf, df = frame
    fit = calibrate.fit_platt(df, "p_win", "y").first()
    z = np.log(pdf.p_win / (1 - pdf.p_win))
    q = 1 / (1 + np.exp(-(fit["slope"] * z + fit["intercept"])))
    assert abs((q - pdf.y).sum()) < 1e-6 and abs(((q - pdf.y) * z).sum() + 1e-3 * fit["slope"]) < 1e-6  # gradient is zero
    table = calibrate.fit_isotonic(df, "p_win", "y")
    levels = sorted(map(tuple, table.collect()))
    assert all(a < b for a, b in zip([v for _, v in levels], [v for _, v in levels][1:]))
    step = calibrate.apply_isotonic(df, "p_win", table, "q").toPandas()
    starts, vals = np.array([a for a, _ in levels]), np.array([v for _, v in levels])
    at = np.clip(np.searchsorted(starts, step.p_win, side="right") - 1, 0, None)
    np.testing.assert_allclose(step.q, vals[at])


def test_pairwise_equals_all_pairs(frame):
    pdf, df = frame
    m = models.fit_pairwise(df, "event", ["score", "p_win"], "actual")
    x, y = [], []
    for _, g in pdf.groupby("event"):
        a = g[["score", "p_win", "actual"]].to_numpy(float)
        for i in range(len(a)):
            for j in range(i):
                x.append(a[i, :2] - a[j, :2])
                y.append(a[i, 2] - a[j, 2])
    w = np.linalg.lstsq(np.array(x), np.array(y), rcond=None)[0]
    np.testing.assert_allclose(m.coefficients.toArray(), w, rtol=1e-6)


def test_bootstrap_is_repeatable(spark):
    d = spark.createDataFrame([(i, v) for i, v in enumerate([0.1, 0.2, 0.4, 0.8])], "k long, v double")
    a, b = (bootstrap.bootstrap_mean(d, "k", ["v"], 200, 3).first() for _ in range(2))
    assert tuple(a)[1:] == pytest.approx(tuple(b)[1:])  # the order of addition may differ
    assert a["lower_95"] <= a["estimate"] <= a["upper_95"] and a["estimate"] == pytest.approx(0.375)


def test_score_forecasts(spark):
    long = spark.createDataFrame([(1, "m", "raw", e, o, p, min(1.0, 2 * p), 1.0) for e, o, p in (("a", 1, 0.6), ("b", 2, 0.3), ("c", 3, 0.1))],
                                 "event long, method string, stage string, entrant string, predicted_order int, p_win double, p_podium double, p_points double")
    out = spark.createDataFrame([(1, "a", 2, 2, 18.0), (1, "b", 1, 1, 25.0), (1, "c", 3, None, 0.0)], "event long, entrant string, finish_order int, position int, points double")
    r = scoring.score_forecasts(long, out, "event", "entrant").first()
    assert r["win_brier"] == pytest.approx((0.36 + 0.49 + 0.01) / 3) and r["mae"] == pytest.approx(2 / 3)
    assert r["spearman"] == pytest.approx(1 - 6 * 2 / 24) and r["winner_top1"] == 0 and r["podium_overlap"] == 1


def test_score_forecasts_needs_equal_rosters(spark):
    schema = "event long, method string, stage string, entrant string, predicted_order int, p_win double, p_podium double, p_points double"
    long = spark.createDataFrame([(1, "m", "raw", e, o, 0.5, 0.5, 0.5) for e, o in (("a", 1), ("b", 2), ("c", 3))], schema)
    out = spark.createDataFrame([(1, "a", 2, 2, 18.0), (1, "b", 1, 1, 25.0)], "event long, entrant string, finish_order int, position int, points double")
    with pytest.raises(ValueError, match="different entrants"):
        scoring.score_forecasts(long, out, "event", "entrant")
    with pytest.raises(ValueError, match="different entrants"):
        scoring.score_forecasts(long.filter("entrant = 'a'"), out, "event", "entrant")
    assert scoring.score_forecasts(long, out, "event", "entrant", strict=False).count() == 1


def test_kendall_of_fractions_has_no_ties(spark):
    d = spark.createDataFrame([(1, 1.2, 0.1), (1, 1.8, 0.2), (1, 1.5, 0.3)], "event long, actual double, score double")
    r = metrics.kendall(d, "event", "actual", "score").first()
    assert (r["concordant"], r["discordant"]) == (2, 1)


def test_bootstrap_draws_are_digits_of_digests():
    texts = [b"", b":7", b":-123456789012", b":" + b"x" * 60]
    got = {rep: list(w) for rep, w in bootstrap.draws(texts, 11, 103)}
    assert sorted(got) == list(range(103))
    for rep, w in got.items():
        start = 15 * (rep % 2)
        digits = [hashlib.md5(f"11:{rep - rep % 2}".encode() + x).hexdigest()[start:start + 15] for x in texts]
        assert w == [sum(d >= x for x in bootstrap.limits()) for d in digits]


def test_bootstrap_leaves_out_nulls_and_shuffles_no_draws(spark):
    d = spark.createDataFrame([(1, 0.5, 2, None), (2, None, 3, None), (None, 1.5, 1, None), (2, 4.0, None, None)], "k long, v double, n long, z double")
    sums = bootstrap._resample(d, "k", ["v", "n", "z"], 7, 5)
    assert "Generate" not in sums._jdf.queryExecution().toString()  # no row for each draw
    got = {r["rep"]: r for r in sums.collect()}
    w = dict(bootstrap.draws([b":1", b":2", b"", b":2"], 5, 7))
    for rep, r in got.items():
        a = [int(x) for x in w[rep]]
        assert r["s_v"] == a[0] * 0.5 + a[2] * 1.5 + a[3] * 4.0 and r["w_v"] == a[0] + a[2] + a[3]
        assert r["s_n"] == 2 * a[0] + 3 * a[1] + a[2] and r["s_z"] is None
    assert len(got) == 7


def test_field_totals_cover_every_target(spark):
    long = spark.createDataFrame([(1, "raw", 0.25, 0.5, 1.0), (1, "raw", 0.5, 0.5, None), (1, "blended", 1.0, None, 1.0), (None, "raw", 0.0, 0.25, 0.5)],
                                 "event long, stage string, p_win double, p_podium double, p_points double")
    got = rollups.field_totals(long, "event", "stage", p={"win": "p_win", "podium": "p_podium", "points": "p_points"})
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([
        (1, "raw", "win", 0.75), (1, "raw", "podium", 1.0), (1, "raw", "points", 1.0), (1, "blended", "win", 1.0), (1, "blended", "podium", None),
        (1, "blended", "points", 1.0), (None, "raw", "win", 0.0), (None, "raw", "podium", 0.25), (None, "raw", "points", 0.5)], key=str)


def test_pivot_methods_groups_once(spark):
    long = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.25), (2, "b", None), (None, "a", 1.0), (3, "c", 0.75)], "k long, method string, p double")
    got = scoring.pivot_methods(long, ["k"], "method", ["a", "b"], ["p"])
    assert got.columns == ["k", "a_p", "b_p"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 0.5, 0.25), (2, None, None), (None, 1.0, None), (3, None, None)], key=str)
    dealt = scoring.pivot_methods(long.repartition(3, "k"), ["k"], "method", ["a", "b"], ["p"])
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_score_forecasts_stays_inside_the_deal_by_event(spark):
    schema = "event long, method string, stage string, entrant string, predicted_order int, p_win double, p_podium double, p_points double"
    long = spark.createDataFrame([(1, "m", "raw", "a", 1, 0.5, 0.5, 0.5), (1, "m", "raw", None, 2, 0.25, 0.5, 0.5), (None, "m", "raw", "a", 1, 0.5, 0.5, 0.5),
                                  (2, "m", "raw", "a", 1, 0.5, 0.5, 0.5), (2, "m", "raw", "z", 2, 0.5, 0.5, 0.5)], schema)
    out = spark.createDataFrame([(1, "a", 1, 1, 25.0), (1, None, 2, None, 0.0), (None, "a", 1, 1, 25.0), (2, "a", 1, 1, 25.0), (2, "a", 3, 3, 15.0)],
                                "event long, entrant string, finish_order int, position int, points double")
    none = find_hot(out, ["event"], 10**6)
    gaps = {tuple(r) for r in scoring.roster_gaps(long, out, "event", "entrant").collect()}
    assert gaps == {(2, "m", "raw", 2, 0, 2)}  # nulls match nulls, an entrant named twice and one unknown do not
    for hot in (none, find_hot(out, ["event"], 1)):
        got = {r["event"]: r for r in scoring.score_forecasts(long, out, "event", "entrant", hot, strict=False).collect()}
        assert set(got) == {1, 2, None} and got[1]["mae"] == 0.0 and got[None]["winner_top1"] == 1
        assert got[2]["mae"] == 1.0 and got[2]["win_brier"] == 0.25  # two outcomes of one entrant make two rows
    a, b = long.repartition(3, "event"), out.repartition(3, "event")
    plan = scoring.score_forecasts(a, b, "event", "entrant", none, strict=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 2


def test_curves_of_large_keys_are_dealt_and_counted(spark, monkeypatch):
    monkeypatch.setattr(hot_module, "TASK_ROWS", 100)
    rows = [(k, i, i * i % 3 % 2, (i * 7 % 10) / 10) for k in (1, 2, None) for i in range(400 if k == 1 else 90)]
    d = spark.createDataFrame(rows, "k long, id long, y int, p double")
    plain, large = find_hot(d, ["k"]), find_hot(d, ["k"], 100)
    assert large and not plain
    want, got = (sorted(map(tuple, metrics.average_precision(d, "y", "p", ["k"], ["id"], h).collect()), key=str) for h in (plain, large))
    assert [w[0] for w in want] == [g[0] for g in got] and np.allclose([w[1] for w in want], [g[1] for g in got], rtol=1e-12)
    plan = metrics.average_precision(d, "y", "p", ["k"], ["id"], plain)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    auc = metrics.roc_auc(d, "y", "p", ["k"], large)
    assert "_chunk" not in auc._jdf.queryExecution().toString()  # ten counts for a key are few
    assert sorted(map(tuple, auc.collect()), key=str) == sorted(map(tuple, metrics.roc_auc(d, "y", "p", ["k"], plain).collect()), key=str)
