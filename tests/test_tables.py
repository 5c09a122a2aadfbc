"""Joins, rules (one violation each), observation log, sources."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from priorfield.operators import joins, obslog, quality
from priorfield.operators.hot import find_hot
from priorfield.sources import io


def rules(df):
    return sorted({r["rule"] for r in df.collect()})


def test_join_checked_and_lookup(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1, "x"), (None, "n")], "k int, v string")
    got = joins.join_checked(a, b, ["k"])
    assert sorted((r["k"] or 0, r["v"] or "") for r in got.collect()) == [(0, "n"), (1, "x"), (1, "x"), (2, "")]
    with pytest.raises(joins.RuleViolation):
        joins.join_checked(a, b.union(b), ["k"])
    many = spark.range(40).select((F.col("id") % 3).alias("k"), "id")
    dim = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    plain = sorted(map(tuple, joins.lookup(many, dim, "k").collect()), key=str)
    hot = sorted(map(tuple, joins.lookup(many, dim, "k", find_hot(many, ["k"], 5)).collect()), key=str)
    assert plain == hot and len(hot) == 40


def test_rules(spark):
    ok = spark.createDataFrame([(1, "a", 1, 1, 0), (1, "b", 2, 0, 0), (1, "c", 3, 0, 0)], "e int, d string, o int, win int, x int")
    assert rules(quality.check_contiguous(ok, "e", "o")) == []
    assert rules(quality.check_contiguous(ok.withColumn("o", F.col("o") + 1), "e", "o")) == ["contiguous"]
    assert rules(quality.check_contiguous(ok.withColumn("o", F.greatest(F.col("o"), F.lit(2))), "e", "o")) == ["contiguous"]
    assert rules(quality.check_unique(ok, ["e"])) == ["unique"] and rules(quality.check_unique(ok, ["e", "d"])) == []
    assert rules(quality.check_event_counts(ok, "e", {"win": 1})) == [] and rules(quality.check_event_counts(ok, "e", {"win": 2})) == ["event_counts"]
    assert rules(quality.check_columns(ok, ["e", "zz"])) == ["columns"] and rules(quality.check_columns(ok, ["d", "e", "o", "win", "x"], True)) == ["columns"]
    p = spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, 1.5), (4, None)], "k int, p double")
    assert quality.check_probability(p, ["k"], ["p"]).count() == 3
    s = spark.createDataFrame([(1, "train", 1), (2, "validation", 1), (2, "train", 0)], "e int, split string, day int")
    assert rules(quality.check_splits(s, "split", "e", "day", ["train", "validation"])) == ["split_disjoint", "split_order"]
    with pytest.raises(joins.RuleViolation):
        quality.strict(quality.check_unique(ok, ["e"]))


def test_table_diff(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-12), (2, None), (4, 3.0)], "k int, v double")
    assert sorted(r["k"] for r in joins.table_diff(a, b, ["k"], ["v"], atol=1e-9).collect()) == [3, 4]


def test_observation_log(spark):
    t = dt.datetime
    new = spark.createDataFrame([(1, "u", b"a", t(2024, 1, 1), None, None), (2, "u", b"b", t(2024, 1, 2), None, None), (3, "u", b"a", t(2024, 1, 3), None, None)],
                                "observation_id long, uri string, payload binary, retrieved_at timestamp, reviewed_by string, reviewed_at timestamp")
    log = obslog.append_observations(None, new, ["uri"])
    rows = {r["observation_id"]: r for r in log.collect()}
    assert rows[3]["previous_observation"] == 2 and rows[3]["first_observed_at"] == t(2024, 1, 1) and rows[1]["previous_observation"] is None
    assert obslog.tampered(log).isEmpty()
    log = log.withColumn("published_at", F.col("retrieved_at"))
    got = obslog.available_asof(log, F.lit("2024-01-02 12:00:00").cast("timestamp"), F.lit(86400))
    assert [r["observation_id"] for r in got.collect()] == [2]


def test_closure_and_cycles(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (4, 2), (3, 1), (2, 1), (9, 8)], "src long, dst long")
    got = obslog.evidence_closure(edges, spark.createDataFrame([(5,)], "n long"))
    assert sorted(r["node"] for r in got.collect()) == [1, 2, 3, 4, 5]
    assert obslog.find_cycles(edges).isEmpty()
    loop = edges.union(spark.createDataFrame([(1, 4)], "src long, dst long"))
    assert sorted((r["src"], r["dst"]) for r in obslog.find_cycles(loop).collect()) == [(1, 4), (2, 1), (3, 1), (4, 2), (4, 3)]


def test_publication_bounds(spark):
    d = spark.createDataFrame([(dt.date(2018, 1, 31), None)], "claimed_day date, published_at timestamp")
    r = obslog.publication_bounds(d).first()
    assert r["earliest"] == dt.datetime(2018, 1, 30, 10) and r["latest"] == dt.datetime(2018, 2, 1, 12)


def test_sources(spark, tmp_path):
    d = spark.range(10).select("id", F.when(F.col("id") < 5, "train").otherwise("test").alias("split"))
    io.write_feature_table(d, str(tmp_path / "f"), buckets=2)
    assert io.read_splits(spark, str(tmp_path / "f"), ["train"]).count() == 5
    io.write_once(d, str(tmp_path / "o"))
    with pytest.raises(Exception):
        io.write_once(d, str(tmp_path / "o"))
    pages = spark.createDataFrame([("a", '{"total":3,"offset":0,"rows":[{"id":1},{"id":2}]}'), ("a", '{"total":3,"offset":2,"rows":[{"id":3}]}'),
                                   ("b", '{"total":2,"offset":0,"rows":[{"id":1}]}')], "src string, body string")
    schema = "struct<total:long,offset:long,rows:array<struct<id:long>>>"
    assert io.flatten_pages(pages, "body", schema, "rows", ["src"]).count() == 4
    assert [r["src"] for r in io.page_conflicts(pages, "body", schema, "rows", ["src"]).collect()] == ["b"]


def test_registry():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 150


def test_season_batches_hold_every_row(spark):
    from priorfield.plans import catalog
    from priorfield.plans.orders import OrderTables

    folder = "/root/testdata/sf0.001"
    entries = OrderTables(spark, folder).entries()
    got = {r.batch: r.n for r in catalog.QUERIES["union_season_batches"](spark, folder).collect()}
    assert len(got) > 2 and sum(got.values()) == entries.count()


def test_selection_covers_candidates_targets_and_folds(spark, monkeypatch):
    """What the queries hand to cross-validation and selection; fits are replaced by a made-up table."""
    from priorfield.operators import models
    from priorfield.plans import catalog, queries_models as q

    folder, seen, chosen = "/root/testdata/sf0.001", [], []

    def cv(d, targets, candidates, folds, season):
        seen.append((list(targets), [c.name for c in candidates], folds))
        last = {(y, c.family): c.name for y in targets for c in candidates if (y, c.family) != ("win", "logistic") or c.name == "logistic_small_1"}
        return spark.createDataFrame([(y, c.name, c.family, name, 1, 0.1 if last[y, c.family] == c.name else 0.5, 0.1) for y in targets for c in candidates for name, *_ in folds],
                                     "target string, candidate string, family string, fold string, rows long, log_loss double, brier double")

    def family(train, calibration, selection, targets, best):
        chosen.append((list(targets), {f: c.name for f, c in best.items()}))
        return spark.createDataFrame([(y, f, 0.1, 0.1, 1) for y in targets for f in best], "target string, family string, log_loss double, brier double, chosen int"), {}

    monkeypatch.setattr(models, "temporal_cv", cv)
    monkeypatch.setattr(models, "select_family", family)
    assert catalog.QUERIES["temporal_cv"](spark, folder).count() == 3 * 6 * 3
    assert catalog.QUERIES["select_family"](spark, folder).count() == 6
    for targets, candidates, folds in seen:
        assert targets == ["win", "podium", "points_finish"] and sorted(candidates) == sorted(c.name for c in q.grid())
        assert folds == [("f1996", 1995, 1996), ("f1997", 1996, 1997), ("f1998", 1997, 1998)]
    assert [y for ys, _ in chosen for y in ys] == ["win", "podium", "points_finish"]
    assert chosen[0][1] == {"logistic": "logistic_small_1", "forest": "forest_full_0"} and chosen[1][1]["logistic"] == "logistic_full_1"


def test_counts_of_differences_take_one_join(spark, monkeypatch):
    from priorfield.operators import hot, joins

    kind = "e long, x long, p double, q double"
    rows = [(1, 1, 1.0, 2.0), (2, 1, None, 2.0), (2, 2, 0.5, None), (3, 1, 1.0, 1.0), (3, 1, 1.0, 9.0), (None, 1, 1.0, 1.0), (4, 4, 1.0, 1.0)]
    other = [(1, 1, 1.0, 2.5), (2, 1, None, 2.0), (2, 2, 0.5, None), (3, 1, 1.0, 1.0), (None, 1, 1.0, 1.0), (5, 5, 1.0, 1.0)]
    a, b = spark.createDataFrame(rows, kind), spark.createDataFrame(other, kind)
    planted = F.col("e") == 2
    wrong = b.withColumn("p", F.when(planted, F.coalesce("p", F.lit(0)) + 1).otherwise(F.col("p")))
    want = (a.join(b, ["e", "x"]).count(), joins.table_diff(a, b, ["e", "x"], ["p", "q"]).count(), joins.table_diff(a, wrong, ["e", "x"], ["p", "q"]).count())
    assert tuple(joins.diff_counts(a, b, ["e", "x"], ["p", "q"], planted).first()) == want == (5, 10, 12)
    monkeypatch.setattr(hot, "TASK_ROWS", 1)
    got = joins.diff_counts(a, b, ["e", "x"], ["p", "q"], planted, total=7)
    assert tuple(got.first()) == want and tuple(joins.diff_counts(a.limit(0), b.limit(0), ["e", "x"], ["p", "q"], planted).first()) == (0, 0, 0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "hashpartitioning(e" in plan and ", 7)" in plan
