"""History windows: the plain and the chunked plan must agree with a row-by-row recomputation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from priorfield.operators import hot, windows as w
from priorfield.operators.hot import find_hot


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 600
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 12, n))
    pdf = pd.DataFrame({
        "k": key, "sub": rng.integers(0, 3, n), "day": rng.integers(0, 40, n), "id": rng.permutation(n),
        "v": np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 9, n)), "score": rng.integers(0, 7, n),
    })
    pdf = pdf.astype({"v": object}).where(pdf.notna(), None)
    schema = "k long, sub long, day long, id long, v double, score long"
    return pdf, spark.createDataFrame(list(pdf.itertuples(index=False, name=None)), schema)


SPECS = [w.prior_count("n"), w.prior_sum("s", "v"), w.prior_mean("m", "v"),
         w.previous("p", "v"), w.prior_rolling_mean("r3", "v", 3), w.prior_rolling_mean("r10", "v", 10)]


def expected(pdf, keys):
    d = pdf.sort_values(["day", "id"]).copy()
    d["v"] = d["v"].astype(float)
    g = d.groupby(keys)["v"]
    d["n"] = d.groupby(keys).cumcount()
    d["s"] = g.transform(lambda x: x.fillna(0).cumsum() - x.fillna(0))
    d["m"] = g.transform(lambda x: x.shift().expanding(1).mean())
    d["p"] = g.shift()
    d["r3"] = g.transform(lambda x: x.shift().rolling(3, 1).mean())
    d["r10"] = g.transform(lambda x: x.shift().rolling(10, 1).mean())
    return d.sort_values("id").reset_index(drop=True)


@pytest.mark.parametrize("limit", [10_000, 30, 7])
@pytest.mark.parametrize("keys", [["k"], ["k", "sub"]])
def test_prior_features(frame, limit, keys):
    pdf, df = frame
    hot = find_hot(df, ["k"], limit)
    assert bool(hot) == (limit < 1000)
    keysets = [(["k"], [w.prior_count("_c")])] if keys != ["k"] else []
    got = w.prior_features(df, keysets + [(keys, SPECS)], ["day", "id"], hot)
    got = got.orderBy("id").toPandas()
    want = expected(pdf, keys)
    for c in ["n", "s", "m", "p", "r3", "r10"]:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-12)


@pytest.mark.parametrize("limit", [10_000, 7])
def test_event_windows(frame, limit):
    pdf, df = frame
    hot = find_hot(df, ["k"], limit)
    got = w.rank_average(df, "k", "score", "ra", hot)
    got = w.attach_group(got, ["k"], hot, size=F.count(F.lit(1)), best=F.min("v"))
    got = w.next_in(got, ["k"], ["day", "id"], "id", "nxt", hot)
    got = w.rank_first(got, "k", ["score", "id"], "rf", hot).orderBy("id").toPandas()
    d = pdf.sort_values(["day", "id"]).copy()
    d["nxt"] = d.groupby("k")["id"].shift(-1)
    d["ra"] = d.groupby("k")["score"].rank()
    d["size"] = d.groupby("k")["id"].transform("size")
    d["best"] = d.assign(v=d.v.astype(float)).groupby("k")["v"].transform("min")
    d["rf"] = d.sort_values(["score", "id"]).groupby("k").cumcount() + 1
    d = d.sort_values("id").reset_index(drop=True)
    for c in ["nxt", "ra", "size", "best", "rf"]:
        np.testing.assert_allclose(got[c].astype(float), d[c].astype(float))


def test_event_seq_chunks(frame):
    pdf, df = frame
    hot = find_hot(df.withColumn("_all", F.lit(1)), ["_all"], 50)
    got = w.event_seq(df, ["day", "id"], "seq", hot).orderBy("seq").toPandas()
    want = pdf.sort_values(["day", "id"])["id"].tolist()
    assert got["id"].tolist() == want and got["seq"].tolist() == list(range(len(pdf)))


def test_first_and_last_per(frame):
    pdf, df = frame
    got = w.first_per(df, ["k"], ["day", "id"], total=F.sum("v")).orderBy("k").toPandas()
    d = pdf.sort_values(["day", "id"]).groupby("k").first().reset_index()
    assert got["id"].tolist() == d["id"].tolist()
    got = w.last_per(df, ["k"], ["day", "id"]).orderBy("k").toPandas()
    d = pdf.sort_values(["day", "id"]).groupby("k").last().reset_index()
    assert got["id"].tolist() == d["id"].tolist()


def test_blocks_and_folds(frame):
    pdf, df = frame
    got = w.assign_blocks(df.select("day", "id"), ["day", "id"], {"a": 8, "b": 7}, "c")
    assert {r["block"]: r["count"] for r in got.groupBy("block").count().collect()} == {
        "a": 8, "b": 7, "c": len(pdf) - 15}
    folds = w.temporal_folds(df, "day", [("f1", 10, 11), ("f2", 11, 12)]).toPandas()
    assert (folds[folds.fold_role == "fit"].groupby("fold").day.max() == [10, 11]).all()


def test_rows_are_dealt_in_proportion_to_the_table(spark, monkeypatch):
    monkeypatch.setattr(hot, "TASK_ROWS", 10)
    d = spark.range(1000).select((F.col("id") % 300).alias("k"), "id")
    found = hot.find_hot(d, ["k"])
    dealt = hot.deal(d, found)
    assert dealt.rdd.getNumPartitions() == 100 and dealt.count() == 1000
    assert hot.deal(d.limit(10), hot.find_hot(d.limit(10), ["k"])).rdd.getNumPartitions() != 100
    assert hot.deal(d, hot.find_hot(d, ["k"], 3)) is d  # large keys are cut, not dealt
    plan = w.rank_first(dealt, "k", ["id"], "r", found)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("inclusive", [False, True])
def test_chunks_shorter_than_a_rolling_frame(spark, inclusive):
    d = spark.range(90).select((F.col("id") % 2).alias("k"), F.col("id").alias("at"), F.when(F.col("id") % 7 != 3, F.rand(5) * 9).alias("v"))
    specs = [w.prior_rolling_mean("r3", "v", 3), w.prior_rolling_mean("r10", "v", 10), w.previous("p", "v"), w.prior_sum("s", "at")]
    runs = [w.prior_features(d, [(["k"], specs)], ["at"], hot.find_hot(d, ["k"], limit), inclusive) for limit in (1000, 6)]
    a, b = ({r["at"]: (r["r3"], r["r10"], r["p"], r["s"]) for r in x.collect()} for x in runs)
    assert a == b and len(a) == 90


def test_chunked_sums_carry_no_rows(spark):
    d = spark.range(90).select((F.col("id") % 2).alias("k"), F.col("id").alias("at"))
    plan = w.prior_features(d, [(["k"], [w.prior_sum("s", "at"), w.prior_count("n")])], ["at"], hot.find_hot(d, ["k"], 6))
    assert "collect_list" not in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("limit", ["20", "1000000"])
def test_asof_computes_the_history_once(spark, limit):
    """A history that is costly to make: one key with most rows, null keys, dates and values, equal dates."""
    from priorfield.operators import asof

    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def key(x):
        seen.add(1)
        return x

    rows = [(1 if i % 3 else (None if i % 2 else i % 5), i, None if i % 11 == 0 else i // 2, None if i % 7 == 0 else i) for i in range(90)]
    history = spark.createDataFrame(rows, "k long, id long, day long, v long").withColumn("k", key("k"))
    ask = spark.createDataFrame([(k, d) for k in (0, 1, 4, None) for d in (0, 17, 40, 99)], "k long, cut long")
    sets = [(["k"], [w.prior_count("n"), w.prior_sum("total", "v")])]
    spark.conf.set("spark.priorfield.maxGroupRows", limit)
    try:
        got = {(r.k, r.cut): (r.n, r.total) for r in asof.asof_features(ask, history, sets, ["day", "id"], "cut").collect()}
    finally:
        spark.conf.unset("spark.priorfield.maxGroupRows")
    for (k, cut), found in got.items():  # null dates come first in the order
        mine = [r for r in rows if r[0] == k and (r[2] is None or r[2] < cut)]
        assert found == (len(mine), sum(r[3] or 0 for r in mine))
    assert len(got) == 16 and seen.value == len(rows)


def test_history_rows_are_dealt_in_proportion_to_the_table(spark, monkeypatch):
    d = spark.range(1000).select((F.col("id") % 300).alias("k"), F.when(F.col("id") % 300 != 7, F.col("id") % 4).alias("s"), "id")
    sets = [(["k"], [w.prior_sum("before", "id"), w.prior_rolling_mean("r3", "id", 3)]), (["k", "s"], [w.prior_count("n")])]
    plain = w.prior_features(d, sets, ["id"], hot.find_hot(d, ["k"])).collect()
    monkeypatch.setattr(hot, "TASK_ROWS", 10)
    got = w.prior_features(d, sets, ["id"], hot.find_hot(d, ["k"]), dealt=False)
    assert got.rdd.getNumPartitions() == 100 and sorted(got.collect()) == sorted(plain)
    plan = got.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # one deal serves every window
    large = w.prior_features(d.withColumn("k", F.least("k", F.lit(250))), sets, ["id"], hot.find_hot(d.withColumn("k", F.least("k", F.lit(250))), ["k"], 20), dealt=False)
    assert large.count() == 1000  # rows beside a large key are dealt too


def test_chunks_of_large_keys_are_counted_limits_and_dealt_to_tasks_of_their_own(spark, monkeypatch):
    rows = [(k, i // 3 if i % 11 else None, i, i % 7) for k in (1, None) for i in range(300)]
    d = spark.createDataFrame(rows, "k long, o long, i long, v long")
    groups = find_hot(d, ["k"], 40)
    numbered = hot.chunk_hot(d, groups, ["o", "i"]).drop("v").collect()
    for k in (1, None):  # chunks follow the order, nulls first, and hold no more than a few limits' rows
        at = sorted(((r["o"] is not None, r["o"] or 0, r["i"]), r["_chunk"]) for r in numbered if r["k"] == k)
        chunks = [c for _, c in at]
        assert chunks == sorted(chunks) and len(at) == 300 and len(set(chunks)) >= 4 and max(map(chunks.count, chunks)) <= 120
    monkeypatch.setattr(hot, "TASK_ROWS", 50)
    specs = [w.prior_count("n"), w.prior_sum("s", "v"), w.prior_rolling_mean("r", "v", 3)]
    keysets = [(["k"], specs), (["k", "v"], [w.prior_count("nv")])]
    got = w.prior_features(d, keysets, ["o", "i"], groups)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert any("REPARTITION_BY_NUM" in x and "_chunk" in x for x in plan.splitlines())
    want = w.prior_features(d, keysets, ["o", "i"], find_hot(d, ["k"], 10**6))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
