import os

import pytest
from pyspark.sql import functions as F

from priorfield import session
from priorfield.operators import hot, obslog, windows as w


class _Context:
    master = "spark://somewhere:7077"


class _Session:
    sparkContext = _Context()

    class conf:
        @staticmethod
        def get(key, default):
            return None


def test_cluster_without_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(_Session())


def test_own_folder_is_removed(spark):
    before = session.shared_dir(spark)
    with session.own_folder(spark) as path:
        assert session.materialize(spark.range(5)).count() == 5 and os.listdir(path)
    assert not os.path.exists(path) and session.shared_dir(spark) == before


def test_no_hot_key_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(hot, "MAX_HOT", 3)
    d = spark.range(100).select((F.col("id") % 10).alias("k"))
    assert not hot.find_hot(d, ["k"], 4)  # ten keys of 10 rows, none above a third of all rows
    assert hot.find_hot(d.unionByName(spark.range(90).select(F.lit(1).cast("long").alias("k"))), ["k"], 4).rows.count() == 1


@pytest.mark.parametrize("kind", ["double", "decimal(12,3)", "int"])
def test_rolling_means_do_not_depend_on_the_size_limit(spark, kind):
    d = spark.range(200).select(F.lit(1).alias("k"), F.col("id").alias("at"), F.when(F.col("id") % 7 != 3, (F.rand(5) * 1000).cast(kind)).alias("v"))
    spec = [(["k"], [w.prior_rolling_mean("r5", "v", 5), w.prior_mean("m", "v"), w.prior_count("n")])]
    runs = [w.prior_features(d, spec, ["at"], hot.find_hot(d, ["k"], limit)) for limit in (1000, 6)]
    assert runs[0].schema["m"].dataType == runs[1].schema["m"].dataType and runs[0].schema["r5"].dataType == runs[1].schema["r5"].dataType
    a, b = ({r["at"]: (r["r5"], r["n"]) for r in x.collect()} for x in runs)
    assert a == b


def test_stored_observations_keep_their_links(spark):
    new = spark.sql("SELECT * FROM VALUES (1L, 1L, X'61', TIMESTAMP '2024-01-01 00:00:00'), (2L, 1L, X'62', TIMESTAMP '2024-01-02 00:00:00') AS t(observation_id, src, payload, retrieved_at)")
    new = new.withColumn("reviewed_by", F.lit(None).cast("string")).withColumn("reviewed_at", F.lit(None).cast("timestamp"))
    log = obslog.append_observations(None, new, ["src"])
    review = spark.sql("SELECT 9L AS observation_id, 1L AS reviews, 'me' AS reviewed_by, TIMESTAMP '2024-01-05 00:00:00' AS reviewed_at")
    log = obslog.append_reviews(log, review)
    late = new.filter("observation_id = 1").withColumn("observation_id", F.lit(20).cast("long")).withColumn("retrieved_at", F.expr("TIMESTAMP '2024-02-01 00:00:00'"))
    got = {r["observation_id"]: r for r in obslog.append_observations(log, late, ["src"]).collect()}
    assert [got[i]["previous_observation"] for i in (1, 2, 9, 20)] == [None, 1, 1, 2]
    assert got[20]["first_observed_at"].day == 1 and got[20]["first_observed_at"].month == 1


def test_ages_bounds_and_digests(spark):
    log = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00.1' AS retrieved_at, DATE '2024-03-01' AS claimed_day, TIMESTAMP '2024-02-01 00:00:00' AS published_at")
    asof = lambda limit: obslog.available_asof(log, F.expr("TIMESTAMP '2024-01-01 00:00:09.9'"), limit, ("retrieved_at",))
    assert asof(9).count() == 0 and asof(9.8).count() == 1
    with pytest.raises(Exception, match="negative"):
        asof(-1).collect()
    bounds = [obslog.publication_bounds(log).select(F.unix_micros("latest").alias("t"))]
    zone = spark.conf.get("spark.sql.session.timeZone")
    first = bounds[0].first()["t"]
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert obslog.publication_bounds(log).select(F.unix_micros("latest").alias("t")).first()["t"] == first
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    pairs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "b"), (3, None)], "src long, sha256 string").select(
        "*", F.current_timestamp().alias("retrieved_at"), F.lit(None).cast("string").alias("reviewed_by"))
    got = {r["src"]: r["digest"] for r in obslog.inventory(pairs, ["src"]).collect()}
    assert got[1] != got[2]


def test_closure_and_cycles(spark):
    chain = [(i, i + 1) for i in range(1, 20)] + [(50, 51), (51, 50), (60, 50)]
    forks = chain + [(3, 70), (70, 71), (71, 3)]
    for edges in (chain, forks):
        d = spark.createDataFrame(edges, "src long, dst long")
        for root in (5, 60, 1):
            want, new = set(), {root}
            while new:
                want |= new
                new = {b for a, b in edges if a in new} - want
            got = [r["node"] for r in obslog.evidence_closure(d, spark.createDataFrame([(root,)], "r long")).collect()]
            assert sorted(got) == sorted(want)
    got = {tuple(r) for r in obslog.find_cycles(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == {(50, 51), (51, 50)}
    got = {tuple(r) for r in obslog.find_cycles(spark.createDataFrame(forks, "src long, dst long")).collect()}
    assert got == {(50, 51), (51, 50), (3, 70), (70, 71), (71, 3)}
