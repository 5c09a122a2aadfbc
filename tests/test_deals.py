"""Queries on order tables made here: dealt in proportion to the table, with the results of the plan for few rows."""

import datetime
import os

import pytest

from priorfield.operators import hot
from priorfield.plans import catalog
from priorfield.session import shared_dir

DAY = datetime.datetime(1995, 3, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("orders"))
    tables = {
        "supplier": ([(i, i % 3 if i < 5 else None) for i in range(6)], "s_suppkey long, s_nationkey int"),
        "customer": ([(i, i % 4) for i in range(8)], "c_custkey long, c_nationkey int"),
        "orders": ([(i, DAY + datetime.timedelta(days=17 * (i % 90)), i % 9) for i in range(120)], "o_orderkey long, o_orderdate timestamp, o_custkey long"),
        "lineitem": ([(i % 125, (i * 7 + i // 125) % 7, i // 125, 10.0 + i % 37, i % 11, float(1 + i % 50), (i % 10) / 100, "ARN"[i % 3], "OF"[i % 2]) for i in range(500)],
                     "l_orderkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_partkey long, l_quantity double, l_discount double, l_returnflag string, l_linestatus string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


def run(spark, folder, name):
    """Rows, the plan, and the number of copies written on the way."""
    before = set(os.listdir(shared_dir(spark)))
    d = catalog.QUERIES[name](spark, folder)
    rows = sorted(map(tuple, d.collect()), key=str)
    return rows, d._jdf.queryExecution().executedPlan().toString(), len(set(os.listdir(shared_dir(spark))) - before)


def test_train_serve_parity_compares_on_the_deal_of_its_join(spark, folder, monkeypatch):
    few, _, copies = run(spark, folder, "train_serve_parity")
    assert copies == 1  # the history alone
    monkeypatch.setattr(hot, "TASK_ROWS", 100)
    many, _, _ = run(spark, folder, "train_serve_parity")
    assert few == many and few[0][0] > 200 and few[0][1] == 0


def test_full_feature_table_deals_its_joins(spark, folder, monkeypatch):
    few, _, _ = run(spark, folder, "full_feature_table")
    monkeypatch.setattr(hot, "TASK_ROWS", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many, plan, _ = run(spark, folder, "full_feature_table")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert few == many and len(few) > 200
    for key in ("season", "event_id"):  # both sides of the null-safe joins keep their own deal
        assert sum("REPARTITION_BY_NUM" in x and f"hashpartitioning(coalesce({key}" in x for x in plan.splitlines()) >= 2


def test_dealt_join_matches_nulls(spark, monkeypatch):
    monkeypatch.setattr(hot, "TASK_ROWS", 2)
    a = spark.createDataFrame([(1, "x", 1), (None, "x", 2), (0, None, 3), (2, "", 4)], "k long, s string, a long")
    b = spark.createDataFrame([(1, "x", 10), (None, "x", 20), (0, None, 30), (0, "", 40), (1, "x", 50)], "k long, s string, b long")
    groups = hot.find_hot(a, ["k"])
    for how, extra in (("inner", []), ("left", [(2, "", 4, None)])):
        got = hot.join_dealt(a, b, ["k", "s"], groups, how).collect()
        assert sorted(map(tuple, got), key=str) == sorted([(1, "x", 1, 10), (1, "x", 1, 50), (None, "x", 2, 20), (0, None, 3, 30), *extra], key=str)
        assert sum(r["b"] == 40 for r in got) == 0
