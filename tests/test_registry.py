"""The registered queries: names, plans, and a comparison with their SQL on the smallest tables."""

import glob
import os
import re
import sys

import duckdb
import pytest

import __spark_entry__ as contract
from check import compare
from conftest import SMALL
from reviewmine.plans import all_queries
from reviewmine.sources import shared

CHECKED = [
    "state_avg_stars", "state_avg_unmatched", "review_profile", "user_item_sets", "common_items_pair", "ratings_dedup",
    "frequent_itemsets_all", "exact_jaccard", "lsh_similar_pairs", "user_cf_predict", "item_cf_predict",
    "predictions_all", "gn_step",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert {name for name, (_, sql) in all_queries().items() if sql is None} == {"als_predict", "gn_trace", "gn_best_partition"}


def test_entry(spark):
    assert contract.entry(spark).columns == ["state", "stars"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_and_sql(spark, duck, name, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    write = shared.materialize
    for module in [m for n, m in sys.modules.items() if n.startswith("reviewmine.") and getattr(m, "materialize", 0) is write]:
        monkeypatch.setattr(module, "materialize", seen)
    df = contract.queries()[name](spark, SMALL)
    seen(df)
    for plan in plans:
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|FlatMapGroupsInPandas", plan)
    assert compare(df.toPandas(), duck.execute(contract.oracle_sql()[name]).fetch_df()).startswith("ok")


def test_scans_read_only_what_they_need(spark):
    plan = contract.queries()["state_avg_stars"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in plan
    plan = contract.queries()["zero_rating_audit"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_discount,0.0)" in plan
