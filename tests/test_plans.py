"""What reaches the scan, and what the plans are made of."""

import re

from driftline.operators import drift, merkle, profile

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_the_columns_and_rows_asked_for_are_read(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    text = plan(drift.long_numbers(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), ["l_quantity"]))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", text)) == {"l_quantity:double,l_returnflag:string"}
    assert "EqualTo(l_returnflag,A)" in text and "EqualTo(l_returnflag,R)" in text
    text = plan(profile.profile_frame(li, ["l_tax"]))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", text)) == {"l_tax:double"}


def test_one_aggregation_profiles_all_columns(spark):
    text = plan(profile.profile_frame(spark.read.parquet(f"{SF}/lineitem.parquet")))
    assert text.count("Scan parquet") == 1 and text.count("Exchange SinglePartition") == 1


def test_counts_are_summed_before_they_are_dealt(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    text = plan(drift.long_numbers(o, o, ["o_totalprice", "o_custkey"]))
    assert text.index("partial_sum") > text.index("Exchange hashpartitioning")  # a plan is written from its end


def test_no_python_in_plans(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    for df in (drift.drift_frame(o, o), drift.categorical_drift(o, o, ["o_orderstatus"]), merkle.leaves(o.select("o_orderkey", "o_orderstatus"), ["o_orderkey"])):
        assert not re.search("Python|Pandas|Arrow", plan(df))
