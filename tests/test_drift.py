import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.errors import SchemaError
from driftline.operators import drift, profile


def frame(spark, values, kind="double", name="v"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def metrics(spark, a, b, kind="double"):
    return drift.numeric_drift(frame(spark, a, kind), frame(spark, b, kind), ["v"]).first()


def ks_of(a, b):
    return max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in [*a, *b])


@pytest.mark.parametrize("a,b,d", [([1, 2, 3, 4], [1, 2, 3, 4], 0.0), ([1, 2, 3], [100, 200, 300], 1.0), ([1, 1, 1, 1], [1], 0.0), ([0, 1], [1, 1, 1, 2, 3], 0.5)])
def test_ks(spark, a, b, d):
    r = metrics(spark, a, b, "int")
    assert r["ks_statistic"] == pytest.approx(d, abs=1e-12)
    assert r["ks_p_value"] == 1.0 if d == 0 else r["ks_p_value"] < 1


def test_sides_without_numbers(spark):
    assert metrics(spark, [], [1, 2], "int")["ks_statistic"] is None
    r = metrics(spark, [math.nan, math.nan], [1.0, 2.0])
    assert (r["ks_statistic"], r["psi_statistic"]) == (None, None)
    assert drift.data_drift(frame(spark, [], "int"), frame(spark, [1], "int")) == {}


def test_psi(spark):
    assert metrics(spark, range(100), range(100), "int")["psi_statistic"] == pytest.approx(0, abs=1e-9)
    assert metrics(spark, [1, 2, 3, 4, 5], [6, 7, 8, 9, 10], "int")["psi_statistic"] > 0.1
    assert metrics(spark, [5.0] * 3, [5.0])["psi_statistic"] == 0.0
    a = [float(i % 10) for i in range(90)] + [100.0 + 90 * i for i in range(10)]
    b = [float(10 + i % 10) for i in range(90)] + [100.0 + 90 * i for i in range(10)]
    assert metrics(spark, a, b)["psi_statistic"] > 0.25
    assert metrics(spark, [1.0, 2.0, math.nan, 3.0], [1.0, 2.0, 3.0])["psi_statistic"] == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("seed", range(4))
def test_against_models(spark, seed):
    r = random.Random(seed)
    a = [r.choice((r.gauss(0, 1), r.randint(-3, 3))) * 1.0 for _ in range(r.randint(1, 60))]
    b = [r.choice((r.gauss(0.3, 2), r.randint(-3, 3))) * 1.0 for _ in range(r.randint(1, 60))]
    got = metrics(spark, a, b)
    assert got["ks_statistic"] == pytest.approx(ks_of(a, b), abs=1e-12)
    assert got["psi_statistic"] == pytest.approx(drift.psi_of_samples(a, b), abs=1e-9)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=1, max_size=30))
def test_psi_of_itself(values):
    assert drift.psi_of_samples(values, values) == pytest.approx(0, abs=1e-9)


def test_quantiles():
    assert [drift.quantile_of([0, 10, 20, 30, 40], q) for q in (0, 0.125, 0.25, 0.5, 1)] == [0, 5, 10, 20, 40]


def test_categorical(spark):
    a, b = frame(spark, ["active"] * 9 + ["inactive"], "string"), frame(spark, ["inactive"] * 9 + ["active"], "string")
    found = drift.data_drift(a, b)["v"]
    assert found.categorical_drift > 0.25 and found.breaches(0.25) and not found.breaches(100)
    assert found.ks_statistic is None and found.mean_drift is None
    assert drift.categorical_drift(a, a, ["v"]).first()[1] == pytest.approx(0, abs=1e-12)
    assert drift.categorical_drift(a, frame(spark, [None], "string"), ["v"]).count() == 0


def test_stats(spark):
    a, b = frame(spark, [1, 2, 3], "int"), frame(spark, [10, 20, None], "int")
    r = drift.stats_drift(a, b).first()
    assert (r["mean_drift"], r["null_count_drift"]) == (13.0, 1)
    s = profile.column_stats(a)["v"]
    assert (s.mean, s.min, s.max, s.variance, s.row_count) == (2.0, 1.0, 3.0, pytest.approx(2 / 3), 3)
    s = profile.column_stats(frame(spark, [1.0, math.nan, 3.0]))["v"]
    assert (s.null_count, s.mean, s.min, s.max) == (0, 2.0, 1.0, 3.0)
    assert profile.column_stats(spark.createDataFrame([(None,)], "v decimal(10,2)"))["v"] == profile.ColumnStats(1, 1)
    assert profile.column_stats(frame(spark, [], "int")) == {}


def test_unsigned_64_bit_counts_as_number(spark):
    schema = T.StructType([T.StructField("u", T.DecimalType(20, 0), True, {"arrow_type": "UInt64"})])
    import decimal

    df = spark.createDataFrame([(decimal.Decimal(k),) for k in (1, 2, 3)], schema)
    assert profile.column_stats(df)["u"].mean == 2.0


def test_changed_type_never_breaches(spark):
    found = drift.data_drift(frame(spark, [1, 2], "int"), frame(spark, ["a", "b"], "string"))["v"]
    assert (found.ks_statistic, found.psi_statistic, found.categorical_drift) == (None, None, None)


def test_schema_drift(spark):
    old, new = T.StructType.fromDDL("id int, name string, age int"), T.StructType.fromDDL("id bigint, name string, email string")
    d = drift.schema_drift(old, new)
    assert (d.added_fields, d.removed_fields, d.changed_types) == (["email"], ["age"], [{"field_name": "id", "old_type": "Int32", "new_type": "Int64"}])
    assert sorted((r[0], r[1]) for r in drift.schema_drift_frame(spark, old, new).collect()) == [("age", "removed"), ("email", "added"), ("id", "type")]


def test_duplicate_names(spark):
    with pytest.raises(SchemaError):
        profile.profile_frame(spark.range(2).select("id", F.col("id")))


def test_odd_names(spark):
    df = spark.createDataFrame([(1, "x")], "`a.b` int, `c``d` string")
    assert set(profile.column_stats(df)) == {"a.b", "c`d"}
    assert set(drift.data_drift(df, df)) == {"a.b", "c`d"}
