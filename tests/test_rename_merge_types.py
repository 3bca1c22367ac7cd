import itertools
import random

import pytest
from pyspark.sql import types as T

from driftline.errors import SchemaError, UnsupportedDataType
from driftline.functions.types import field_of, own_metadata, parse_type, postgres_type, type_name
from driftline.operators import rename as r
from driftline.operators.drift import SchemaDrift
from driftline.operators.merge import three_way_merge
from driftline.operators.profile import ColumnProfile, ColumnStats
from driftline.plans.service import merge_schemas


def p(kind="Utf8", meaning="Unknown", stats=None):
    return ColumnProfile(kind, meaning, stats)


def test_names_alone():
    assert r.score("customer_id", p(), "customerid", p()).confidence == 1.0
    assert r.score("address_line1", p(), "address_line2", p()) is None  # 1 - 1/12
    assert r.score("shipping_line1", p(), "shipping_line2", p()) is not None  # 1 - 1/13
    assert r.score("created", p(), "updated", p()) is None
    assert r.score("a", p("Int32"), "a", p("Int64")) is None


def test_meaning_and_stats():
    assert r.score("email", p(meaning="Email"), "contact", p(meaning="Email")).confidence > 0.6
    assert r.score("user_email", p(meaning="Email"), "user_phone", p(meaning="PhoneNumber")) is None
    a, b = ColumnStats(0, 10, 5.0, 0.0, 10.0, 4.0), ColumnStats(0, 10, 5.0, 0.0, 10.0, 40.0)
    assert r.stats_similarity(a, a) == 1.0 > r.stats_similarity(a, b)
    assert r.stats_similarity(a, ColumnStats(0, 10)) is None
    assert [r.closeness(*x) for x in ((float("nan"), 1), (0, 0), (1, -1), (1, 2))] == [0.0, 1.0, 0.0, 0.5]


def test_similarity():
    assert r.name_similarity("customer_email", "email_customer") == 1.0
    assert r.name_similarity("", "") == 1.0
    assert r.edit_distance("kitten", "sitting") == 3 and r.edit_distance("", "ab") == 2 and r.edit_distance("😀", "a") == 1


def test_assignment_is_optimal():
    assert r.best_assignment([[0.90, 0.85], [0.86, 0.50]]) == [1, 0]
    rng = random.Random(4)
    for _ in range(200):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        gain = [[rng.choice((0, 0, rng.random())) for _ in range(m)] for _ in range(n)]
        best = max(sum(gain[i][j] for i, j in zip(rows, cols, strict=True)) for k in range(min(n, m) + 1) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
        got = r.best_assignment(gain)
        used = [j for j in got if j is not None]
        assert len(set(used)) == len(used)
        assert sum(gain[i][j] for i, j in enumerate(got) if j is not None) == pytest.approx(best)


def test_folding():
    old = {"user_email": p(meaning="Email"), "user_phone": p(meaning="PhoneNumber"), "gone": p()}
    new = {"email_addr": p(meaning="Email"), "phone_no": p(meaning="PhoneNumber")}
    d = r.fold_renames(SchemaDrift(sorted(new), sorted(old)), old, new)
    assert {(x["from"], x["to"]) for x in d.renamed_fields} == {("user_email", "email_addr"), ("user_phone", "phone_no")}
    assert (d.added_fields, d.removed_fields) == ([], ["gone"])


def s(ddl):
    return T.StructType.fromDDL(ddl)


@pytest.mark.parametrize("base,ours,theirs,names,kinds", [
    ("id int", "id int, email string", "id int, age int", ["age", "email", "id"], []),
    ("id int", "id int, tag string", "id int, tag int", ["id", "tag"], ["AddAdd"]),
    ("id int", "id int, tag string", "id int, tag string", ["id", "tag"], []),
    ("amount int", "amount bigint", "amount double", ["amount"], ["ModifyModify"]),
    ("amount int", "amount bigint", "amount bigint", ["amount"], []),
    ("a int, status int", "a int", "a int, status bigint", ["a", "status"], ["RemoveModify"]),
    ("a int, status int", "a int, status bigint", "a int", ["a", "status"], ["RemoveModify"]),
    ("a int, b int", "a int", "a int, b int", ["a"], []),
    ("a int, b int", "a int", "a int", ["a"], []),
    ("a int", "a bigint", "a int", ["a"], []),
    ("a int", "a int NOT NULL", "a int", ["a"], []),
])
def test_merge(base, ours, theirs, names, kinds):
    m = three_way_merge(s(base), s(ours), s(theirs))
    assert m.merged.names == names and [c.kind for c in m.conflicts] == kinds and m.is_clean == (not kinds)


def test_merge_keeps_sides_and_metadata():
    m = three_way_merge(s("a int"), s("a bigint"), s("a double"))
    assert type_name(m.merged["a"]) == "Int64" and m.conflicts[0].theirs == "Float64 (nullable)"
    assert type_name(three_way_merge(s("a int, b int"), s("a int"), s("a int, b bigint")).merged["b"]) == "Int64"
    noted = T.StructType([T.StructField("a", T.IntegerType(), True, {"comment": "x"})])
    assert three_way_merge(s("a int"), noted, s("a int")).merged["a"].metadata == {"comment": "x"}
    m = three_way_merge(s("a int"), s("a int"), s("a int"), ({"k": "1"}, {"k": "2"}, {"k": "3", "n": "4"}))
    assert m.metadata == {"k": "2", "n": "4"} and m.conflicts[0].field_name == "<schema metadata: k>"
    with pytest.raises(SchemaError):
        three_way_merge(T.StructType(s("a int").fields * 2), s("a int"), s("a int"))
    out = merge_schemas([{"name": "a", "data_type": "UInt8", "nullable": True}], [], [{"name": "a", "data_type": "UInt8", "nullable": False}])
    assert out["merged"] == [{"name": "a", "data_type": "UInt8", "nullable": False}] and out["conflicts"][0]["kind"] == "RemoveModify"


TYPES = ["Boolean", "Int8", "Int16", "Int32", "Int64", "UInt8", "UInt16", "UInt32", "UInt64", "Float32", "Float64", "Utf8", "LargeUtf8", "Binary", "LargeBinary", "FixedSizeBinary(16)", "Date32", "Date64", "Time32(Second)", "Time64(Nanosecond)", "Decimal128(10, 2)", "Decimal256(60, 5)", "Timestamp(Nanosecond, None)", 'Timestamp(Microsecond, Some("+00:00"))']


@pytest.mark.parametrize("name", TYPES)
def test_types_round_trip(name):
    assert type_name(field_of("c", name)) == name
    assert own_metadata(field_of("c", name, True, {"k": "v"})) == {"k": "v"}


@pytest.mark.parametrize("name", ["List(Int32)", "", "Int128", "Timestamp(Week, None)", "Decimal128(10)", "array<int>"])
def test_types_refused(name):
    with pytest.raises(UnsupportedDataType):
        parse_type(name)


def test_postgres_types():
    assert [postgres_type(*x) for x in (("integer",), ("numeric", 10, 2), ("numeric",), ("numeric", 50, 2), ("jsonb",), ("uuid",), ("timestamptz",))] == ["Int32", "Decimal128(10, 2)", "Float64", "Float64", "Utf8", "Utf8", 'Timestamp(Nanosecond, Some("+00:00"))']


def test_assignment_against_every_permutation_and_in_time():
    import itertools
    import random
    import time

    from driftline.operators.rename import best_assignment

    r = random.Random(1)
    for _ in range(300):
        n, m = r.randint(0, 5), r.randint(0, 5)
        gain = [[r.choice((0.0, round(r.random(), 1), -0.5)) for _ in range(m)] for _ in range(n)]
        out = best_assignment(gain)
        used = [j for j in out if j is not None]
        assert len(used) == len(set(used))
        most = max(sum(gain[i][j] for i, j in enumerate(p) if j is not None and gain[i][j] > 0) for p in itertools.permutations([*range(m), *[None] * n], n))
        assert abs(sum(gain[i][j] for i, j in enumerate(out) if j is not None) - most) < 1e-9
    begin = time.process_time()
    best_assignment([[r.random() for _ in range(300)] for _ in range(300)])
    assert time.process_time() - begin < 5
