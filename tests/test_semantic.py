import ipaddress

import pytest
from pyspark.sql import functions as F

from driftline.functions import semantic as s
from driftline.operators.profile import semantic_types
from driftline.plans.service import infer_semantic

CARDS = ["4111111111111111", "4012888888881881", "4222222222222", "5555555555554444"]


def both(spark, name, values):
    """The answer over a DataFrame, in its order, and over a list: they must agree."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, `{name}` string")
    out = semantic_types(df, ["i"])[name]
    assert out == infer_semantic(name, values)
    return out


@pytest.mark.parametrize("name,kind", [("user_email", "Email"), ("credit_card_number", "CreditCard"), ("phone_num", "PhoneNumber"), ("session_uuid", "UUID"), ("client_ip", "IPAddress"), ("website_url", "Url"), ("script", "Unknown"), ("zip_code", "Unknown"), ("tip_amount", "Unknown"), ("recipient", "Unknown"), ("shipment", "Unknown"), ("IP-Address", "IPAddress")])
def test_names(name, kind):
    assert s.from_name(name) == kind


@pytest.mark.parametrize("name,values,kind", [
    ("unknown_col", ["a@x.com", "b@y.org", "c.d+e@sub.example.co", None], "Email"),
    ("unknown_col", CARDS, "CreditCard"),
    ("order_id", [f"41234567890123{k}" for k in range(45, 49)], "Unknown"),
    ("mobile", ["+14155552671", "+442071838750"], "PhoneNumber"),
    ("unknown_col", ["+14155552671", "+442071838750"], "Unknown"),
    ("mobile", ["+1 (415) 555-2671", "415-555-2673"], "PhoneNumber"),
    ("mobile", ["415.555.2673"], "Unknown"),
    ("source_addr", ["2001:db8::1", "::1", "fe80::1", "::ffff:192.0.2.1"], "IPAddress"),
    ("unknown_col", ["10.0.0.1", "192.168.1.254"], "IPAddress"),
    ("unknown_col", ["123e4567-e89b-12d3-a456-426614174000"], "UUID"),
    ("unknown_col", ["http://example.com", "https://a.b.org:8080/x?y=z"], "Url"),
    ("col", ["user@example.c-", "user@example.c.", "user@-example.com"], "Unknown"),
    ("col", ["http://@@", "https://"], "Unknown"),
    ("col", ["a@x.com\n"], "Unknown"),
    ("col", [f"u{k}@x.com" for k in range(8)] + ["x", "y"], "Email"),
    ("col", [f"u{k}@x.com" for k in range(6)] + ["x", "y", "z", "w"], "Unknown"),
    ("col", ["junk"] * 100 + [f"u{k}@x.com" for k in range(900)], "Email"),
    ("col", [None, None], "Unknown"),
    ("col", [], "Unknown"),
])
def test_values(spark, name, values, kind):
    assert both(spark, name, values) == kind


def test_ipv6(spark):
    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "1:::2", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "12345::", "g::", "fe80::1%eth0", "::ffff:1.2.3.4", "1.2.3.4", "::1.2.3.256", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::01.2.3.4", "", " ::1", "ABCD::ef01"]

    def valid(t):
        try:
            return "%" not in t and bool(ipaddress.IPv6Address(t))
        except ValueError:
            return False

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", s.is_ipv6(F.col("t")).alias("v"))
    assert {r.t: r.v for r in df.collect()} == {t: valid(t) for t in texts}


def test_spread(spark):
    for n in (1, 3, 99, 100, 101, 250, 1000, 1023):
        got = [r[0] for r in spark.range(n).where(s.spread(F.col("id"), n)).orderBy("id").collect()]
        assert got == [k * n // min(100, n) for k in range(min(100, n))]
