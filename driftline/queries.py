"""The engine's queries over the test tables, each with the SQL that gives the same rows.

Metrics are rounded to six decimals on both sides, as sums of doubles depend on their order in the last places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions import semantic
from driftline.operators import drift, merge, merkle, profile, rename
from driftline.operators.rows import INDEX, indexed
from driftline.plans import config, governance, state
from driftline.sources import readers

SPLIT_TS, SPLIT_SHIP = "2024-01-15", "1998-06-01"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _r(c) for c in columns})


def _events(spark, d):
    e = _t(spark, d, "events")
    return e.where(F.col("ts") < F.lit(SPLIT_TS).cast("timestamp_ntz")), e.where(F.col("ts") >= F.lit(SPLIT_TS).cast("timestamp_ntz"))


def _flags(spark, d):
    li = _t(spark, d, "lineitem")
    return li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'")


QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --- profiles


def _profile_sql(table: str, numeric: list[tuple[str, str]], other: list[tuple[str, str]]) -> str:
    parts = [f"select '{c}' as \"column\", '{t}' as type, count(*) filter ({c} is null) as null_count, count(*) as row_count, round(avg(cast({c} as double)), 6) as mean, cast(min({c}) as double) as min, cast(max({c}) as double) as max, round(var_pop(cast({c} as double)), 6) as variance from {table}" for c, t in numeric]
    parts += [f"select '{c}', '{t}', count(*) filter ({c} is null), count(*), cast(null as double), cast(null as double), cast(null as double), cast(null as double) from {table}" for c, t in other]
    return " union all ".join(parts)


@_query(_profile_sql("lineitem", [("l_orderkey", "Int64"), ("l_partkey", "Int64"), ("l_suppkey", "Int64"), ("l_linenumber", "Int32"), ("l_quantity", "Float64"), ("l_extendedprice", "Float64"), ("l_discount", "Float64"), ("l_tax", "Float64")], [("l_returnflag", "Utf8"), ("l_linestatus", "Utf8"), ("l_shipdate", "Timestamp(Microsecond, None)")]).replace("round(avg", "round(avg"))
def column_profile_lineitem(spark, d):
    """Null and row counts, mean, min, max and population variance of every column in one pass."""
    return _rounded(profile.profile_frame(_t(spark, d, "lineitem")), "mean", "variance")


@_query("select 'event_id' as \"column\", count(*) filter (event_id is null) as null_count, count(*) as row_count from events union all select 'ts', count(*) filter (ts is null), count(*) from events union all select 'user_id', count(*) filter (user_id is null), count(*) from events union all select 'event_type', count(*) filter (event_type is null), count(*) from events union all select 'value', count(*) filter (value is null), count(*) from events union all select 'props', count(*) filter (props is null), count(*) from events")
def column_profile_events_nulls(spark, d):
    return profile.profile_frame(_t(spark, d, "events")).select("column", "null_count", "row_count")


@_query("select o_orderpriority as value, count(*) as n from orders where o_orderpriority is not null group by 1")
def value_frequencies_priority(spark, d):
    return profile.value_frequencies(_t(spark, d, "orders"), "o_orderpriority")


# --- schema drift


@_query("select * from (values ('c_acctbal', 'added', cast(null as varchar), 'Float64'), ('c_custkey', 'added', null, 'Int64'), ('c_mktsegment', 'added', null, 'Utf8'), ('c_name', 'added', null, 'Utf8'), ('c_nationkey', 'added', null, 'Int32'), ('o_custkey', 'removed', 'Int64', null), ('o_orderdate', 'removed', 'Timestamp(Microsecond, None)', null), ('o_orderkey', 'removed', 'Int64', null), ('o_orderpriority', 'removed', 'Utf8', null), ('o_orderstatus', 'removed', 'Utf8', null), ('o_totalprice', 'removed', 'Float64', null)) t(field_name, change, old_type, new_type)")
def schema_drift_orders_vs_customer(spark, d):
    return drift.schema_drift_frame(spark, _t(spark, d, "orders").schema, _t(spark, d, "customer").schema)


@_query("select 's_acctbal' as field_name, 'type' as change, 'Float64' as old_type, 'Float32' as new_type union all select 's_name', 'removed', 'Utf8', null union all select 's_region', 'added', null, 'Utf8'")
def schema_drift_changed_supplier(spark, d):
    old = _t(spark, d, "supplier")
    new = old.select("s_suppkey", "s_nationkey", F.col("s_acctbal").cast("float").alias("s_acctbal"), F.lit("x").alias("s_region"))
    return drift.schema_drift_frame(spark, old.schema, new.schema)


# --- drift


@_query(f"""
with a as (select * from events where ts < timestamp '{SPLIT_TS}'), b as (select * from events where ts >= timestamp '{SPLIT_TS}')
select 'event_id' as "column", round(abs((select avg(event_id) from b) - (select avg(event_id) from a)), 6) as mean_drift, (select count(*) filter (event_id is null) from b) - (select count(*) filter (event_id is null) from a) as null_count_drift
union all select 'user_id', round(abs((select avg(user_id) from b) - (select avg(user_id) from a)), 6), (select count(*) filter (user_id is null) from b) - (select count(*) filter (user_id is null) from a)
union all select 'value', round(abs((select avg(value) from b) - (select avg(value) from a)), 6), (select count(*) filter (value is null) from b) - (select count(*) filter (value is null) from a)
union all select 'ts', null, (select count(*) filter (ts is null) from b) - (select count(*) filter (ts is null) from a)
union all select 'event_type', null, (select count(*) filter (event_type is null) from b) - (select count(*) filter (event_type is null) from a)
union all select 'props', null, (select count(*) filter (props is null) from b) - (select count(*) filter (props is null) from a)
""")
def data_drift_stats_events(spark, d):
    return _rounded(drift.stats_drift(*_events(spark, d)), "mean_drift")


_KS = """
with x as (select l_quantity as v, case when l_returnflag = 'A' then 1 else 0 end as s from lineitem where l_returnflag in ('A', 'R') and l_quantity is not null and not isnan(l_quantity)),
g as (select v, sum(s) as s, sum(1 - s) as t from x group by v),
c as (select v, sum(s) over (order by v) as cs, sum(t) over (order by v) as ct, sum(s) over () as ns, sum(t) over () as nt from g),
k as (select max(abs(cs * 1.0e0 / ns - ct * 1.0e0 / nt)) as d, cast(any_value(ns) as double) as n1, cast(any_value(nt) as double) as n2 from c),
l as (select d, n1, n2, (sqrt(n1 * n2 / (n1 + n2)) + 0.12e0 + 0.11e0 / sqrt(n1 * n2 / (n1 + n2))) * d as x from k)
"""


@_query(_KS + "select 'l_quantity' as \"column\", round(d, 6) as ks_statistic from l")
def ks_quantity_by_flag(spark, d):
    return _rounded(drift.numeric_drift(*_flags(spark, d), ["l_quantity"]).select("column", "ks_statistic"), "ks_statistic")


@_query(_KS + "select 'l_quantity' as \"column\", round(case when x <= 0 then 1.0e0 else greatest(0.0e0, least(1.0e0, 2.0e0 * list_sum(list_transform(range(1, 101), lambda k: (case when k % 2 = 1 then 1.0e0 else -1.0e0 end) * exp(-2.0e0 * (k * x) * (k * x)))))) end, 6) as ks_p_value from l")
def ks_pvalue_by_flag(spark, d):
    return _rounded(drift.numeric_drift(*_flags(spark, d), ["l_quantity"]).select("column", "ks_p_value"), "ks_p_value")


def _psi_sql(table: str, columns: dict[str, str], source: str, target: str) -> str:
    values = " union all ".join(f"select '{c}' as \"column\", cast({e} as double) as v, case when {source} then 1 else 0 end as s from {table} where ({source} or {target}) and {e} is not null and not isnan(cast({e} as double))" for c, e in columns.items())
    return f"""
with x as ({values}),
r as (select "column", v, row_number() over (partition by "column" order by v) - 1 as i, count(*) over (partition by "column") as n from x where s = 1),
q as (select distinct "column", n, k, (n - 1) * (k / 10.0e0) as h from r, range(1, 10) t(k)),
e as (select q."column", q.k, lo.v + (q.h - floor(q.h)) * (hi.v - lo.v) as edge from q join r lo on lo."column" = q."column" and lo.i = cast(floor(q.h) as bigint) join r hi on hi."column" = q."column" and hi.i = cast(ceil(q.h) as bigint)),
a as (select "column", list(edge order by k) as edges from e group by 1),
b as (select x."column", len(list_filter(edges, lambda y: y <= v)) as bin, sum(s) as s, sum(1 - s) as t from x join a on a."column" = x."column" group by all),
n as (select "column", sum(s) * 1.0e0 as ns, sum(t) * 1.0e0 as nt from b group by 1)
select b."column", round(sum((greatest(t / nt, 1e-4) - greatest(s / ns, 1e-4)) * ln(greatest(t / nt, 1e-4) / greatest(s / ns, 1e-4))), 6) as psi_statistic
from b join n on n."column" = b."column" group by 1
"""


@_query(_psi_sql("events", {"value": "value"}, f"ts < timestamp '{SPLIT_TS}'", f"ts >= timestamp '{SPLIT_TS}'"))
def psi_events_value(spark, d):
    return _rounded(drift.numeric_drift(*_events(spark, d), ["value"]).select("column", "psi_statistic"), "psi_statistic")


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@_query(_psi_sql("lineitem", {c: c for c in _LINE}, f"l_shipdate < timestamp '{SPLIT_SHIP}'", f"l_shipdate >= timestamp '{SPLIT_SHIP}'"))
def psi_all_numeric_lineitem(spark, d):
    li, at = _t(spark, d, "lineitem"), F.lit(SPLIT_SHIP).cast("timestamp_ntz")
    return _rounded(drift.numeric_drift(li.where(F.col("l_shipdate") < at), li.where(F.col("l_shipdate") >= at), _LINE).select("column", "psi_statistic"), "psi_statistic")


def _shifted(spark, d):
    """Orders against orders that cost more and have other priorities: a drift to be found."""
    o = _t(spark, d, "orders")
    return o, o.withColumn("o_totalprice", F.col("o_totalprice") * 2 + 1000).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, "1-URGENT").otherwise(F.col("o_orderpriority")))


_CAT = """
c as (select v, sum(s) as s, sum(t) as t from x where v is not null group by v), n as (select sum(s) * 1.0e0 as ns, sum(t) * 1.0e0 as nt from c),
p as (select round(sum((greatest(t / nt, 1e-4) - greatest(s / ns, 1e-4)) * ln(greatest(t / nt, 1e-4) / greatest(s / ns, 1e-4))), 6) as z from c, n)
"""


@_query(f"with x as (select event_type as v, case when ts < timestamp '{SPLIT_TS}' then 1 else 0 end as s, case when ts >= timestamp '{SPLIT_TS}' then 1 else 0 end as t from events)," + _CAT + "select 'event_type' as \"column\", z as categorical_drift from p")
def categorical_psi_event_type(spark, d):
    return _rounded(drift.categorical_drift(*_events(spark, d), ["event_type"]), "categorical_drift")


@_query("with x as (select o_orderpriority as v, 1 as s, 0 as t from orders union all select case when o_orderkey % 3 = 0 then '1-URGENT' else o_orderpriority end, 0, 1 from orders)," + _CAT + "select 'o_orderpriority' as \"column\", z as categorical_drift from p")
def categorical_psi_shifted_priority(spark, d):
    return _rounded(drift.categorical_drift(*_shifted(spark, d), ["o_orderpriority"]), "categorical_drift")


@_query("select * from (values ('o_orderpriority'), ('o_totalprice')) t(\"column\")")
def drift_breaches(spark, d):
    """The columns of shifted orders over a threshold of 0.05: price by its bins, priority by its frequencies."""
    return drift.breaches(drift.drift_frame(*_shifted(spark, d)), 0.05).select("column")


_SIDES = "(select *, 1 as side from orders union all select o_orderkey, o_custkey, o_orderstatus, o_totalprice * 2 + 1000, o_orderdate, case when o_orderkey % 3 = 0 then '1-URGENT' else o_orderpriority end, 0 from orders) z"
_ORDER_NUMBERS, _ORDER_TEXTS = ("o_orderkey", "o_custkey", "o_totalprice"), ("o_orderstatus", "o_orderpriority")
_FULL = f"""
with z as (select * from {_SIDES}),
x as ({" union all ".join(f"select '{c}' as col, cast({c} as double) as v, side from z where {c} is not null" for c in _ORDER_NUMBERS)}),
g as (select col, v, sum(side) as s, sum(1 - side) as t from x group by all),
c as (select col, sum(s) over (partition by col order by v) as cs, sum(t) over (partition by col order by v) as ct, sum(s) over (partition by col) * 1.0e0 as ns, sum(t) over (partition by col) * 1.0e0 as nt from g),
k as (select col, max(abs(cs / ns - ct / nt)) as d, any_value(ns) as ns, any_value(nt) as nt from c group by col),
l as (select col, d, (sqrt(ns * nt / (ns + nt)) + 0.12e0 + 0.11e0 / sqrt(ns * nt / (ns + nt))) * d as y from k),
p as ({_psi_sql(_SIDES, {c: c for c in _ORDER_NUMBERS}, "side = 1", "side = 0")}),
w as ({" union all ".join(f"select '{c}' as col, {c} as v, side from z where {c} is not null" for c in _ORDER_TEXTS)}),
f as (select col, v, sum(side) * 1.0e0 as s, sum(1 - side) * 1.0e0 as t from w group by all),
h as (select col, v, s / sum(s) over (partition by col) as s, t / sum(t) over (partition by col) as t from f),
q as (select col, round(sum((greatest(t, 1e-4) - greatest(s, 1e-4)) * ln(greatest(t, 1e-4) / greatest(s, 1e-4))), 6) as categorical_drift from h group by col),
m as ({" union all ".join(f"select '{c}' as col, round(abs(avg({c}) filter (side = 0) - avg({c}) filter (side = 1)), 6) as mean_drift, count(*) filter (side = 0 and {c} is null) - count(*) filter (side = 1 and {c} is null) as null_count_drift from z" for c in _ORDER_NUMBERS)}
  union all {" union all ".join(f"select '{c}', null, count(*) filter (side = 0 and {c} is null) - count(*) filter (side = 1 and {c} is null) from z" for c in (*_ORDER_TEXTS, "o_orderdate"))})
select m.col as "column", mean_drift, null_count_drift, round(d, 6) as ks_statistic,
  round(case when y is null then null when y <= 0 then 1.0e0 else greatest(0.0e0, least(1.0e0, 2.0e0 * list_sum(list_transform(range(1, 101), lambda i: (case when i % 2 = 1 then 1.0e0 else -1.0e0 end) * exp(-2.0e0 * (i * y) * (i * y)))))) end, 6) as ks_p_value, psi_statistic, categorical_drift
from m left join l on l.col = m.col left join p on p."column" = m.col left join q on q.col = m.col
"""


@_query(_FULL)
def full_diff_orders(spark, d):
    """Every metric of every column of orders against shifted orders."""
    return _rounded(drift.drift_frame(*_shifted(spark, d)), "mean_drift", "ks_statistic", "ks_p_value", "psi_statistic", "categorical_drift")


@_query(_psi_sql("(select o_orderkey, o_totalprice * case when side = 1 then 1 else 1.5e0 end as price, side from (select *, row_number() over (order by o_orderkey) as i from orders), (values (1), (0)) s(side) where i <= 200) z", {"o_totalprice": "price"}, "side = 1", "side = 0"))
def psi_of_first_samples(spark, d):
    """The PSI of the first 200 prices, as a snapshot keeps them, against half as much again."""
    own = state.first_samples(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), 200, ["o_orderkey"])["o_totalprice"]
    return _rounded(spark.createDataFrame([("o_totalprice", drift.psi_of_samples(own, [v * 1.5 for v in own]))], "column string, psi_statistic double"), "psi_statistic")


# --- meaning


_RE2 = {k: p.replace("'", "''") for k, p in semantic.PATTERNS.items()}
_LUHN = "(list_sum(list_transform(range(1, len({v}) + 1), lambda i: case when i % 2 = 1 then cast(substr({v}, len({v}) - i + 1, 1) as bigint) else (cast(substr({v}, len({v}) - i + 1, 1) as bigint) * 2) // 10 + (cast(substr({v}, len({v}) - i + 1, 1) as bigint) * 2) % 10 end)) % 10 = 0)"


@_query(f"""
with r as (select url, row_number() over (order by page_id) - 1 as i, count(*) over () as n from pages),
s as (select url from r where list_contains(list_transform(range(0, least(100, n)), lambda k: k * n // least(100, n)), i))
select 'url' as "column", case when regexp_full_match(url, '{_RE2["Url"]}') then 'Url' else 'Unknown' end as kind, count(*) as n from s where url is not null group by all
""")
def semantic_vote_pages_url(spark, d):
    """The vote of 100 urls spread over pages in the order of page_id."""
    pages = _t(spark, d, "pages").select("page_id", "url")
    return profile.semantic_votes(indexed(pages, ["page_id"]), ["url"], pages.count())


@_query(f"""
with w as (select unnest(regexp_split_to_array(text, '[ \\t\\n]+')) as v from documents)
select case when regexp_full_match(v, '{_RE2["Email"]}') then 'Email' when regexp_full_match(v, '{_RE2["CreditCard"]}') and {_LUHN.format(v="v")} then 'CreditCard'
  when regexp_full_match(v, '[0-9+ ()-]*') and regexp_full_match(regexp_replace(v, '[ ()-]', '', 'g'), '{_RE2["PhoneNumber"]}') then 'PhoneNumber'
  when regexp_full_match(v, '{_RE2["UUID"]}') then 'UUID' when regexp_full_match(v, '{_RE2["IPAddress"]}') then 'IPAddress' when regexp_full_match(v, '{_RE2["Url"]}') then 'Url' else 'Unknown' end as kind, count(*) as n
from w where v is not null group by 1
""")
def semantic_values_extract(spark, d):
    """What the words of all documents are."""
    words = _t(spark, d, "documents").select(F.explode(F.split("text", r"[ \t\n]+")).alias("v"))
    return words.select(semantic.value_type(F.col("v")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_CARDS = ("4111111111111111", "4012888888881881", "4222222222222", "4123456789012345", "5555555555554444", "378282246310005", "79927398713", "79927398710", "0")


@_query("with t as (select unnest([" + ", ".join(f"'{c}'" for c in _CARDS) + "]) as v) select v as value, " + _LUHN.format(v="v") + " as valid from t")
def luhn_check_values(spark, d):
    return spark.range(1).select(F.explode(F.array(*map(F.lit, _CARDS))).alias("value")).select("value", F.call_function("luhn_check", F.col("value")).alias("valid"))


_MARKED = "select c_custkey, md5(cast(c_custkey as {t})) as h from customer"
_SHAPES = ("concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))", "concat_ws(':', substr(h, 1, 4), substr(h, 5, 4), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 4), substr(h, 25, 4), substr(h, 29, 4))", "concat(substr(h, 1, 4), '::', substr(h, 5, 3))", "concat('fe80::', substr(h, 1, 4), ':192.0.2.', c_custkey % 300)", "concat_ws(':', substr(h, 1, 4), '', substr(h, 5, 4), '', substr(h, 9, 4))")
_SHAPED = "case c_custkey % 5 " + " ".join(f"when {k} then {e}" for k, e in enumerate(_SHAPES)) + " end"


@_query(f"""
with m as ({_MARKED.format(t="varchar")}), w as (select {_SHAPED} as v from m)
select case when regexp_full_match(v, '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}') then 'UUID'
  when regexp_full_match(v, '([0-9a-f]{{1,4}}:){{7}}[0-9a-f]{{1,4}}') or regexp_full_match(v, '[0-9a-f]{{1,4}}::[0-9a-f]{{1,4}}') then 'IPAddress'
  when regexp_full_match(v, 'fe80::[0-9a-f]{{4}}:192[.]0[.]2[.][0-9]+') and cast(split_part(v, '.', 4) as integer) < 256 then 'IPAddress' else 'Unknown' end as kind, count(*) as n from w group by 1
""")
def semantic_uuid_and_ip_values(spark, d):
    """UUIDs and IPv6 addresses made of the customers' keys, some with an IPv4 tail, some malformed."""
    _t(spark, d, "customer").createOrReplaceTempView("customer")
    values = spark.sql(f"with m as ({_MARKED.format(t='string')}) select {_SHAPED} as v from m")
    return values.select(semantic.value_type(F.col("v")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _winner_sql(value: str, kind: str) -> str:
    """What the vote of 100 values spread over pages gives: `kind` or Unknown."""
    test = _RE2[kind]
    return f"(with r as (select {value} as v, row_number() over (order by page_id) - 1 as i, count(*) over () as n from pages), s as (select v from r where list_contains(list_transform(range(0, least(100, n)), lambda k: k * n // least(100, n)), i)) select case when count(*) filter (regexp_full_match(v, '{test}')) >= 0.8 * count(v) then '{kind}' else 'Unknown' end from s)"


_MAIL = "concat('user', page_id, '@example.org')"


@_query(f"select 'link' as \"column\", {_winner_sql('url', 'Url')} as kind union all select 'reply', {_winner_sql(_MAIL, 'Email')} union all select 'some', {_winner_sql(f'case when page_id % 2 = 0 then {_MAIL} end', 'Email')} union all select 'page_id', 'Unknown'")
def semantic_types_pages(spark, d):
    """The type of each column by the vote of its values, as the names tell nothing."""
    rows = _t(spark, d, "pages").select("page_id", F.col("url").alias("link"), F.expr(_MAIL).alias("reply"), F.expr(f"case when page_id % 2 = 0 then {_MAIL} end").alias("some"))
    return spark.createDataFrame(sorted(profile.semantic_types(rows, ["page_id"]).items()), "column string, kind string")


@_query(f"select field_name, source_type, target_type from (select 'link' as field_name, {_winner_sql('url', 'Url')} as source_type, {_winner_sql(_MAIL, 'Email')} as target_type) where source_type <> target_type")
def semantic_drift_pages(spark, d):
    """A column of links that becomes one of addresses."""
    old = _t(spark, d, "pages").select("page_id", F.col("url").alias("link"))
    new = _t(spark, d, "pages").select("page_id", F.expr(_MAIL).alias("link"))
    found = drift.semantic_drift(*(profile.semantic_types(x, ["page_id"]) for x in (old, new)))
    return spark.createDataFrame([(x.field_name, x.source_type, x.target_type) for x in found], "field_name string, source_type string, target_type string")


# --- renames and merges


@_query("""
with a as (select unnest(['o_orderkey', 'o_custkey', 'o_order_status', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) as a), b as (select unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acct_bal', 'c_mktsegment', 'order_status']) as b),
p as (select a, b, replace(a, '_', '') as x, replace(b, '_', '') as y, list_filter(string_split(a, '_'), lambda w: w <> '') as s, list_filter(string_split(b, '_'), lambda w: w <> '') as t from a, b)
select a, b, round(case when x = y then 1.0e0 else greatest(len(list_intersect(s, t)) * 1.0e0 / len(list_distinct(list_concat(s, t))), 1.0e0 - levenshtein(x, y) * 1.0e0 / greatest(len(x), len(y))) end, 6) as similarity from p
""")
def name_similarity_pairs(spark, d):
    old, new = ["o_orderkey", "o_custkey", "o_order_status", "o_totalprice", "o_orderdate", "o_orderpriority"], ["c_custkey", "c_name", "c_nationkey", "c_acct_bal", "c_mktsegment", "order_status"]
    return _rounded(spark.createDataFrame([(a, b, rename.name_similarity(a, b)) for a in old for b in new], "a string, b string, similarity double"), "similarity")


@_query("select 'c_custkey' as source, 'customer_key' as target union all select 'c_acctbal', 'balance'")
def rename_report(spark, d):
    """Customer against itself with two columns renamed: found by their statistics."""
    old = _t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    new = old.select(F.col("c_custkey").alias("customer_key"), F.col("c_acctbal").alias("balance"), "c_nationkey")
    changes = rename.fold_renames(drift.schema_drift(old.schema, new.schema), profile.profiles(old), profile.profiles(new))
    return spark.createDataFrame([(r["from"], r["to"]) for r in changes.renamed_fields], "source string, target string")


@_query("select * from (values ('age', 'Int32', true, cast(null as varchar)), ('amount', 'Int64', true, 'ModifyModify'), ('email', 'Utf8', true, null), ('id', 'Int32', true, null)) t(name, type, nullable, conflict)")
def merge_schemas(spark, d):
    base, ours, theirs = (T.StructType.fromDDL(s) for s in ("id int, amount int", "id int, amount bigint, email string", "id int, amount double, age int"))
    result = merge.three_way_merge(base, ours, theirs)
    kinds = {c.field_name: c.kind for c in result.conflicts}
    return spark.createDataFrame([(f["name"], f["data_type"], f["nullable"], kinds.get(f["name"])) for f in state.schema_to(result.merged)], "name string, type string, nullable boolean, conflict string")


_TYPE_SQL = "case column_type when 'BIGINT' then 'Int64' when 'INTEGER' then 'Int32' when 'DOUBLE' then 'Float64' when 'FLOAT' then 'Float32' when 'VARCHAR' then 'Utf8' when 'TIMESTAMP' then 'Timestamp(Microsecond, None)' end"
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@_query(" union all ".join(f"select '{t}' as \"table\", column_name as name, {_TYPE_SQL} as type from (describe {t})" for t in _TABLES))
def schemas_kept_and_restored(spark, d):
    """Every table's schema as a snapshot keeps it, read back."""
    return spark.createDataFrame([(t, f["name"], f["data_type"]) for t in _TABLES for f in state.schema_to(state.schema_from(state.schema_to(_t(spark, d, t).schema)))], "table string, name string, type string")


_CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@_query(" union all ".join(f"select '{c}' as \"column\", (select {_TYPE_SQL} from (describe customer) where column_name = '{c}') as type, count(*) as row_count, count(*) - count({c}) as null_count, " + (f"round(avg({c}), 6) as mean, least(100, count({c}))" if c not in ("c_name", "c_mktsegment") else "cast(null as double) as mean, 0") + " as samples from customer" for c in _CUSTOMER))
def snapshot_customer(spark, d):
    """What a snapshot of customer keeps: types, statistics and the number of samples."""
    kept = state.capture(readers.FileSource(spark, d), "customer.parquet", 100)
    rows = [(f["name"], f["data_type"], kept.column_stats[f["name"]].row_count, kept.column_stats[f["name"]].null_count, kept.column_stats[f["name"]].mean, len((kept.samples or {}).get(f["name"], []))) for f in kept.schema]
    return _rounded(spark.createDataFrame(rows, "column string, type string, row_count bigint, null_count bigint, mean double, samples bigint"), "mean")


@_query("select lower(r_name) as name, case when r_regionkey % 2 = 0 then concat('http://', r_regionkey) end as endpoint, case when r_regionkey % 2 = 0 then 2 else 0 end as operators, count(n_nationkey) as targets, r_regionkey % 2 = 0 as declared from region left join nation on n_regionkey = r_regionkey group by r_name, r_regionkey having r_regionkey % 2 = 0 or count(n_nationkey) > 0")
def domains_of_nations(spark, d):
    """Every nation a target of its region's domain; each second domain is declared."""
    regions = {r.r_regionkey: r.r_name for r in _t(spark, d, "region").collect()}
    targets = {r.n_name: config.Target("files", r.n_name, domain=regions[r.n_regionkey]) for r in _t(spark, d, "nation").collect()}
    declared = {n.lower(): config.Domain(("a", "b"), f"http://{k}") for k, n in regions.items() if k % 2 == 0}
    found = governance.list_domains(config.Config("nations", "1", 0.2, targets=targets, domains=declared))
    return spark.createDataFrame([(x.name.lower(), x.endpoint, x.operator_count, x.target_count, x.has_domain_entry) for x in found], "name string, endpoint string, operators int, targets bigint, declared boolean")


# --- commitments


def _framed_sql(e: str) -> str:
    n = f"printf('%08X', octet_length(encode({e})))"
    return f"unhex(substr({n}, 7, 2) || substr({n}, 5, 2) || substr({n}, 3, 2) || substr({n}, 1, 2)) || encode({e})"


def _leaf_sql(*columns: str) -> str:
    return "sha256(unhex('00') || " + " || ".join(_framed_sql(f"coalesce(cast({c} as varchar), '')") for c in columns) + ")"


_NATION = ("n_nationkey", "n_name", "n_regionkey")


@_query(f"select row_number() over (order by n_nationkey) - 1 as idx, {_leaf_sql(*_NATION)} as hash from nation")
def merkle_leaves_nation(spark, d):
    return merkle.leaves(_t(spark, d, "nation"), ["n_nationkey"])


def _root_sql(leaves: str) -> str:
    """Levels by a recursive query: each has its nodes as one list."""
    node = "case when 2 * j + 2 <= len(h) then sha256(unhex('01') || unhex(h[2 * j + 1]) || unhex(h[2 * j + 2])) else h[2 * j + 1] end"
    return f"with recursive leaf as ({leaves}), t(h) as (select list(hash order by idx) from leaf union all select list_transform(range(0, (len(h) + 1) // 2), lambda j: {node}) from t where len(h) > 1) select h[1] as root, (select count(*) from leaf) as n from t where len(h) = 1"


def _root(spark, tree: merkle.MerkleTree) -> DataFrame:
    return spark.createDataFrame([(tree.root_hex, tree.leaf_count)], "root string, n bigint")


@_query(_root_sql(f"select row_number() over (order by r_regionkey) - 1 as idx, {_leaf_sql('r_regionkey', 'r_name')} as hash from region"))
def merkle_root_region(spark, d):
    return _root(spark, merkle.MerkleTree.of(_t(spark, d, "region"), ["r_regionkey"]))


@_query(_root_sql(f"select row_number() over (order by c_custkey) - 1 as idx, {_leaf_sql('c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment')} as hash from customer"))
def merkle_root_customer(spark, d):
    return _root(spark, merkle.MerkleTree.of(_t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), ["c_custkey"]))


_STAMP = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"


@_query(_root_sql(f"select row_number() over (order by o_orderkey) - 1 as idx, {_leaf_sql('o_orderkey', 'o_custkey', 'nullif(o_orderstatus, $$O$$)', 'o_totalprice', _STAMP, 'o_orderpriority', 'cast(o_orderdate as date)')} as hash from orders"))
def merkle_root_orders(spark, d):
    """The root over all orders: doubles, timestamps, dates and nulls."""
    orders = _t(spark, d, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("O"))).withColumn("day", F.to_date("o_orderdate"))
    return _root(spark, merkle.MerkleTree.of(orders, ["o_orderkey"]))


@_query(_root_sql(f"select row_number() over (order by c_custkey) - 1 as idx, {_leaf_sql(*_CUSTOMER)} as hash from customer"))
def merkle_root_whole_customer(spark, d):
    return _root(spark, merkle.MerkleTree.of(_t(spark, d, "customer"), ["c_custkey"]))


@_query()
def merkle_root_lineitem(spark, d):
    """The root over all rows of lineitem in file order."""
    return _root(spark, merkle.MerkleTree.of(_t(spark, d, "lineitem")))


@_query("select idx from (select row_number() over (order by n_nationkey) - 1 as idx, n_nationkey from nation) where n_nationkey % 7 = 3")
def reconcile_divergent_rows(spark, d):
    nation = _t(spark, d, "nation")
    other = nation.withColumn("n_name", F.when(F.col("n_nationkey") % 7 == 3, F.concat("n_name", F.lit("*"))).otherwise(F.col("n_name")))
    return merkle.divergent_rows(merkle.MerkleTree.of(nation, ["n_nationkey"]), merkle.MerkleTree.of(other, ["n_nationkey"]))


@_query("select row_number() over (order by o_orderkey) - 1 as idx, o_orderkey from orders")
def row_index_every_order(spark, d):
    return indexed(_t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"]).select(F.col(INDEX).alias("idx"), "o_orderkey")


@_query("select cast(row_number() over (order by n_nationkey) - 1 as integer) as leaf_index, cast(row_number() over (order by n_nationkey) - 1 as integer) as idx, true as verified from nation")
def merkle_proofs_every_nation(spark, d):
    tree = merkle.MerkleTree.of(_t(spark, d, "nation"), ["n_nationkey"])
    every = list(range(tree.leaf_count))
    found = [(p.leaf_index, i, merkle.verify_proof(tree.root, leaf, p)) for i, (leaf, p) in zip(every, tree.proofs(every), strict=True)]
    return spark.createDataFrame(found, "leaf_index int, idx int, verified boolean")


@_query("select 'o_custkey' as \"column\", i, v from (select row_number() over (order by o_orderkey) - 1 as i, cast(o_custkey as double) as v from orders where o_custkey is not null) where i < 50 union all select 'o_orderkey', i, v from (select row_number() over (order by o_orderkey) - 1 as i, cast(o_orderkey as double) as v from orders where o_orderkey is not null) where i < 50 union all select 'o_totalprice', i, v from (select row_number() over (order by o_orderkey) - 1 as i, o_totalprice as v from orders where o_totalprice is not null and not isnan(o_totalprice)) where i < 50")
def sample_first_n(spark, d):
    samples = state.first_samples(_t(spark, d, "orders"), 50, ["o_orderkey"])
    return spark.createDataFrame([(c, i, v) for c, own in samples.items() for i, v in enumerate(own)], "column string, i bigint, v double")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
