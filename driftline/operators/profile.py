"""One-pass column statistics and semantic types."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions import semantic
from driftline.functions.types import is_numeric, is_text, type_name
from driftline.operators.rows import INDEX, distinct_names, indexed, scratch

PROFILE = "column string, type string, null_count bigint, row_count bigint, mean double, min double, max double, variance double"


@dataclass(frozen=True)
class ColumnStats:
    null_count: int
    row_count: int
    mean: float | None = None
    min: float | None = None
    max: float | None = None
    variance: float | None = None

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class ColumnProfile:
    data_type: str
    semantic_type: str = semantic.UNKNOWN
    stats: ColumnStats | None = None


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def as_number(name: str) -> Column:
    """A numeric column as double, NaN as null: metrics leave both out. Infinities stay."""
    v = col(name).cast("double")
    return F.when(~F.isnan(v), v)


def profile_frame(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row for each column (PROFILE), from a single aggregation over df. Only numeric columns have a mean, min, max and population
    variance; NaN is no null for null_count. A dataset without rows has no profile."""
    distinct_names(df)
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    rows = []
    for i, f in enumerate(fields):
        numbers = [F.avg, F.min, F.max, F.var_pop] if is_numeric(f) else []
        v = as_number(f.name) if numbers else None
        none = F.lit(None).cast("double")
        own = [agg(v) for agg in numbers] or [none] * 4
        rows.append(F.struct(F.lit(f.name).alias("column"), F.lit(type_name(f)).alias("type"), F.count(F.when(col(f.name).isNull(), 1)).alias("null_count"), F.count(F.lit(1)).alias("row_count"), *[x.alias(n) for x, n in zip(own, ("mean", "min", "max", "variance"), strict=True)]).alias(f"c{i}"))
    if not rows:
        return df.sparkSession.createDataFrame([], PROFILE)
    one = df.agg(F.array(*rows).alias("all"))
    return one.select(F.explode("all").alias("p")).select("p.*").where("row_count > 0")


def column_stats(df: DataFrame) -> dict[str, ColumnStats]:
    return {r["column"]: ColumnStats(r["null_count"], r["row_count"], r["mean"], r["min"], r["max"], r["variance"]) for r in profile_frame(df).collect()}


def value_frequencies(df: DataFrame, column: str) -> DataFrame:
    """value, n for the non-null values of a column."""
    return df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def semantic_votes(rows: DataFrame, columns: list[str], length: int, index: str = INDEX) -> DataFrame:
    """column, kind, n: how many of the spread sample's non-null values are of each kind. Row places count nulls too."""
    sample = rows.where(semantic.spread(F.col(index), length))
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in columns]))
    kinds = sample.select(values.alias("x")).select("x.column", semantic.value_type(F.col("x.value")).alias("kind"))
    return kinds.where("kind is not null").groupBy("column", "kind").agg(F.count(F.lit(1)).alias("n"))


def semantic_types(df: DataFrame, order_by: list[str] | None = None) -> dict[str, str]:
    """Column -> type: by name if that tells, else, for text, by the vote of 100 values spread over all rows."""
    out = {f.name: semantic.from_name(f.name) for f in df.schema.fields}
    asked = [f.name for f in df.schema.fields if is_text(f) and out[f.name] == semantic.UNKNOWN]
    if not asked:
        return out
    length = df.count()
    if not length:
        return out
    with scratch():
        if length <= semantic.SAMPLE:  # every row is in the sample, whatever the order
            votes = semantic_votes(df.select(*map(col, asked)).withColumn(INDEX, F.lit(0)), asked, 1)
        else:
            keys = [c for c in order_by or [] if c not in asked]
            rows = indexed(df.select(*map(col, asked + keys)) if order_by else df.select(*map(col, asked)), order_by)
            votes = semantic_votes(rows, asked, length)
        votes = votes.collect()
    counts: dict[str, dict[str, int]] = {}
    for r in votes:  # a few rows a column
        counts.setdefault(r["column"], {})[r["kind"]] = r["n"]
    return out | {c: semantic.winner(c, counts.get(c, {}), sum(counts.get(c, {}).values())) for c in asked}


def profiles(df: DataFrame, order_by: list[str] | None = None) -> dict[str, ColumnProfile]:
    """Type, semantic type and statistics of every column; none for a dataset without rows."""
    stats = column_stats(df)
    kinds = semantic_types(df, order_by) if stats else {}
    return {f.name: ColumnProfile(type_name(f), kinds[f.name], stats[f.name]) for f in df.schema.fields} if stats else {}


def profiles_from(schema: T.StructType, kinds: dict[str, str], stats: dict[str, ColumnStats]) -> dict[str, ColumnProfile]:
    """Profiles from what a snapshot has kept."""
    return {f.name: ColumnProfile(type_name(f), kinds.get(f.name, semantic.UNKNOWN), stats.get(f.name)) for f in schema.fields}
