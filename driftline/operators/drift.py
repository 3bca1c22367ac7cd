"""Drift between two datasets: schema, statistics, Kolmogorov-Smirnov, numeric and categorical PSI.

Numeric columns of both sides go into one long frame that is counted by (column, value); running sums of those counts
give the KS statistic, the order statistics for PSI's decile edges and its bins. So all columns take one pass over each
side and one shuffle of pre-aggregated counts.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions import semantic
from driftline.functions.types import is_numeric, is_text, type_name
from driftline.operators.profile import ColumnStats, as_number, col, column_stats, profile_frame
from driftline.operators.rows import distinct_names, materialised, running_sums, scratch

#: Fixed values.
BINS, FLOOR, KS_TERMS, NOTHING = 10, 1e-4, 100, 2.220446049250313e-16


# --- schemas


@dataclass
class SchemaDrift:
    added_fields: list[str] = field(default_factory=list)
    removed_fields: list[str] = field(default_factory=list)
    changed_types: list[dict] = field(default_factory=list)
    renamed_fields: list[dict] = field(default_factory=list)


def common_columns(source: T.StructType, target: T.StructType) -> list[str]:
    there = set(target.names)
    return [n for n in source.names if n in there]


def schema_drift(source: T.StructType, target: T.StructType) -> SchemaDrift:
    """Names on one side only, and names whose types differ. Order, nullability and metadata don't count."""
    old, new = ({f.name: type_name(f) for f in s.fields} for s in (source, target))
    changed = [{"field_name": n, "old_type": old[n], "new_type": new[n]} for n in sorted(old.keys() & new.keys()) if old[n] != new[n]]
    return SchemaDrift(sorted(new.keys() - old.keys()), sorted(old.keys() - new.keys()), changed)


def schema_drift_frame(spark: SparkSession, source: T.StructType, target: T.StructType) -> DataFrame:
    """field_name, change (added, removed, type), old_type, new_type."""
    old, new = (spark.createDataFrame([(f.name, type_name(f)) for f in s.fields], "field_name string, type string") for s in (source, target))
    both = old.withColumnRenamed("type", "old_type").join(new.withColumnRenamed("type", "new_type"), "field_name", "full_outer")
    change = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").when(F.col("old_type") != F.col("new_type"), "type")
    return both.select("field_name", change.alias("change"), "old_type", "new_type").where("change is not null")


# --- metrics


def long_numbers(source: DataFrame, target: DataFrame, columns: list[str]) -> DataFrame:
    """column, v, s, t: how often each value stands on either side. NaN and null are left out; -0.0 counts as 0.0."""

    def side(df: DataFrame, s: int, t: int) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), as_number(c).alias("v")) for c in columns]))
        return df.select(pairs.alias("x")).select("x.column", "x.v", F.lit(s).alias("s"), F.lit(t).alias("t"))

    both = side(source, 1, 0).union(side(target, 0, 1)).where("v is not null")
    return both.groupBy("column", "v").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))


def ks_p_value(d: Column, n1: Column, n2: Column) -> Column:
    """The asymptotic two-sided chance of a KS statistic at least as large, 1 where it is 0."""
    en = F.sqrt(n1.cast("double") * n2 / (n1 + n2))
    x = (en + F.lit(0.12) + F.lit(0.11) / en) * d
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(F.lit(-2.0) * (k * x) * (k * x)))
    return F.when(d.isNull(), None).when(x <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(2.0) * terms)))


def _psi(s: Column, t: Column, n_s: Column, n_t: Column) -> Column:
    """One bin's part of the PSI, shares floored."""
    e, a = F.greatest(s / n_s, F.lit(FLOOR)), F.greatest(t / n_t, F.lit(FLOOR))
    return (a - e) * F.ln(a / e)


def numeric_drift(source: DataFrame, target: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_source, n_target, ks_statistic, ks_p_value, psi_statistic for the columns that have numbers on a side.

    KS and PSI are null where a side has none. PSI's bins are cut at the source's deciles 0.1 to 0.9, interpolated
    between order statistics; it is 0 where all values of both sides are the same.
    """
    if not columns:
        return source.sparkSession.createDataFrame([], "column string, n_source bigint, n_target bigint, ks_statistic double, ks_p_value double, psi_statistic double")
    counts = materialised(running_sums(long_numbers(source, target, columns), ["column"], "v", ["s", "t"]))
    sizes = counts.groupBy("column").agg(F.sum("s").alias("n_source"), F.sum("t").alias("n_target"), F.min("v").alias("low"), F.max("v").alias("high"))
    sizes = materialised(sizes)  # a row a column
    both = counts.join(F.broadcast(sizes), "column")
    ks = both.where("n_source > 0 and n_target > 0").groupBy("column").agg(F.max(F.abs(F.col("cum_s") / F.col("n_source") - F.col("cum_t") / F.col("n_target"))).alias("ks_statistic"))
    edges = _decile_edges(both.where("n_source > 0 and n_target > 0 and s > 0"))
    binned = both.join(F.broadcast(edges), "column").withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("v"))))
    bins = binned.groupBy("column", "bin").agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.first("n_source").alias("n_s"), F.first("n_target").alias("n_t"))
    psi = bins.groupBy("column").agg(F.sum(_psi(F.col("s"), F.col("t"), F.col("n_s"), F.col("n_t"))).alias("psi"))  # a bin empty on both sides adds nothing
    out = sizes.join(ks, "column", "left").join(psi, "column", "left")
    same = F.col("high") - F.col("low") < NOTHING
    p = ks_p_value(F.col("ks_statistic"), F.col("n_source"), F.col("n_target"))
    return out.select("column", "n_source", "n_target", "ks_statistic", p.alias("ks_p_value"), F.when(F.col("psi").isNotNull(), F.when(same, 0.0).otherwise(F.col("psi"))).alias("psi_statistic"))


def _decile_edges(counts: DataFrame) -> DataFrame:
    """column, edges: the nine inner deciles of s, each low + fraction * (high - low) of the order statistics around it."""
    places = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    spots = F.transform(places, lambda q: q * (F.col("n_source") - 1))
    wanted = F.array_distinct(F.concat(F.transform(spots, lambda h: F.floor(h)), F.transform(spots, lambda h: F.ceil(h))))
    held = F.filter(wanted, lambda r: (r >= F.col("cum_s") - F.col("s")) & (r < F.col("cum_s")))
    found = counts.select("column", "n_source", "v", F.explode(held).alias("rank"))  # 18 rows a column at most
    stats = found.groupBy("column", "n_source").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def edge(h: Column) -> Column:
        low, high = F.element_at("at", F.floor(h)), F.element_at("at", F.ceil(h))
        return low + (h - F.floor(h)) * (high - low)

    return stats.select("column", F.transform(spots, edge).alias("edges"))


def categorical_drift(source: DataFrame, target: DataFrame, columns: list[str]) -> DataFrame:
    """column, categorical_drift: the PSI over value frequencies of text columns, every distinct value a bin."""
    if not columns:
        return source.sparkSession.createDataFrame([], "column string, categorical_drift double")

    def side(df: DataFrame, s: int, t: int) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("v")) for c in columns]))
        return df.select(pairs.alias("x")).select("x.column", "x.v", F.lit(s).alias("s"), F.lit(t).alias("t"))

    counts = side(source, 1, 0).union(side(target, 0, 1)).where("v is not null").groupBy("column", "v").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    counts = materialised(counts)
    sizes = counts.groupBy("column").agg(F.sum("s").alias("n_s"), F.sum("t").alias("n_t"))
    part = _psi(F.col("s"), F.col("t"), F.col("n_s"), F.col("n_t"))
    return counts.join(F.broadcast(sizes), "column").where("n_s > 0 and n_t > 0").groupBy("column").agg(F.sum(part).alias("categorical_drift"))


def stats_drift(source: DataFrame, target: DataFrame) -> DataFrame:
    """column, mean_drift (absolute), null_count_drift: from the profiles of the columns that both sides have."""
    a, b = (profile_frame(df).select("column", F.col("mean").alias(f"{k}_mean"), F.col("null_count").alias(f"{k}_nulls")) for df, k in ((source, "s"), (target, "t")))
    return a.join(b, "column").select("column", F.abs(F.col("t_mean") - F.col("s_mean")).alias("mean_drift"), (F.col("t_nulls") - F.col("s_nulls")).alias("null_count_drift"))


def metrics_frame(source: DataFrame, target: DataFrame) -> DataFrame:
    """column, ks_statistic, ks_p_value, psi_statistic, categorical_drift for the common columns that have such. Whether a text metric applies is decided by the types."""
    distinct_names(source)
    distinct_names(target)
    old, new = ({f.name: f for f in df.schema.fields} for df in (source, target))
    common = common_columns(source.schema, target.schema)
    numbers = [c for c in common if is_numeric(old[c]) and is_numeric(new[c])]
    texts = [c for c in common if is_text(old[c]) and is_text(new[c])]
    return numeric_drift(source, target, numbers).drop("n_source", "n_target").join(categorical_drift(source, target, texts), "column", "full")


def drift_frame(source: DataFrame, target: DataFrame) -> DataFrame:
    """Every metric, a row for each common column."""
    return stats_drift(source, target).join(metrics_frame(source, target), "column", "left")


def breaches(frame: DataFrame, threshold: float) -> DataFrame:
    """The columns whose PSI or categorical drift is over the threshold; a metric that is missing isn't."""
    over = [F.coalesce(F.col(c) > threshold, F.lit(False)) for c in ("psi_statistic", "categorical_drift")]
    return frame.where(over[0] | over[1])


# --- plain values, for reports


@dataclass
class ColumnDrift:
    source_stats: ColumnStats
    target_stats: ColumnStats
    mean_drift: float | None = None
    null_count_drift: int = 0
    ks_statistic: float | None = None
    ks_p_value: float | None = None
    psi_statistic: float | None = None
    categorical_drift: float | None = None

    def breaches(self, threshold: float) -> bool:
        return any(x is not None and x > threshold for x in (self.psi_statistic, self.categorical_drift))


def drift_from_stats(source: dict[str, ColumnStats], target: dict[str, ColumnStats]) -> dict[str, ColumnDrift]:
    """Mean and null-count drift of the columns that both have."""
    out = {}
    for name in sorted(source.keys() & target.keys()):
        a, b = source[name], target[name]
        mean = abs(b.mean - a.mean) if a.mean is not None and b.mean is not None else None
        out[name] = ColumnDrift(a, b, mean, b.null_count - a.null_count)
    return out


def data_drift(source: DataFrame, target: DataFrame, stats: tuple[dict[str, ColumnStats], dict[str, ColumnStats]] | None = None) -> dict[str, ColumnDrift]:
    """All metrics by column; none if a side has no rows. `stats` are both sides' statistics, where they are known already."""
    out = drift_from_stats(*(stats or (column_stats(source), column_stats(target))))
    if out:
        with scratch():
            for r in metrics_frame(source, target).collect():  # a row a column
                for k in ("ks_statistic", "ks_p_value", "psi_statistic", "categorical_drift"):
                    setattr(out[r["column"]], k, r[k])
    return out


def quantile_of(ordered: list[float], q: float) -> float:
    h = q * (len(ordered) - 1)
    low = ordered[math.floor(h)]
    return low + (h - math.floor(h)) * (ordered[math.ceil(h)] - low)


def psi_of_samples(source: list[float], target: list[float]) -> float | None:
    """The PSI of two bounded samples, as snapshots keep them."""
    a, b = (sorted(x for x in side if x is not None and not math.isnan(x)) for side in (source, target))
    if not a or not b:
        return None
    if max(a[-1], b[-1]) - min(a[0], b[0]) < NOTHING:
        return 0.0
    edges = [quantile_of(a, k / BINS) for k in range(1, BINS)]
    counts = [[0, 0] for _ in range(BINS)]
    for side, values in enumerate((a, b)):
        for v in values:
            counts[sum(e <= v for e in edges)][side] += 1
    total = 0.0
    for s, t in counts:
        e, f = max(s / len(a), FLOOR), max(t / len(b), FLOOR)
        total += (f - e) * math.log(f / e)
    return total


@dataclass(frozen=True)
class SemanticDrift:
    field_name: str
    source_type: str
    target_type: str


def semantic_drift(source: dict[str, str], target: dict[str, str], added_after: set[str] | None = None) -> list[SemanticDrift]:
    """Columns of both sides whose meaning changed. With `added_after` (the names that renames lead to), new columns with a known meaning too."""
    out = [SemanticDrift(n, source[n], target[n]) for n in source.keys() & target.keys() if source[n] != target[n]]
    if added_after is not None:
        out += [SemanticDrift(n, semantic.UNKNOWN, k) for n, k in target.items() if n not in source and n not in added_after and k != semantic.UNKNOWN]
    return sorted(out, key=lambda d: d.field_name)


def plain(x) -> dict:
    return asdict(x)
