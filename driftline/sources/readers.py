"""Sources: files by format, tables over JDBC, and whatever else can give a schema and a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.errors import ConfigError, SchemaError
from driftline.functions.types import field_of, postgres_type
from driftline.plans.config import Connection

SNIFFED = 100
FORMATS = ("parquet", "csv", "json")


@runtime_checkable
class Source(Protocol):
    """The extension point: anything with these two can be profiled, diffed and committed to."""

    def schema(self, identifier: str) -> T.StructType: ...

    def data(self, identifier: str) -> DataFrame: ...


def format_of(identifier: str, override: str | None = None) -> str:
    """The format named, else by suffix whatever its case, else Parquet."""
    if override:
        return override
    low = identifier.lower()
    return "csv" if low.endswith(".csv") else "json" if low.endswith((".ndjson", ".json")) else "parquet"


def _widened(schema: T.StructType) -> T.StructType:
    """Inferred whole numbers are 64 bits wide."""
    return T.StructType([T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.IntegerType) else f.dataType, f.nullable) for f in schema.fields])


class FileSource:
    """Parquet, CSV and JSON under a root (a folder or a bucket's URL); only Spark's readers touch it."""

    def __init__(self, spark: SparkSession, root: str = "", fmt: str | None = None):
        self.spark, self.root, self.format = spark, root, fmt

    def path(self, identifier: str) -> str:
        return f"{self.root.rstrip('/')}/{identifier.lstrip('/')}" if self.root else identifier

    def data(self, identifier: str) -> DataFrame:
        fmt, path = format_of(identifier, self.format), self.path(identifier)
        try:
            return {"parquet": self._parquet, "csv": self._csv, "json": self._json}[fmt](path)
        except KeyError:
            raise ConfigError(f"unknown format '{fmt}'") from None

    def schema(self, identifier: str) -> T.StructType:
        return self.data(identifier).schema

    def _parquet(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def _csv(self, path: str) -> DataFrame:
        """Types from the first records; later records that contradict them are errors. A file in which a line ends within quotes is read record by
        record and not split; all others, which one pass over their lines tells, are."""
        text = self.spark.read.text(path)
        broken = not text.where((F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1).isEmpty()
        plain = self.spark.read.csv(path, header=True, multiLine=broken).limit(SNIFFED)
        lines = plain.select(F.to_csv(F.struct(*[F.regexp_replace(F.col(f"`{c}`"), r"[\r\n]", " ").alias(f"c{k}") for k, c in enumerate(plain.columns)])).alias("value"))
        sample = self.spark.read.csv(lines.rdd.map(lambda r: r[0]), inferSchema=True) if plain.columns else plain  # SNIFFED lines at most
        kinds = [f.dataType for f in sample.schema.fields] + [T.StringType()] * len(plain.columns)
        schema = T.StructType([T.StructField(c, kind) for c, kind in zip(plain.columns, kinds, strict=False)])
        return self.spark.read.csv(path, header=True, schema=_widened(schema), mode="FAILFAST", enforceSchema=False, multiLine=broken)

    def _json(self, path: str) -> DataFrame:
        """A file whose first character is [ is one array of records, any other a record a line."""
        first = self.spark.read.text(path, wholetext=False).select(F.ltrim("value").alias("v")).where("v <> ''").limit(1).collect()
        array = bool(first) and first[0][0].startswith("[")
        reader = self.spark.read.option("mode", "FAILFAST")
        if array:
            return reader.option("multiLine", True).json(path)
        schema = reader.json(self.spark.read.text(path).limit(SNIFFED).rdd.map(lambda r: r[0])).schema
        return reader.schema(schema).json(path)


def split_identifier(identifier: str) -> tuple[str, str]:
    r"""(schema, table) of `table` or `schema.table`; `\.` is a dot within a name. The default schema is public."""
    parts = [""]
    rest = iter(identifier)
    for c in rest:
        if c == "\\":
            following = next(rest, "")
            parts[-1] += following if following == "." else c + following
        elif c == ".":
            parts.append("")
        else:
            parts[-1] += c
    if len(parts) > 2 or not all(parts):
        raise ConfigError(f"'{identifier}' is not a table or schema.table")
    return (parts[0], parts[1]) if len(parts) == 2 else ("public", parts[0])


def quoted(*parts: str) -> str:
    return ".".join('"' + p.replace('"', '""') + '"' for p in parts)


def jdbc_options(url: str, **more: str) -> dict[str, str]:
    """JDBC options for a postgres:// URL: user and password leave the address."""
    from urllib.parse import parse_qsl, unquote, urlencode, urlsplit

    u = urlsplit(url)
    if u.scheme not in ("postgres", "postgresql") or not u.hostname:
        raise ConfigError("a postgres url looks like postgres://user:password@host/database")
    query = f"?{urlencode(parse_qsl(u.query))}" if u.query else ""
    out = {"url": f"jdbc:postgresql://{u.hostname}:{u.port or 5432}{u.path}{query}", "driver": "org.postgresql.Driver"} | more
    return out | {k: unquote(v) for k, v in (("user", u.username), ("password", u.password)) if v}


class PostgresSource:
    """Tables over JDBC. `partition` = (column, low, high, parts) reads a table in parallel ranges."""

    CATALOG = "select column_name, data_type, is_nullable, numeric_precision, numeric_scale from information_schema.columns where table_schema = '{}' and table_name = '{}' order by ordinal_position"

    def __init__(self, spark: SparkSession, url: str, partition: tuple[str, int, int, int] | None = None):
        self.spark, self.url, self.partition = spark, url, partition

    def options(self, identifier: str) -> dict[str, str]:
        out = jdbc_options(self.url, dbtable=quoted(*split_identifier(identifier)), fetchsize="10000")
        if self.partition:
            out |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, self.partition), strict=True))
        return out

    def catalog_query(self, identifier: str) -> str:
        return self.CATALOG.format(*(p.replace("'", "''") for p in split_identifier(identifier)))

    def schema(self, identifier: str) -> T.StructType:
        rows = self.spark.read.format("jdbc").options(**jdbc_options(self.url, query=self.catalog_query(identifier))).load().collect()
        return schema_of_catalog(identifier, rows)

    def data(self, identifier: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.options(identifier)).load()


def schema_of_catalog(identifier: str, rows: list) -> T.StructType:
    if not rows:
        raise SchemaError(f"table '{identifier}' not found")
    return T.StructType([field_of(name, postgres_type(kind, precision, scale), nullable == "YES") for name, kind, nullable, precision, scale in rows])


BUILDERS: dict[str, Callable[[SparkSession, Connection], Source]] = {
    "postgres": lambda spark, c: PostgresSource(spark, c.url),
    "s3": lambda spark, c: FileSource(spark, f"s3a://{c.bucket}", c.format),
    "file": lambda spark, c: FileSource(spark, c.root or "", c.format),
}


def build_source(spark: SparkSession, connection: Connection) -> Source:
    if connection.type not in BUILDERS:
        raise ConfigError(f"unknown connection type '{connection.type}'")
    if connection.type == "s3" and connection.region:
        spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.s3a.bucket.{connection.bucket}.endpoint.region", connection.region)
    return BUILDERS[connection.type](spark, connection)


class SourceCache:
    """One source for each connection's name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def get(self, name: str, connection: Connection) -> Source:
        if name not in self.held:
            self.held[name] = build_source(self.spark, connection)
        return self.held[name]
