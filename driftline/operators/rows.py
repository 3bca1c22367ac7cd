"""Row order, and tables that later steps read again.

DataFrames have no order, so whatever depends on it (row hashes, first-n samples, spread samples) takes either a key to
order by or the place of a row in its Parquet files. Both give a dense index without sending all rows through one task.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.errors import SchemaError

INDEX = "__row"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            folder = held.get()
        else:
            local = tempfile.mkdtemp(prefix="driftline-")
            atexit.register(shutil.rmtree, local, True)
            folder = "file://" + local
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_WRITTEN: list[list[DataFrame]] = []


def materialised(df: DataFrame) -> DataFrame:
    """df written once as a table in the shared folder and read from there, so that it has one content however often it is read and
    wherever executors are lost. The table goes by `discard`, at the end of a `scratch` block around it, or else when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/driftline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    if _WRITTEN:
        _WRITTEN[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `materialised` wrote and that nothing still to be computed reads."""
    for table in tables:
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(table.kept_at)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.delete(where, True)
        files.cancelDeleteOnExit(where)


@contextmanager
def scratch() -> Iterator[None]:
    """Around steps that bring what they find to the driver: the tables they wrote go when it ends."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        discard(*_WRITTEN.pop())


def distinct_names(df: DataFrame) -> None:
    """Columns are looked up by name, so a name may stand for one only."""
    twice = sorted({c for c in df.columns if df.columns.count(c) > 1})
    if twice:
        raise SchemaError(f"duplicate column names: {', '.join(twice)}")


def indexed(df: DataFrame, order_by: list[str] | None = None, name: str = INDEX) -> DataFrame:
    """df with a dense row number from 0, by `order_by` or by place in the files it was read from.

    By key: a range partitioning sorts it, and each partition's rows are numbered from the count of those before it.
    By file: each block of a file, read by a task in one go, is numbered from the count of those before it, in order of
    path and place; no shuffle of rows. Filters are fine; what moves rows between tasks is noticed and refused.
    """
    if order_by:
        ordered = df.repartitionByRange(*[F.col(f"`{c}`").asc_nulls_first() for c in order_by]).sortWithinPartitions(*[F.col(f"`{c}`").asc_nulls_first() for c in order_by])
        placed = materialised(ordered.withColumn("__at", F.monotonically_increasing_id()))
        part, local = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    elif (placed := _select(df, "_metadata.file_path", "_metadata.file_block_start")) is not None:
        placed = placed.withColumn("__at", F.concat_ws(":", "__at", F.lpad(F.col("__local").cast("string"), 20, "0"))).withColumn("__local", F.monotonically_increasing_id())
        part, local = F.col("__at"), F.col("__local") - F.col("__first")
    else:
        raise SchemaError("these rows have no order: name the columns to order by, or read them from files")
    first, last = (F.min("__local"), F.max("__local")) if not order_by else (F.lit(0), F.lit(0))
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"), first.alias("__first"), last.alias("__last"))  # a row for each partition or block
    gap = F.col("__last") - F.col("__first") + 1 != F.col("__n")
    counts = counts.withColumn("__first", F.when(gap, F.raise_error(F.lit("rows no longer lie as in their files: name the columns to order by")).cast("bigint")).otherwise(F.col("__first"))) if not order_by else counts
    before = counts.select("__part", "__first", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    return placed.withColumn("__part", part).join(before, "__part").withColumn(name, local + F.col("__before")).drop("__part", "__at", "__local", "__before", "__first")


def _select(df: DataFrame, at: str, local: str) -> DataFrame | None:
    """df with two fields of its files' metadata, None if it has none such."""
    try:
        return df.select("*", F.col(at).alias("__at"), F.col(local).alias("__local"))
    except AnalysisException:
        return None


def running_sums(counts: DataFrame, by: list[str], value: str, sums: list[str]) -> DataFrame:
    """counts, one row for each (by, value), with the running sum of each of `sums` in order of value within `by`.

    A two-pass prefix sum: ranges of (by, value) are summed each for itself, then start from what lies before them. So
    one column of very many distinct values is no longer one task.
    """
    ranged = materialised(counts.repartitionByRange(*by, value).withColumn("__part", F.spark_partition_id()))
    own = W.partitionBy("__part", *by).orderBy(value)
    totals = ranged.groupBy("__part", *by).agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    across = W.partitionBy(*by).orderBy("__part")
    before = totals.select("__part", *by, *[(F.sum(f"__{s}").over(across) - F.col(f"__{s}")).alias(f"__{s}") for s in sums])
    local = ranged.select("*", *[F.sum(s).over(own).alias(f"__own_{s}") for s in sums])
    return local.join(before, ["__part", *by]).select(*counts.columns, *[(F.col(f"__own_{s}") + F.col(f"__{s}")).alias(f"cum_{s}") for s in sums])
