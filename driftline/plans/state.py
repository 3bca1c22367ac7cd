"""Baselines: what a target looked like when it was applied, kept in a small JSON file."""

from __future__ import annotations

import json
import os
import tempfile
import time
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.errors import StateError, UnsupportedStateVersion
from driftline.functions.types import SAMPLED, field_of, type_name
from driftline.operators.profile import ColumnStats, as_number, column_stats, semantic_types
from driftline.operators.rows import INDEX, indexed, scratch
from driftline.sources.readers import Source

#: Fixed values.
VERSION, TRIES, WAIT_S = 1, 50, 0.02


@dataclass
class Snapshot:
    schema: list[dict]
    column_stats: dict[str, ColumnStats]
    semantic_types: dict[str, str]
    samples: dict[str, list[float]] | None
    timestamp: str

    def struct(self) -> T.StructType:
        return schema_from(self.schema)

    def to_dict(self) -> dict:
        return {"schema": {"fields": self.schema}, "column_stats": {k: s.to_dict() for k, s in self.column_stats.items()}, "semantic_types": self.semantic_types, "samples": self.samples, "timestamp": self.timestamp}

    @classmethod
    def from_dict(cls, d: dict) -> Snapshot:
        return cls(d["schema"]["fields"], {k: ColumnStats(**s) for k, s in d["column_stats"].items()}, d["semantic_types"], d.get("samples"), d["timestamp"])


def schema_to(schema: T.StructType) -> list[dict]:
    """Name, canonical type and nullability of each field; metadata isn't kept."""
    return [{"name": f.name, "data_type": type_name(f), "nullable": f.nullable} for f in schema.fields]


def schema_from(fields: list[dict]) -> T.StructType:
    return T.StructType([field_of(f["name"], f["data_type"], f["nullable"]) for f in fields])


def first_samples(df: DataFrame, n: int, order_by: list[str] | None = None) -> dict[str, list[float]]:
    """The first n numbers, in row order, of each column of a sampled type; null and NaN don't count.

    Each partition keeps its first n for each column before anything is shuffled, so what meets is n rows a partition at most.
    """
    columns = [f.name for f in df.schema.fields if type_name(f) in SAMPLED]
    if not columns:
        return {}
    with scratch():
        rows = indexed(df, order_by)
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), as_number(c).alias("v")) for c in columns]))
        long = rows.select(F.col(INDEX).alias("i"), pairs.alias("x")).select("i", "x.column", "x.v").where("v is not null")
        local = long.withColumn("p", F.spark_partition_id())
        local = local.withColumn("k", F.row_number().over(W.partitionBy("p", "column").orderBy("i"))).where(F.col("k") <= n)
        kept = local.withColumn("k", F.row_number().over(W.partitionBy("column").orderBy("i"))).where(F.col("k") <= n)
        out: dict[str, list[float]] = {c: [] for c in columns}
        for r in kept.select("column", "i", "v").orderBy("column", "i").collect():  # n rows a column
            out[r["column"]].append(r["v"])
    return out


def capture(source: Source, identifier: str, sample_n: int | None, order_by: list[str] | None = None) -> Snapshot:
    """A snapshot of a dataset as it is now. One without rows has a schema and nothing else."""
    df = source.data(identifier)
    stats = column_stats(df)
    kinds = semantic_types(df, order_by) if stats else {}
    samples = (first_samples(df, sample_n, order_by) if stats else {}) if sample_n else None
    return Snapshot(schema_to(df.schema), stats, kinds, samples, datetime.now(UTC).isoformat())


@dataclass
class State:
    snapshots: dict[str, Snapshot] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | Path) -> State:
        try:
            raw = json.loads(Path(path).read_text())
        except (OSError, ValueError) as e:
            raise StateError(f"can't read {path}: {e}") from e
        if raw.get("schema_version") != VERSION:
            raise UnsupportedStateVersion(f"{path} has version {raw.get('schema_version')}, this is {VERSION}")
        return cls({k: Snapshot.from_dict(s) for k, s in raw["snapshots"].items()})

    @classmethod
    def load_or_default(cls, path: str | Path) -> State:
        return cls.load(path) if Path(path).exists() else cls()

    def save(self, path: str | Path) -> None:
        """Adds this state to what the file holds, its own targets over those there, and replaces the file in one step."""
        path = Path(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        with _locked(path):
            all_ = State.load_or_default(path).snapshots | self.snapshots
            text = json.dumps({"schema_version": VERSION, "snapshots": {k: s.to_dict() for k, s in sorted(all_.items())}}, indent=2)
            handle, name = tempfile.mkstemp(dir=path.parent, prefix=path.name)
            with os.fdopen(handle, "w") as file:
                file.write(text)
            os.replace(name, path)


class _locked:
    """A lock file beside the state, taken by whoever creates it."""

    def __init__(self, path: Path):
        self.path = path.with_name(path.name + ".lock")

    def __enter__(self):
        for _ in range(TRIES):
            try:
                os.close(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                return self
            except FileExistsError:
                time.sleep(WAIT_S)
        raise StateError(f"{self.path} is held by another process; remove it if none runs")

    def __exit__(self, *_):
        self.path.unlink(missing_ok=True)
