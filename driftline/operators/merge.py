"""Three-way merge of schemas and of their metadata."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import types as T

from driftline.errors import SchemaError
from driftline.functions.types import own_metadata, type_name

MISSING = object()


@dataclass(frozen=True)
class MergeConflict:
    field_name: str
    kind: str  # AddAdd, ModifyModify, RemoveModify
    base: str | None
    ours: str | None
    theirs: str | None


@dataclass
class MergeResult:
    merged: T.StructType
    conflicts: list[MergeConflict] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)

    @property
    def is_clean(self) -> bool:
        return not self.conflicts


def describe(f: T.StructField) -> str:
    more = sorted((k, v if isinstance(v, str) else json.dumps(v)) for k, v in own_metadata(f).items())
    shown = " metadata=[" + ", ".join(f"({json.dumps(k)}, {json.dumps(v)})" for k, v in more) + "]" if more else ""
    return f"{type_name(f)} ({'nullable' if f.nullable else 'non-null'}){shown}"


def _settle(base, ours, theirs):
    """The value all three come to and the kind of conflict, if any; MISSING is a value like any other."""
    if ours == theirs or theirs == base:
        return ours, None
    if ours == base:
        return theirs, None
    if base is MISSING:
        return ours, "AddAdd"
    if MISSING in (ours, theirs):
        return theirs if ours is MISSING else ours, "RemoveModify"
    return ours, "ModifyModify"


def _definition(f: T.StructField | None):
    return MISSING if f is None else (type_name(f), f.nullable, json.dumps(own_metadata(f), sort_keys=True))


def _by_name(schema: T.StructType) -> dict[str, T.StructField]:
    if len(set(schema.names)) < len(schema.names):
        raise SchemaError("a schema to merge has a column name twice")
    return {f.name: f for f in schema.fields}


def three_way_merge(base: T.StructType, ours: T.StructType, theirs: T.StructType, metadata: tuple[dict, dict, dict] = ({}, {}, {})) -> MergeResult:
    """What both sides made of base. A change on one side is taken, the same change on both is one, and what
    contradicts is a conflict: ours stays, or the changed definition where the other side removed it."""
    sides = [_by_name(s) for s in (base, ours, theirs)]
    fields, conflicts = [], []
    for name in sorted({n for s in sides for n in s}):
        own = [s.get(name) for s in sides]
        keep, kind = _settle(*map(_definition, own))
        if kind:
            conflicts.append(MergeConflict(name, kind, *[describe(f) if f is not None else None for f in own]))
        if keep is not MISSING:
            fields.append(next(f for f in (own[1], own[2], own[0]) if _definition(f) == keep))
    merged = {}
    for key in sorted({k for m in metadata for k in m}):
        own = [m.get(key, MISSING) for m in metadata]
        keep, kind = _settle(*own)
        if kind:
            conflicts.append(MergeConflict(f"<schema metadata: {key}>", kind, *[None if v is MISSING else v for v in own]))
        if keep is not MISSING:
            merged[key] = keep
    return MergeResult(T.StructType(fields), conflicts, merged)
