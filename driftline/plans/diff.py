"""Diffs of two datasets, and plans: a baseline against what its target is now."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from driftline.errors import ConfigError, StateError
from driftline.operators.drift import ColumnDrift, SchemaDrift, SemanticDrift, data_drift, drift_from_stats, plain, psi_of_samples, schema_drift, semantic_drift
from driftline.operators.profile import profiles, profiles_from
from driftline.operators.rename import RenameOptions, fold_renames
from driftline.plans.config import SAMPLE_N, Config, normal
from driftline.plans.state import State, capture
from driftline.sources.readers import Source, SourceCache


@dataclass
class DiffReport:
    source_identifier: str
    target_identifier: str
    schema_drift: SchemaDrift = field(default_factory=SchemaDrift)
    semantic_drifts: list[SemanticDrift] = field(default_factory=list)
    column_drifts: dict[str, ColumnDrift] = field(default_factory=dict)

    def to_dict(self) -> dict:
        return {"source_identifier": self.source_identifier, "target_identifier": self.target_identifier, "schema_drift": plain(self.schema_drift), "semantic_drifts": [plain(d) for d in self.semantic_drifts], "data_drift": {"column_drifts": {k: plain(d) for k, d in self.column_drifts.items()}}}


def diff_frames(source: DataFrame, target: DataFrame, source_name: str = "source", target_name: str = "target", options: RenameOptions = RenameOptions(), order_by: list[str] | None = None) -> DiffReport:
    """All four kinds of change between two datasets, over all their rows."""
    changes = schema_drift(source.schema, target.schema)
    a, b = profiles(source, order_by), profiles(target, order_by)
    kinds = [{n: p.semantic_type for n, p in side.items()} for side in (a, b)]
    stats = tuple({n: p.stats for n, p in side.items()} for side in (a, b))
    drift = data_drift(source, target, stats) if a and b else {}
    return DiffReport(source_name, target_name, fold_renames(changes, a, b, options), semantic_drift(*kinds), drift)


def diff(source: Source, source_id: str, target: Source, target_id: str, options: RenameOptions = RenameOptions(), order_by: list[str] | None = None) -> DiffReport:
    return diff_frames(source.data(source_id), target.data(target_id), source_id, target_id, options, order_by)


@dataclass
class TargetReport:
    name: str
    domain: str | None
    owner: str | None
    report: DiffReport


def plan_targets(spark: SparkSession, config: Config, state: State, target: str | None = None, domain: str | None = None, options: RenameOptions = RenameOptions()) -> list[TargetReport]:
    """Each target's baseline against now, by name. What is filtered out is never read. Samples, not all rows, give the PSI."""
    if target is not None and target not in config.targets:
        raise ConfigError(f"no target is named '{target}'")
    sources, out = SourceCache(spark), []
    for name, t in sorted(config.targets.items()):
        if (target is not None and name != target) or (domain is not None and (t.domain is None or normal(t.domain) != normal(domain))):
            continue
        old = state.snapshots.get(name)
        if old is None:
            raise StateError(f"target '{name}' has no snapshot: run apply before")
        new = capture(sources.get(t.connection, config.connections[t.connection]), t.identifier, SAMPLE_N)
        before, after = old.struct(), new.struct()
        changes = schema_drift(before, after)
        changes = fold_renames(changes, profiles_from(before, old.semantic_types, old.column_stats), profiles_from(after, new.semantic_types, new.column_stats), options)
        columns = drift_from_stats(old.column_stats, new.column_stats)
        for column, drift in columns.items():
            if (a := (old.samples or {}).get(column)) is not None and (b := (new.samples or {}).get(column)) is not None:
                drift.psi_statistic = psi_of_samples(a, b)
        meanings = semantic_drift(old.semantic_types, new.semantic_types, {r["to"] for r in changes.renamed_fields})
        out.append(TargetReport(name, t.domain, t.owner, DiffReport(f"{name} (baseline)", t.identifier, changes, meanings, columns)))
    return out


def breached(reports: list[DiffReport], threshold: float) -> list[str]:
    """target:column for every column over the threshold, sorted."""
    return sorted(f"{r.target_identifier}:{c}" for r in reports for c, d in r.column_drifts.items() if d.breaches(threshold))


def lines_of(report: DiffReport) -> list[str]:
    """A report for people."""
    s = report.schema_drift
    out = [f"  new columns: {', '.join(s.added_fields)}"] if s.added_fields else []
    out += [f"  missing columns: {', '.join(s.removed_fields)}"] if s.removed_fields else []
    out += [f"  {r['from']} is now {r['to']} ({r['confidence']:.0%} sure)" for r in s.renamed_fields]
    out += [f"  {c['field_name']} was {c['old_type']}, is {c['new_type']}" for c in s.changed_types]
    for name, d in sorted(report.column_drifts.items()):
        metrics = {"mean": d.mean_drift or None, "nulls": d.null_count_drift or None, "psi": d.psi_statistic, "ks": d.ks_statistic, "p": d.ks_p_value, "categorical": d.categorical_drift}
        shown = [f"{k} {v:.4g}" for k, v in metrics.items() if v is not None]
        out += [f"  {name} drifts: {', '.join(shown)}"] if shown else []
    out += [f"  {d.field_name} meant {d.source_type}, means {d.target_type}" for d in report.semantic_drifts]
    return [f"{report.source_identifier} / {report.target_identifier}", *(out or ["  no difference"])]


def federated_lines(reports: list[TargetReport]) -> list[str]:
    """Reports by domain, those without one last."""
    out = []
    for domain in sorted({r.domain for r in reports}, key=lambda d: (d is None, d or "")):
        out.append(f"[{domain}]" if domain is not None else "[no domain]")
        for r in reports:
            if r.domain == domain:
                out += ([f"  owner {r.owner}"] if r.owner is not None else []) + lines_of(r.report)
    return out


def to_json(reports: list[DiffReport]) -> str:
    return json.dumps([r.to_dict() for r in reports], indent=2, ensure_ascii=False)


def write_artifact(reports: list[DiffReport], path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(to_json(reports))
