"""The project's configuration: a TOML file whose every table knows its keys."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field

from driftline.errors import ConfigError

FILE, FOLDER, ACTOR = "driftline.toml", ".driftline", "DRIFTLINE_ACTOR"
#: Fixed values.
SAMPLE_N, RENAME_THRESHOLD = 1000, 0.6
_REQUIRED = object()


@dataclass(frozen=True)
class Connection:
    type: str
    url: str | None = None
    bucket: str | None = None
    region: str | None = None
    format: str | None = None
    root: str | None = None


@dataclass(frozen=True)
class Sample:
    enabled: bool = True
    n: int = SAMPLE_N


@dataclass(frozen=True)
class Target:
    connection: str
    identifier: str
    sample: Sample | None = None
    domain: str | None = None
    owner: str | None = None

    @property
    def sample_n(self) -> int | None:
        """How many values a snapshot keeps for each column: by default SAMPLE_N, none if switched off or 0."""
        sample = self.sample or Sample()
        return sample.n or None if sample.enabled else None


@dataclass(frozen=True)
class Domain:
    operators: tuple[str, ...] = ()
    endpoint: str | None = None


@dataclass(frozen=True)
class Config:
    name: str
    version: str
    drift_threshold: float
    rename_confidence_threshold: float = RENAME_THRESHOLD
    connections: dict[str, Connection] = field(default_factory=dict)
    targets: dict[str, Target] = field(default_factory=dict)
    domains: dict[str, Domain] = field(default_factory=dict)

    def find_domain(self, name: str) -> tuple[str, Domain] | None:
        """The domain of that name, whatever the case and the white space around it."""
        return next(((k, d) for k, d in self.domains.items() if normal(k) == normal(name)), None)


def normal(domain: str) -> str:
    return domain.strip().lower()


class _Table:
    """Takes keys out of a TOML table by type, and complains about what is left."""

    def __init__(self, where: str, table):
        if not isinstance(table, dict):
            raise ConfigError(f"{where} must be a table")
        self.where, self.left = where, dict(table)

    def take(self, key: str, kinds, default=_REQUIRED):
        if key not in self.left:
            if default is _REQUIRED:
                raise ConfigError(f"{self.where}: missing field '{key}'")
            return default
        value = self.left.pop(key)
        kinds = kinds if isinstance(kinds, tuple) else (kinds,)
        if not isinstance(value, kinds) or (isinstance(value, bool) and bool not in kinds):
            raise ConfigError(f"{self.where}: '{key}' has the wrong type")
        return value

    def done(self) -> None:
        if self.left:
            raise ConfigError(f"{self.where}: unknown field '{min(self.left)}'")


def _connection(where: str, raw) -> Connection:
    t = _Table(where, raw)
    kind = t.take("type", str)
    fmt = None
    if kind == "postgres":
        out = {"url": t.take("url", str)}
    elif kind == "s3":
        out = {"bucket": t.take("bucket", str), "region": t.take("region", str)}
        fmt = t.take("format", str, None)
    elif kind == "file":
        out = {"root": t.take("root", str, "")}
        fmt = t.take("format", str, None)
    else:
        raise ConfigError(f"{where}: unknown connection type '{kind}'")
    if fmt not in (None, "parquet", "csv", "json"):
        raise ConfigError(f"{where}: unknown format '{fmt}'")
    t.done()
    return Connection(kind, format=fmt, **out)


def _target(where: str, raw) -> Target:
    t = _Table(where, raw)
    sample = t.take("sample", dict, None)
    if sample is not None:
        s = _Table(f"{where}.sample", sample)
        sample = Sample(s.take("enabled", bool, True), s.take("n", int, SAMPLE_N))
        s.done()
        if sample.n < 0:
            raise ConfigError(f"{where}.sample: 'n' must not be negative")
    out = Target(t.take("connection", str), t.take("identifier", str), sample, t.take("domain", str, None), t.take("owner", str, None))
    t.done()
    return out


def _domain(where: str, raw) -> Domain:
    t = _Table(where, raw)
    operators, endpoint = t.take("operators", list, []), t.take("endpoint", str, None)
    t.done()
    if not all(isinstance(o, str) for o in operators):
        raise ConfigError(f"{where}: 'operators' must be strings")
    if endpoint is not None and not re.fullmatch(r"https?://[^\s/?#]+\S*", endpoint):
        raise ConfigError(f"{where}: endpoint '{endpoint}' is not an http(s) URL with a host")
    return Domain(tuple(operators), endpoint)


def _share(where: str, key: str, value: float) -> float:
    if not 0 <= value <= 1:
        raise ConfigError(f"{where}: '{key}' must be in [0, 1], got {value}")
    return float(value)


def parse_config(text: str) -> Config:
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"not valid TOML: {e}") from e
    if "schema" in raw:
        raise ConfigError("the [schema] table is obsolete: schemas are read from the targets")
    t = _Table("configuration", raw)
    project, checks = _Table("[project]", t.take("project", dict)), _Table("[checks]", t.take("checks", dict))
    maps = {k: t.take(k, dict, {}) for k in ("connections", "targets", "domains")}
    t.done()
    name, version = project.take("name", str), project.take("version", str)
    drift, rename = checks.take("drift_threshold", (int, float)), checks.take("rename_confidence_threshold", (int, float), RENAME_THRESHOLD)
    project.done()
    checks.done()
    makers = {"connections": _connection, "targets": _target, "domains": _domain}
    built = {k: {n: makers[k](f"[{k}.{n}]", v) for n, v in m.items()} for k, m in maps.items()}
    for n, target in built["targets"].items():
        if target.connection not in built["connections"]:
            raise ConfigError(f"target '{n}' is on connection '{target.connection}', which isn't defined")
    seen: dict[str, str] = {}
    for n in built["domains"]:
        if normal(n) in seen:
            raise ConfigError(f"domains '{seen[normal(n)]}' and '{n}' are the same name")
        seen[normal(n)] = n
    return Config(name, version, _share("[checks]", "drift_threshold", drift), _share("[checks]", "rename_confidence_threshold", rename), **built)
