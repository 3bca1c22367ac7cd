"""Domains: who may apply their targets, which there are, and where their services are."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from driftline.errors import AccessDenied, NoEndpoint, UnknownDomain
from driftline.plans.config import Config, Target, normal


def authorize_apply(config: Config, name: str, target: Target, actor: str) -> None:
    """Raises AccessDenied unless the target's domain is undeclared or lists the actor. A declared domain without operators lets nobody in."""
    entry = config.find_domain(target.domain) if target.domain else None
    if entry and actor not in entry[1].operators:
        raise AccessDenied(f"'{actor}' may not apply '{name}': no operator of domain '{target.domain}'")


@dataclass(frozen=True)
class DomainInfo:
    name: str
    endpoint: str | None
    operator_count: int
    target_count: int
    has_domain_entry: bool

    def to_dict(self) -> dict:
        return asdict(self)


def list_domains(config: Config) -> list[DomainInfo]:
    """Every domain that is declared or that a target names, by name; spellings that differ in case are one."""
    named = [t.domain for t in config.targets.values() if t.domain is not None]
    spelling = {normal(n): n for n in reversed(named)} | {normal(n): n for n in config.domains}
    out = []
    for key, shown in spelling.items():
        entry = config.find_domain(key)
        domain = entry[1] if entry else None
        out.append(DomainInfo(shown, domain.endpoint if domain else None, len(domain.operators) if domain else 0, sum(normal(n) == key for n in named), entry is not None))
    return sorted(out, key=lambda d: d.name)


def resolve_endpoint(config: Config, domain: str) -> str:
    info = next((d for d in list_domains(config) if normal(d.name) == normal(domain)), None)
    if info is None:
        raise UnknownDomain(f"no domain is named '{domain}'")
    if info.endpoint is None:
        raise NoEndpoint(f"domain '{domain}' names no endpoint")
    return info.endpoint
