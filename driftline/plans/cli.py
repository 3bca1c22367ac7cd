"""The command line: init, apply, plan, diff, federate, domains, explore."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime
from pathlib import Path

from driftline.errors import ConfigError, EngineError, StateError
from driftline.plans.config import ACTOR, FILE, FOLDER, Config, parse_config
from driftline.plans.governance import authorize_apply, list_domains, resolve_endpoint

SKELETON = """[project]
name = {name}
version = "0.1.0"

# Where data is: as many named connections as you like.
# [connections.lake]
# type = "file"            # or "s3" with bucket and region, or "postgres" with url
# root = "/data/lake"

# What to watch.
# [targets.users]
# connection = "lake"
# identifier = "users.parquet"
# domain = "accounts"      # optional, as is owner

# Samples for the drift gate are kept unless switched off here.
# [targets.users.sample]
# enabled = true
# n = 1000

# A column whose PSI is over drift_threshold (0 to 1) fails a plan.
[checks]
drift_threshold = 0.05
# rename_confidence_threshold = 0.6
"""


def toml_string(s: str) -> str:
    """A TOML basic string."""
    return '"' + "".join("\\" + c if c in '\\"' else f"\\u{ord(c):04x}" if ord(c) < 32 or ord(c) == 127 else c for c in s) + '"'


def load_config() -> Config:
    try:
        return parse_config(Path(FILE).read_text())
    except FileNotFoundError:
        raise ConfigError(f"there is no {FILE} in {Path.cwd()}: run init before") from None


def state_path() -> Path:
    return Path(FOLDER, "state.json")


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("driftline").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def init(args) -> int:
    if Path(FILE).exists():
        raise ConfigError(f"there is a {FILE} in {Path.cwd()}")
    Path(FILE).write_text(SKELETON.format(name=toml_string(args.name)))
    Path(FOLDER).mkdir(exist_ok=True)
    Path(FOLDER, ".gitignore").write_text("plans/\n")
    print(f"{FILE} is there for project '{args.name}': edit it, then run apply")
    return 0


def apply(args) -> int:
    from driftline.plans.state import State, capture
    from driftline.sources.readers import SourceCache

    config = load_config()
    if args.target is not None and args.target not in config.targets:
        raise ConfigError(f"no target is named '{args.target}'")
    state, actor = State.load_or_default(state_path()), args.actor or os.environ.get(ACTOR)
    chosen = {n: t for n, t in sorted(config.targets.items()) if args.target in (None, n)}
    for name, target in chosen.items():  # before anything is read
        if target.domain and config.find_domain(target.domain):
            if not actor:
                raise ConfigError(f"applying '{name}' takes an operator of domain '{target.domain}': say who you are with --as or {ACTOR}")
            authorize_apply(config, name, target, actor)
    sources = SourceCache(session()) if chosen else None
    for name, target in chosen.items():
        state.snapshots[name] = capture(sources.get(target.connection, config.connections[target.connection]), target.identifier, target.sample_n)
    state.save(state_path())
    print(f"applied: {', '.join(chosen)}" if chosen else "no targets, nothing applied")
    return 0


def _options(args, config):
    from driftline.operators.rename import RenameOptions

    chosen = config.rename_confidence_threshold if args.rename_threshold is None else args.rename_threshold
    if not 0 <= chosen <= 1:
        raise ConfigError(f"--rename-threshold must be in [0, 1], got {chosen}")
    return RenameOptions(min_confidence=chosen)


def _finish(reports, threshold, args, what) -> int:
    """Writes the artifact and tells by the exit code whether a column is over the threshold."""
    from driftline.plans.diff import breached, write_artifact

    out = args.out or str(Path(FOLDER, "plans", datetime.now(UTC).strftime("%Y%m%dT%H%M%S%fZ") + ".json"))
    write_artifact(reports, out)
    print(f"{what} saved as {out}", file=sys.stderr if args.format == "json" else sys.stdout)
    over = breached(reports, threshold)
    if over:
        print(f"over the drift threshold of {threshold:g}: {', '.join(over)}", file=sys.stderr)
    return 1 if over else 0


def _planned(args, target=None, domain=None):
    from driftline.plans.diff import plan_targets
    from driftline.plans.state import State

    config = load_config()
    if not state_path().exists():
        raise StateError(f"there is no {state_path()}: run apply before")
    options = _options(args, config)
    state = State.load(state_path())
    return config, plan_targets(session(), config, state, target, domain, options) if config.targets else []


def _nothing(args, text: str) -> int:
    print("[]" if args.format == "json" else text)
    return 0


def plan(args) -> int:
    from driftline.plans.diff import lines_of, to_json

    config, found = _planned(args, target=args.target)
    if not found:
        return _nothing(args, "no targets, nothing planned")
    reports = [t.report for t in found]
    print(to_json(reports) if args.format == "json" else "\n".join(x for r in reports for x in lines_of(r)))
    return _finish(reports, config.drift_threshold, args, "plan")


def federate(args) -> int:
    from driftline.plans.config import normal
    from driftline.plans.diff import federated_lines, to_json

    config, found = _planned(args, domain=args.domain)
    if not found:
        if args.domain is not None and normal(args.domain) not in {normal(d.name) for d in list_domains(config)}:
            raise ConfigError(f"no domain is named '{args.domain}'")
        return _nothing(args, f"domain '{args.domain}' has no targets" if args.domain is not None else "there are no targets")
    reports = [t.report for t in found]
    print(to_json(reports) if args.format == "json" else "\n".join(federated_lines(found)))
    return _finish(reports, config.drift_threshold, args, "federated plan")


def side_of(config: Config, text: str):
    """(connection name, identifier) of `connection:identifier` or of a target's name."""
    name, colon, identifier = text.partition(":")
    if colon and name in config.connections:
        return name, identifier
    if text in config.targets:
        return config.targets[text].connection, config.targets[text].identifier
    raise ConfigError(f"no connection is named '{name}'" if colon else f"'{text}' is neither a target nor connection:identifier")


def diff(args) -> int:
    from driftline.plans import diff as d
    from driftline.sources.readers import SourceCache

    config = load_config()
    sides, options = [side_of(config, s) for s in (args.left, args.right)], _options(args, config)
    sources = SourceCache(session())
    (a, a_id), (b, b_id) = sides
    report = d.diff(sources.get(a, config.connections[a]), a_id, sources.get(b, config.connections[b]), b_id, options)
    print(d.to_json([report]) if args.format == "json" else "\n".join(d.lines_of(report)))
    return _finish([report], config.drift_threshold, args, "diff")


def domains(args) -> int:
    config = load_config()
    if args.resolve is not None:
        print(resolve_endpoint(config, args.resolve))
        return 0
    found = [d for d in list_domains(config) if (d.target_count or not args.with_targets) and not (args.missing_endpoint and d.endpoint is not None)]
    if args.format == "json":
        print(json.dumps([d.to_dict() for d in found], indent=2))
    elif not found:
        print("there are no domains")
    for d in found if args.format != "json" else []:
        print(f"{d.name}  targets={d.target_count}  operators={d.operator_count}  endpoint={d.endpoint or '-'}" + ("" if d.has_domain_entry else "  undeclared"))
    return 0


class Explorer:
    """The explorer's state: a list of targets, one of them looked at in detail or not. Keys are up, down, enter, esc, backspace, q."""

    def __init__(self, targets: list[str]):
        self.targets, self.selected, self.detail, self.quit = targets, 0, None, False

    def key(self, key: str) -> None:
        if key == "q" or (key == "esc" and self.detail is None):
            self.quit = True
        elif self.detail is not None:
            if key in ("esc", "backspace"):
                self.detail = None
        elif key in ("up", "down") and self.targets:
            self.selected = (self.selected + (1 if key == "down" else -1)) % len(self.targets)
        elif key == "enter":
            self.detail = self.selected

    def lines(self, snapshots: dict) -> list[str]:
        if self.detail is None:
            return [("> " if i == self.selected else "  ") + t for i, t in enumerate(self.targets)]
        name = self.targets[self.detail]
        s = snapshots[name]
        return [f"{name} ({s.timestamp})"] + [f"  {f['name']}: {f['data_type']} {s.semantic_types.get(f['name'], '')}" for f in s.schema]


def explore(args) -> int:
    from driftline.plans.state import State

    load_config()
    state = State.load_or_default(state_path())
    if not state.snapshots:
        raise StateError("there are no snapshots yet: run apply before")
    app, keys = Explorer(sorted(state.snapshots)), {"j": "down", "k": "up", "": "enter", "b": "backspace"}
    print("\n".join(app.lines(state.snapshots)))
    while not app.quit and (line := sys.stdin.readline()):
        app.key(keys.get(line.strip(), line.strip()))
        print("\n".join(app.lines(state.snapshots)))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="driftline", description="Declarative data reliability on Spark")
    p.add_argument("-l", "--log-level", default="INFO", choices=["TRACE", "DEBUG", "INFO", "WARN", "ERROR"], type=str.upper)
    sub = p.add_subparsers(dest="command", required=True)

    def command(function, text, *options):
        c = sub.add_parser(function.__name__, help=text)
        c.set_defaults(run=function)
        for names, more in options:
            c.add_argument(*names, **more)

    reporting = [(("--out",), {}), (("--rename-threshold",), {"type": float}), (("--format",), {"choices": ["text", "json"], "default": "text"})]
    command(init, "start a project", (("name",), {}))
    command(apply, "take snapshots of the targets", (("--target",), {}), (("--as",), {"dest": "actor"}))
    command(plan, "show drift since the last apply", (("--target",), {}), *reporting)
    command(diff, "compare two datasets", (("left",), {}), (("right",), {}), *reporting)
    command(federate, "show drift by domain", (("--domain",), {}), *reporting)
    command(domains, "list domains and endpoints", (("--resolve",), {}), (("--with-targets",), {"action": "store_true"}), (("--missing-endpoint",), {"action": "store_true"}), reporting[2])
    command(explore, "look at snapshots")
    return p


def main(argv: list[str] | None = None) -> int:
    """0 if all is well, 1 on drift over the threshold or an error, 2 on wrong usage."""
    args = parser().parse_args(argv)
    import logging

    logging.basicConfig(level={"TRACE": "DEBUG", "WARN": "WARNING"}.get(args.log_level, args.log_level), force=True)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    try:
        return args.run(args)
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
