"""A node's service: schema, diff, Merkle root and inclusion proofs of what a source holds; clients; reconciliation.

Five methods with plain dict messages. `serve` puts them behind HTTP and JSON with the standard library;
`RemoteNode` calls them there, and `Node` can be called as it is.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from driftline.errors import ConfigError, EngineError, IndexOutOfRange, SchemaError
from driftline.functions.types import own_metadata, parse_type, type_name
from driftline.operators.drift import ColumnDrift, SchemaDrift, SemanticDrift
from driftline.operators.merge import three_way_merge
from driftline.operators.merkle import InclusionProof, MerkleTree, ProofStep, Reconciliation, from_hex, root_of_records, verify_proof
from driftline.operators.profile import ColumnStats
from driftline.operators.rename import RenameOptions
from driftline.plans.config import Connection
from driftline.plans.diff import DiffReport, diff
from driftline.plans.state import Snapshot, capture, schema_from, schema_to
from driftline.sources.readers import Source, build_source

#: Meanings on the wire.
MEANINGS = ("UNKNOWN", "EMAIL", "CREDIT_CARD", "PHONE_NUMBER", "UUID", "IP_ADDRESS", "URL")
_OWN = ("Unknown", "Email", "CreditCard", "PhoneNumber", "UUID", "IPAddress", "Url")
STATUS = {"NOT_FOUND": 404, "INVALID_ARGUMENT": 400, "OUT_OF_RANGE": 416, "INTERNAL": 500}


def status_of(e: Exception) -> str:
    return "NOT_FOUND" if isinstance(e, SchemaError) else "INVALID_ARGUMENT" if isinstance(e, ConfigError) else "OUT_OF_RANGE" if isinstance(e, IndexOutOfRange) else "INTERNAL"


def meaning_to_wire(kind: str) -> str:
    return "SEMANTIC_TYPE_" + MEANINGS[_OWN.index(kind)]


def meaning_from_wire(text: str) -> str:
    name = text.removeprefix("SEMANTIC_TYPE_")
    if name not in MEANINGS:
        raise ConfigError(f"unknown semantic type '{text}'")
    return _OWN[MEANINGS.index(name)]


def report_to_wire(r: DiffReport) -> dict:
    """A report as a message; what spoke for a rename isn't sent."""
    out = r.to_dict()
    for x in out["schema_drift"]["renamed_fields"]:
        x.pop("signals", None)
    for d in out["semantic_drifts"]:
        d["source_type"], d["target_type"] = meaning_to_wire(d["source_type"]), meaning_to_wire(d["target_type"])
    return out


def report_from_wire(d: dict) -> DiffReport:
    try:
        schema = SchemaDrift(**{k: list(v) for k, v in d["schema_drift"].items()})
        meanings = [SemanticDrift(x["field_name"], meaning_from_wire(x["source_type"]), meaning_from_wire(x["target_type"])) for x in d["semantic_drifts"]]
        columns = {k: ColumnDrift(**c | {"source_stats": ColumnStats(**c["source_stats"]), "target_stats": ColumnStats(**c["target_stats"])}) for k, c in d["data_drift"]["column_drifts"].items()}
        return DiffReport(d["source_identifier"], d["target_identifier"], schema, meanings, columns)
    except (KeyError, TypeError) as e:
        raise ConfigError(f"a report lacks or has too much: {e}") from e


class Node:
    """The service over one source; both sides of a diff are its own."""

    METHODS = ("get_schema", "diff", "get_merkle_root", "get_inclusion_proof", "get_inclusion_proofs")

    def __init__(self, source: Source, order_by: dict[str, list[str]] | None = None):
        self.source, self.order_by = source, order_by or {}

    def tree(self, identifier: str) -> MerkleTree:
        return MerkleTree.of(self.source.data(identifier), self.order_by.get(identifier))

    def get_schema(self, identifier: str) -> dict:
        schema = self.source.schema(identifier)
        for f in schema.fields:
            parse_type(type_name(f))  # types that can't be read back aren't sent
        return {"schema": {"fields": [x | {"metadata": own_metadata(f)} for x, f in zip(schema_to(schema), schema.fields, strict=True)]}}

    def diff(self, source_identifier: str, target_identifier: str) -> dict:
        return {"report": report_to_wire(diff(self.source, source_identifier, self.source, target_identifier))}

    def get_merkle_root(self, identifier: str) -> dict:
        tree = self.tree(identifier)
        return {"root_hex": tree.root_hex, "leaf_count": tree.leaf_count}

    def get_inclusion_proof(self, identifier: str, leaf_index: int) -> dict:
        tree = self.tree(identifier)
        found = tree.proofs([leaf_index])[0]
        if found is None:
            raise IndexOutOfRange(f"row {leaf_index} was asked for, and there are {tree.leaf_count}")
        return _proof_to_wire(found)

    def get_inclusion_proofs(self, identifier: str, leaf_indices: list[int]) -> dict:
        """One tree for all indices; those beyond the rows are marked, not an error."""
        found = self.tree(identifier).proofs(leaf_indices)
        return {"proofs": [_proof_to_wire(f) if f else {"leaf_hex": "", "steps": []} for f in found], "found": [f is not None for f in found]}


def _proof_to_wire(found: tuple[bytes, InclusionProof]) -> dict:
    return {"leaf_hex": found[0].hex(), "steps": [{"sibling_hex": s.sibling, "sibling_is_left": s.sibling_is_left} for s in found[1].steps]}


def reconcile(node, identifier: str, local: MerkleTree) -> Reconciliation:
    """Compares a node's copy with ours by roots, then by proved leaves of the rows that both have. The node may be remote, even lying."""
    remote = node.get_merkle_root(identifier)
    if remote["root_hex"] == local.root_hex:
        return Reconciliation(True)
    root = from_hex(remote["root_hex"])
    if root is None:
        raise EngineError(f"the node's root is no hash: {remote['root_hex']}")
    n = min(local.leaf_count, int(remote["leaf_count"]))
    answer = node.get_inclusion_proofs(identifier, list(range(n)))
    if len(answer["proofs"]) != n or len(answer["found"]) != n:
        raise EngineError(f"{n} proofs were asked for, {len(answer['proofs'])} came")
    own = {r["idx"]: r["hash"] for r in local.leaf_frame.where(f"idx < {n}").toLocalIterator()}
    bad = []
    for i, (proof, found) in enumerate(zip(answer["proofs"], answer["found"], strict=True)):
        leaf = from_hex(proof["leaf_hex"]) if found else None
        if found and leaf is None:
            raise EngineError(f"the node's leaf is no hash: {proof['leaf_hex']}")
        steps = tuple(ProofStep(s["sibling_hex"], s["sibling_is_left"]) for s in proof["steps"])
        if not found or leaf.hex() != own[i] or not verify_proof(root, leaf, InclusionProof(i, steps)):
            bad.append(i)
    return Reconciliation(False, tuple(bad))


def serve(node: Node, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """An HTTP server for a node: POST /<method> with a JSON object of arguments. Call serve_forever on it."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            try:
                method = self.path.strip("/")
                if method not in Node.METHODS:
                    raise ConfigError(f"unknown method '{method}'")
                try:
                    arguments = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                    answer = getattr(node, method)(**arguments)
                except (ValueError, TypeError) as e:
                    raise ConfigError(f"bad arguments: {e}") from e
                self.answer(200, answer)
            except Exception as e:
                self.answer(STATUS[status_of(e)], {"status": status_of(e), "message": str(e)})

        def answer(self, code: int, body: dict):
            data = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)


class RemoteNode:
    """A node's methods over HTTP."""

    def __init__(self, endpoint: str, timeout_s: float = 600):
        self.endpoint, self.timeout_s = endpoint.rstrip("/"), timeout_s

    def _call(self, method: str, **arguments) -> dict:
        request = urllib.request.Request(f"{self.endpoint}/{method}", json.dumps(arguments).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout_s) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            body = json.loads(e.read() or b"{}")
            kind = {"NOT_FOUND": SchemaError, "INVALID_ARGUMENT": ConfigError, "OUT_OF_RANGE": IndexOutOfRange}.get(body.get("status"), EngineError)
            raise kind(body.get("message", str(e))) from e

    def get_schema(self, identifier: str) -> dict:
        return self._call("get_schema", identifier=identifier)

    def diff(self, source_identifier: str, target_identifier: str) -> dict:
        return self._call("diff", source_identifier=source_identifier, target_identifier=target_identifier)

    def get_merkle_root(self, identifier: str) -> dict:
        return self._call("get_merkle_root", identifier=identifier)

    def get_inclusion_proof(self, identifier: str, leaf_index: int) -> dict:
        return self._call("get_inclusion_proof", identifier=identifier, leaf_index=leaf_index)

    def get_inclusion_proofs(self, identifier: str, leaf_indices: list[int]) -> dict:
        return self._call("get_inclusion_proofs", identifier=identifier, leaf_indices=leaf_indices)


class Client:
    """Snapshots of one connection's datasets; the source is built when it is first needed."""

    def __init__(self, spark: SparkSession, connection: Connection):
        self.spark, self.connection, self._source = spark, connection, None

    @property
    def source(self) -> Source:
        if self._source is None:
            self._source = build_source(self.spark, self.connection)
        return self._source

    def snapshot(self, identifier: str, sample_n: int | None = None) -> Snapshot:
        return capture(self.source, identifier, sample_n)


def diff_connections(spark: SparkSession, a: Connection, a_id: str, b: Connection, b_id: str) -> DiffReport:
    return diff(build_source(spark, a), a_id, build_source(spark, b), b_id, RenameOptions())


# --- over plain lists, without a session


def infer_semantic(name: str, values: list[str | None]) -> str:
    """The meaning of a column from its name and values in memory."""
    import ipaddress
    import re

    from driftline.functions import semantic as s

    kind = s.from_name(name)
    if kind != s.UNKNOWN:
        return kind
    size = min(s.SAMPLE, len(values))
    sample = [v for k in range(size) if (v := values[k * len(values) // size]) is not None]

    def luhn(v: str) -> bool:
        digits = [int(c) for c in reversed(v)]
        return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0

    def ipv6(v: str) -> bool:
        try:
            return "%" not in v and bool(ipaddress.IPv6Address(v))
        except ValueError:
            return False

    def kind_of(v: str) -> str:
        for k, pattern in s.PATTERNS.items():
            x = re.sub("[ ()-]", "", v) if k == "PhoneNumber" and re.fullmatch("[0-9+ ()-]*", v) else v if k != "PhoneNumber" else ""
            if (re.fullmatch(pattern, x) and (k != "CreditCard" or luhn(v))) or (k == "IPAddress" and ipv6(v)):
                return k
        return s.UNKNOWN

    kinds = [kind_of(v) for v in sample]
    return s.winner(name, {k: kinds.count(k) for k in set(kinds)}, len(kinds))


def merkle_root(records: list[str]) -> str:
    return root_of_records([r.encode() for r in records]).hex()


def merge_schemas(base: list[dict], ours: list[dict], theirs: list[dict]) -> dict:
    """Three-way merge of lists of {name, data_type, nullable}."""
    result = three_way_merge(*map(schema_from, (base, ours, theirs)))
    return {"merged": schema_to(result.merged), "clean": result.is_clean, "conflicts": [asdict(c) for c in result.conflicts]}
