import json
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.errors import AccessDenied, ConfigError, IndexOutOfRange, NoEndpoint, SchemaError, StateError, UnknownDomain, UnsupportedDataType, UnsupportedStateVersion
from driftline.operators.merkle import MerkleTree, Reconciliation
from driftline.plans import cli, service
from driftline.plans.config import ACTOR, Connection, parse_config
from driftline.plans.diff import diff_frames, lines_of
from driftline.plans.governance import authorize_apply, list_domains, resolve_endpoint
from driftline.plans.state import Snapshot, State, capture, first_samples
from driftline.sources import readers as s

BASE = '[project]\nname = "p"\nversion = "1"\n[checks]\ndrift_threshold = 0.05\n'
FULL = BASE + '[connections.c]\ntype = "file"\nroot = "{root}"\n[targets.orders]\nconnection = "c"\nidentifier = "orders.parquet"\ndomain = "Sales"\nowner = "ann"\n[targets.misc]\nconnection = "c"\nidentifier = "misc.csv"\n[domains.sales]\noperators = ["ann"]\nendpoint = "http://h:1"\n[domains.empty]\n'


# --- configuration


@pytest.mark.parametrize("text", [
    "", "[project]\nname='p'", BASE + "[schema]\n", BASE + "x = 1\n", BASE.replace("0.05", "1.5"), BASE.replace("0.05", '"a"'), BASE + "rename_confidence_threshold = -1\n", BASE + "other = 1\n",
    BASE + '[targets.t]\nconnection = "no"\nidentifier = "x"\n', BASE + '[connections.c]\ntype = "ftp"\n', BASE + '[connections.c]\ntype = "postgres"\n', BASE + '[connections.c]\ntype = "s3"\nbucket = "b"\nregion = "r"\nformat = "orc"\n',
    BASE + '[domains.a]\nendpoint = "ftp://x"\n', BASE + '[domains.a]\nendpoint = "http://"\n', BASE + '[domains.a]\nendpoint = "http://a b"\n', BASE + '[domains.Sales]\n[domains." sales"]\n', BASE + '[domains.a]\noperators = [1]\n', "not toml",
])
def test_config_refused(text):
    with pytest.raises(ConfigError):
        parse_config(text)


def test_config():
    c = parse_config(FULL + '[connections.s]\ntype = "s3"\nbucket = "b"\nregion = "r"\n[targets.t]\nconnection = "s"\nidentifier = "k"\n[targets.t.sample]\nn = 0\n[targets.u]\nconnection = "s"\nidentifier = "k"\n[targets.u.sample]\nenabled = false\n')
    assert c.rename_confidence_threshold == 0.6 and c.targets["misc"].sample_n == 1000
    assert c.targets["t"].sample_n is None and c.targets["u"].sample_n is None
    assert c.find_domain(" SALES ")[0] == "sales" and c.find_domain("x") is None


def test_governance():
    c = parse_config(FULL + '[targets.z]\nconnection = "c"\nidentifier = "z"\ndomain = "Other"\n[targets.e]\nconnection = "c"\nidentifier = "z"\ndomain = "empty"\n')
    authorize_apply(c, "orders", c.targets["orders"], "ann")
    authorize_apply(c, "misc", c.targets["misc"], "bob")
    authorize_apply(c, "z", c.targets["z"], "bob")
    for name, actor in (("orders", "Ann"), ("orders", "bob"), ("e", "ann")):
        with pytest.raises(AccessDenied):
            authorize_apply(c, name, c.targets[name], actor)
    assert [(d.name, d.target_count, d.operator_count, d.has_domain_entry) for d in list_domains(c)] == [("Other", 1, 0, False), ("empty", 1, 0, True), ("sales", 1, 1, True)]
    assert resolve_endpoint(c, "SALES") == "http://h:1"
    with pytest.raises(NoEndpoint):
        resolve_endpoint(c, "other")
    with pytest.raises(UnknownDomain):
        resolve_endpoint(c, "nope")


# --- sources


def test_formats_and_identifiers():
    assert [s.format_of(x) for x in ("a.CSV", "a.ndjson", "a.Json", "a", "a.pq")] == ["csv", "json", "json", "parquet", "parquet"] and s.format_of("a.csv", "json") == "json"
    assert [s.split_identifier(x) for x in ("users", "a.b", r"weird\.table", r"a\b")] == [("public", "users"), ("a", "b"), ("public", "weird.table"), ("public", r"a\b")]
    for bad in ("a.b.c", "", "a.", ".b"):
        with pytest.raises(ConfigError):
            s.split_identifier(bad)
    assert s.quoted("a", 'b"c') == '"a"."b""c"'
    o = s.PostgresSource(None, "postgres://u:p%40w@h:5/db?sslmode=require", ("id", 0, 100, 4)).options("t")
    assert o["url"] == "jdbc:postgresql://h:5/db?sslmode=require" and (o["user"], o["password"], o["dbtable"], o["numPartitions"]) == ("u", "p@w", '"public"."t"', "4")
    assert "table_name = 'o''x'" in s.PostgresSource(None, "").catalog_query("o'x")
    with pytest.raises(SchemaError):
        s.schema_of_catalog("t", [])
    schema = s.schema_of_catalog("t", [("id", "bigint", "NO", None, None), ("n", "numeric", "YES", 10, 2)])
    assert schema.simpleString() == "struct<id:bigint,n:decimal(10,2)>" and not schema["id"].nullable
    with pytest.raises(ConfigError):
        s.build_source(None, Connection("ftp"))
    assert isinstance(s.FileSource(None), s.Source)


@pytest.mark.parametrize("text,rows", [('{"id":1,"name":"a"}\n{"id":2,"name":null}\n', 2), ('\n  [{"id":1,"name":"a"},\n {"id":2,"name":"b"}]', 2), ("[]", 0)])
def test_json(spark, tmp_path, text, rows):
    (tmp_path / "x.json").write_text(text)
    assert s.FileSource(spark, str(tmp_path)).data("x.json").count() == rows


def test_csv_with_a_line_end_within_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note,amount\n1,"two\nlines",2.5\n2,plain,3\n')
    df = s.FileSource(spark, str(tmp_path)).data("a.csv")
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("id", "bigint"), ("note", "string"), ("amount", "double")]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "two\nlines", 2.5), (2, "plain", 3.0)]


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,name,score\n1,a,1.5\n2,b,2\n")
    df = s.FileSource(spark, str(tmp_path)).data("x.csv")
    assert df.schema.simpleString() == "struct<id:bigint,name:string,score:double>" and df.count() == 2
    (tmp_path / "y.csv").write_text("id\n" + "1\n" * 150 + "oops\n")
    with pytest.raises(Exception, match="(?i)malformed|CAST|parse"):
        s.FileSource(spark, str(tmp_path)).data("y.csv").collect()


# --- state


def test_state(tmp_path):
    snap = Snapshot([{"name": "a", "data_type": "Int32", "nullable": True}], {}, {"a": "Unknown"}, {"a": [1.0]}, "t")
    path = tmp_path / "d" / "state.json"
    jobs = [threading.Thread(target=State({f"t{k}": snap}).save, args=(path,)) for k in range(8)]
    [j.start() for j in jobs]
    [j.join() for j in jobs]
    assert set(State.load(path).snapshots) == {f"t{k}" for k in range(8)}
    assert State.load(path).snapshots["t3"] == snap
    path.write_text('{"schema_version": 99, "snapshots": {}}')
    with pytest.raises(UnsupportedStateVersion):
        State.load(path)
    path.write_text("nonsense")
    with pytest.raises(StateError):
        State.load_or_default(path)
    assert State.load_or_default(tmp_path / "none").snapshots == {}


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}@x.com", float("nan") if i == 1 else None if i == 2 else i / 2) for i in range(10)], "v int, contact string, f double")
    df.coalesce(1).write.parquet(f"{tmp_path}/x.parquet")
    snap = capture(s.FileSource(spark, str(tmp_path)), "x.parquet", 3)
    assert snap.semantic_types == {"v": "Unknown", "contact": "Email", "f": "Unknown"} and snap.column_stats["f"].null_count == 1
    assert snap.samples == {"v": [0, 1, 2], "f": [0.0, 1.5, 2.0]}
    assert capture(s.FileSource(spark, str(tmp_path)), "x.parquet", None).samples is None
    assert first_samples(df.select(F.col("v").cast("byte")), 3, ["v"]) == {}
    with pytest.raises(UnsupportedDataType):
        Snapshot([{"name": "a", "data_type": "array<int>", "nullable": True}], {}, {}, None, "t").struct()


# --- diffs and the command line


def test_diff(spark):
    a = spark.createDataFrame([(i, f"u{i}@x.com") for i in range(5)], "id int, email string")
    report = diff_frames(a, a.withColumnRenamed("email", "email_address"))
    assert [(r["from"], r["to"]) for r in report.schema_drift.renamed_fields] == [("email", "email_address")] and not report.schema_drift.added_fields
    report = diff_frames(spark.createDataFrame([(1, "alice")], "id int, name string"), spark.createDataFrame([(1, "a@x.com")], "id bigint, email string"))
    d = report.schema_drift
    assert (d.added_fields, d.removed_fields, d.renamed_fields, d.changed_types[0]["field_name"]) == (["email"], ["name"], [], "id")
    assert any("id was Int32, is Int64" in x for x in lines_of(report))
    empty = diff_frames(a.limit(0), a)
    assert empty.column_drifts == {} and empty.semantic_drifts == []


@pytest.fixture
def project(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv(ACTOR, raising=False)
    (tmp_path / "driftline.toml").write_text(FULL.format(root=tmp_path))

    def orders(shift):
        spark.range(200).select("id", (F.col("id") * 1.5 + shift).alias("price"), F.concat(F.lit("u"), "id", F.lit("@x.com")).alias("contact")).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")

    orders(0)
    (tmp_path / "misc.csv").write_text("k\n1\n2\n")
    return orders


def test_apply_and_plan(project, capsys):
    assert cli.main(["plan"]) == 1 and "run apply before" in capsys.readouterr().err
    assert cli.main(["apply"]) == 1 and "takes an operator" in capsys.readouterr().err
    assert cli.main(["apply", "--as", "bob"]) == 1 and "may not apply" in capsys.readouterr().err
    assert cli.main(["apply", "--target", "no"]) == 1
    assert cli.main(["apply", "--as", "ann"]) == 0 and "applied: misc, orders" in capsys.readouterr().out
    assert cli.main(["plan"]) == 0
    project(1000)
    assert cli.main(["plan", "--format", "json", "--out", "p/x.json"]) == 1
    said = capsys.readouterr()
    assert "orders.parquet:price" in said.err
    assert json.loads(open("p/x.json").read())[1]["target_identifier"] == "orders.parquet"
    assert cli.main(["plan", "--rename-threshold", "2"]) == 1
    assert cli.main(["plan", "--target", "misc"]) == 0
    capsys.readouterr()
    assert cli.main(["federate"]) == 1
    out = capsys.readouterr().out
    assert out.index("[Sales]") < out.index("[no domain]") and "  owner ann" in out
    assert cli.main(["federate", "--domain", "SALES"]) == 1 and cli.main(["federate", "--domain", "empty"]) == 0 and cli.main(["federate", "--domain", "zzz"]) == 1


def test_diff_command(project, capsys):
    assert cli.main(["diff", "orders", "c:orders.parquet"]) == 0
    assert cli.main(["diff", "orders", "x:orders.parquet"]) == 1 and "no connection is named 'x'" in capsys.readouterr().err
    assert cli.main(["diff", "orders", "nothing"]) == 1
    assert cli.main(["diff", "orders", "misc", "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["schema_drift"]["added_fields"] == ["k"]


def test_domains_command(project, capsys):
    assert cli.main(["domains"]) == 0
    assert "sales  targets=1  operators=1  endpoint=http://h:1" in capsys.readouterr().out
    assert cli.main(["domains", "--resolve", "Sales"]) == 0 and capsys.readouterr().out == "http://h:1\n"
    assert cli.main(["domains", "--resolve", "empty"]) == 1
    assert cli.main(["domains", "--missing-endpoint", "--format", "json"]) == 0
    assert [d["name"] for d in json.loads(capsys.readouterr().out.strip())] == ["empty"]


def test_init(tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["init", 'a"\n[x]']) == 0
    assert parse_config((tmp_path / "driftline.toml").read_text()).name == 'a"\n[x]'
    assert cli.main(["init", "b"]) == 1 and "there is a driftline.toml" in capsys.readouterr().err
    assert cli.main(["plan"]) == 1 and cli.main(["explore"]) == 1
    assert cli.main(["domains"]) == 0
    with pytest.raises(SystemExit):
        cli.main(["nothing"])


def test_explorer():
    app = cli.Explorer(["a", "b"])
    app.key("up")
    assert app.selected == 1
    app.key("down")
    app.key("enter")
    assert app.detail == 0
    app.key("up")
    app.key("esc")
    assert app.detail is None and not app.quit
    app.key("esc")
    assert app.quit


# --- the service


class Tables:
    def __init__(self, frames):
        self.frames = frames

    def data(self, identifier):
        if identifier not in self.frames:
            raise SchemaError(f"table '{identifier}' not found")
        return self.frames[identifier]

    def schema(self, identifier):
        return self.data(identifier).schema


@pytest.fixture(scope="module")
def node(spark):
    rows = [(0, "a@x.com"), (1, "b@x.com"), (2, "c@x.com")]
    frames = {"t": spark.createDataFrame(rows, "id int, email string"), "list": spark.createDataFrame([([1],)], "x array<int>"), "renamed": spark.createDataFrame(rows, "id bigint, email_address string")}
    return service.Node(Tables(frames), {"t": ["id"]})


def local(spark, rows):
    return MerkleTree.of(spark.createDataFrame(rows, "id int, email string"), ["id"])


def test_service_over_http(spark, node):
    server = service.serve(node)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        remote = service.RemoteNode(f"http://127.0.0.1:{server.server_port}")
        assert [f["data_type"] for f in remote.get_schema("t")["schema"]["fields"]] == ["Int32", "Utf8"]
        report = service.report_from_wire(remote.diff("t", "renamed")["report"])
        assert report.schema_drift.renamed_fields == [{"from": "email", "to": "email_address", "confidence": pytest.approx(report.schema_drift.renamed_fields[0]["confidence"])}]
        assert service.reconcile(remote, "t", local(spark, [(0, "a@x.com"), (1, "b@x.com"), (2, "c@x.com")])) == Reconciliation(True)
        assert service.reconcile(remote, "t", local(spark, [(0, "x"), (1, "b@x.com"), (2, "y")])) == Reconciliation(False, (0, 2))
        assert service.reconcile(remote, "t", local(spark, [(0, "a@x.com"), (1, "b@x.com")])) == Reconciliation(False, ())
        assert remote.get_inclusion_proofs("t", [1, 9])["found"] == [True, False]
        for call, error in ((lambda: remote.get_schema("no"), SchemaError), (lambda: remote.get_inclusion_proof("t", 3), IndexOutOfRange), (lambda: remote._call("nope"), ConfigError), (lambda: remote._call("get_schema", x=1), ConfigError)):
            with pytest.raises(error):
                call()
    finally:
        server.shutdown()


def test_a_lying_node(spark, node):
    class Liar(service.Node):
        def get_inclusion_proofs(self, identifier, leaf_indices):
            out = super().get_inclusion_proofs(identifier, leaf_indices)
            out["proofs"][1]["leaf_hex"] = "00" * 32
            return out

    rows = [(0, "changed"), (1, "b@x.com"), (2, "c@x.com")]
    assert service.reconcile(Liar(node.source, node.order_by), "t", local(spark, rows)) == Reconciliation(False, (0, 1))


def test_wire(node):
    with pytest.raises(UnsupportedDataType):
        node.get_schema("list")
    assert service.meaning_from_wire(service.meaning_to_wire("IPAddress")) == "IPAddress"
    for bad in ({}, {"source_identifier": "a"}):
        with pytest.raises(ConfigError):
            service.report_from_wire(bad)
    with pytest.raises(ConfigError):
        service.meaning_from_wire("SEMANTIC_TYPE_UNSPECIFIED")
    assert service.merkle_root(["a", "b"]) != service.merkle_root(["b", "a"])


def test_client(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/x.parquet")
    client = service.Client(spark, Connection("file", root=str(tmp_path)))
    assert client.snapshot("x.parquet", 2).samples == {"id": [0.0, 1.0]}
    report = service.diff_connections(spark, Connection("file", root=str(tmp_path)), "x.parquet", Connection("file"), f"{tmp_path}/x.parquet")
    assert report.column_drifts["id"].ks_statistic == 0.0
    assert isinstance(client.source.schema("x.parquet"), T.StructType)
