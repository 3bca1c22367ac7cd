import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from driftline.errors import SchemaError
from driftline.operators import merkle as m
from driftline.operators.rows import indexed, running_sums


def tree_of(spark, n, order=None):
    return m.MerkleTree.of(spark.createDataFrame([(i, f"r{i}") for i in range(n)], "id int, name string"), ["id"])


def rows_root(rows):
    return m.root_of_records([b"".join(struct.pack("<I", len(x.encode())) + x.encode() for x in row) for row in rows]).hex()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 31, 1023, 1024, 1025, 2049, 3000])
def test_root_and_proofs(spark, n):
    tree = tree_of(spark, n)
    assert (tree.root_hex, tree.leaf_count) == (rows_root([(str(i), f"r{i}") for i in range(n)]), n)
    wanted = sorted({0, n // 2, max(0, n - 1), n, -1})
    for i, found in zip(wanted, tree.proofs(wanted), strict=True):
        if 0 <= i < n:
            leaf, proof = found
            assert leaf == tree.leaf(i) and m.verify_proof(tree.root, leaf, proof)
            assert not m.verify_proof(tree.root, m.hash_leaf(b"forged"), proof)
        else:
            assert found is None and tree.leaf(i) is None


def test_values():
    assert m.root_of_records([]) == hashlib.sha256(b"").digest()
    assert m.root_of_records([b"only"]) == m.hash_leaf(b"only")
    assert m.root_of_records([b"a", b"b"]) != m.root_of_records([b"b", b"a"])
    assert m.from_hex("zz") is None and m.from_hex("AB" * 32) == bytes.fromhex("ab" * 32) and m.from_hex(" " + "a" * 63) is None
    bad = m.InclusionProof(0, (m.ProofStep("nothex", True),))
    assert not m.verify_proof(b"", b"", bad)


def test_fields_do_not_run_together(spark):
    def root(*rows):
        return m.MerkleTree.of(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name string, note string"), ["i"]).root_hex

    assert root(("Alice\x1f", "Bob")) != root(("Alice", "\x1fBob"))
    assert root(("é" * 200, "x")) == rows_root([("0", "é" * 200, "x")])
    assert root((None, "x")) == root(("", "x"))


def test_display(spark):
    df = spark.sql("select timestamp_ntz'2024-01-02 03:04:05' t, true b, 1.5d d, date'2024-01-02' e, cast('x' as binary) y, null n")
    assert df.select(*[m.display(f).alias(f.name) for f in df.schema.fields]).first() == ("2024-01-02T03:04:05", "true", "1.5", "2024-01-02", "78", "")


def test_reconcile(spark):
    ours = tree_of(spark, 2500)
    same = tree_of(spark, 2500)
    base = spark.createDataFrame([(i, f"r{i}") for i in range(2500)], "id int, name string")
    other = m.MerkleTree.of(base.withColumn("name", F.when(F.col("id").isin(7, 2400), "x").otherwise(F.col("name"))), ["id"])
    assert m.reconcile_trees(ours, same) == m.Reconciliation(True)
    assert m.reconcile_trees(ours, other) == m.Reconciliation(False, (7, 2400))
    assert m.reconcile_trees(ours, tree_of(spark, 10)) == m.Reconciliation(False, ())


def test_row_order(spark, tmp_path):
    spark.range(5000).withColumn("k", F.col("id") * 7 % 5000).repartition(6).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    by_file = indexed(df).select("__row").collect()
    assert sorted(r[0] for r in by_file) == list(range(5000))
    assert sorted(r["__row"] for r in indexed(df.where("k % 3 = 0")).collect()) == list(range(1667))
    by_key = indexed(df, ["k"]).select("k", "__row").collect()
    assert all(r[0] == r[1] for r in by_key)
    df.orderBy("id").coalesce(3).write.csv(f"{tmp_path}/c")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    by_block = indexed(spark.read.csv(f"{tmp_path}/c", schema="id int, k int")).select("id", "__row").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r[0] == r[1] for r in by_block) and len(by_block) == 5000
    with pytest.raises(SchemaError):
        indexed(spark.range(3).groupBy("id").count())


def test_running_sums(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("c"), F.col("id").alias("v"), F.lit(1).alias("s"))
    got = running_sums(df, ["c"], "v", ["s"]).collect()
    assert all(r["cum_s"] == r["v"] // 3 + 1 for r in got) and len(got) == 1000
