"""Merkle commitments to a dataset's rows, inclusion proofs, and reconciliation of copies.

A leaf is SHA-256 of 00 and the row, a node of 01 and its two children; the last node of an odd level moves up as it is. The
tree is kept in storeys of 2^STEP leaves a chunk: a chunk's nodes lie under one of them, so a storey is one shuffle
and a chunk is of bounded size. A trillion rows take four storeys instead of forty levels.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.errors import IndexOutOfRange
from driftline.operators.profile import col
from driftline.operators.rows import INDEX, indexed, materialised

LEAF, NODE, STEP = b"\x00", b"\x01", 10


def hash_leaf(data: bytes) -> bytes:
    return hashlib.sha256(LEAF + data).digest()


def hash_nodes(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(NODE + left + right).digest()


def to_hex(digest: bytes) -> str:
    return digest.hex()


def from_hex(text: str) -> bytes | None:
    """The 32 bytes of 64 hex digits, else None."""
    if len(text) != 64 or any(c not in "0123456789abcdefABCDEF" for c in text):
        return None
    return bytes.fromhex(text)


def level_above(level: list[bytes]) -> list[bytes]:
    pairs = [hash_nodes(a, b) for a, b in zip(level[::2], level[1::2], strict=False)]
    return pairs + level[-1:] if len(level) % 2 else pairs


def root_of_records(records: list[bytes]) -> bytes:
    """The root over records in memory."""
    level = [hash_leaf(r) for r in records]
    while len(level) > 1:
        level = level_above(level)
    return level[0] if level else hashlib.sha256(b"").digest()


@dataclass(frozen=True)
class ProofStep:
    sibling: str
    sibling_is_left: bool


@dataclass(frozen=True)
class InclusionProof:
    leaf_index: int
    steps: tuple[ProofStep, ...]


def verify_proof(root: bytes, leaf: bytes, proof: InclusionProof) -> bool:
    """Whether the leaf leads to the root by the proof's siblings. The index isn't part of what is proved."""
    now = leaf
    for step in proof.steps:
        sibling = from_hex(step.sibling)
        if sibling is None:
            return False
        now = hash_nodes(sibling, now) if step.sibling_is_left else hash_nodes(now, sibling)
    return now == root


def display(f: T.StructField) -> Column:
    """A value's canonical text: Spark's, with ISO 8601 timestamps; null is empty."""
    text = col(f.name).cast("string")
    if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
        text = F.replace(text, F.lit(" "), F.lit("T"))
    if isinstance(f.dataType, T.BinaryType):
        text = F.lower(F.hex(col(f.name)))
    return F.coalesce(text, F.lit(""))


def _framed(text: Column) -> Column:
    """The text's UTF-8 bytes behind their number as four bytes, least first: so no two rows of fields look alike."""
    data = F.encode(text, "UTF-8")
    digits = F.lpad(F.hex(F.octet_length(data)), 8, "0")
    return F.concat(F.unhex(F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)])), data)


def row_hash(schema: T.StructType) -> Column:
    """The leaf hash of a row, as hex."""
    data = F.concat(*[_framed(display(f)) for f in schema.fields]) if schema.fields else F.lit(b"")
    return F.sha2(F.concat(F.lit(LEAF), data), 256)


def leaves(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """idx, hash for each row, in row order."""
    return indexed(df, order_by).select(F.col(INDEX).alias("idx"), row_hash(df.schema).alias("hash"))


def _chunk_root(hashes: Column) -> Column:
    """The node over an ordered array of at most 2^STEP hashes."""

    def above(level: Column) -> Column:
        def pair(j: Column) -> Column:
            left, right = F.get(level, 2 * j), F.get(level, 2 * j + 1)
            return F.when(right.isNull(), left).otherwise(F.sha2(F.concat(F.lit(NODE), F.unhex(left), F.unhex(right)), 256))

        return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), pair)

    return F.get(F.aggregate(F.sequence(F.lit(1), F.lit(STEP)), hashes, lambda level, _: above(level)), F.lit(0))


class MerkleTree:
    """A tree over a frame of leaves (idx from 0 without gaps, hash)."""

    def __init__(self, leaf_frame: DataFrame):
        self.storeys = [materialised(leaf_frame)]
        self.leaf_count = n = self.storeys[0].count()
        while n > 1:
            chunk = F.shiftright("idx", STEP)
            ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"])
            self.storeys.append(materialised(self.storeys[-1].groupBy(chunk.alias("idx")).agg(_chunk_root(ordered).alias("hash"))))
            n = -(-n >> STEP) if n % (1 << STEP) == 0 else (n >> STEP) + 1
        top = self.storeys[-1].first()
        self.root_hex = top["hash"] if top else hashlib.sha256(b"").hexdigest()

    @classmethod
    def of(cls, df: DataFrame, order_by: list[str] | None = None) -> MerkleTree:
        return cls(leaves(df, order_by))

    @property
    def root(self) -> bytes:
        return bytes.fromhex(self.root_hex)

    @property
    def leaf_frame(self) -> DataFrame:
        return self.storeys[0]

    def leaf(self, index: int) -> bytes | None:
        row = self.storeys[0].where(F.col("idx") == index).first() if 0 <= index < self.leaf_count else None
        return bytes.fromhex(row["hash"]) if row else None

    def proof(self, index: int) -> InclusionProof | None:
        found = self.proofs([index])[0]
        return found[1] if found else None

    def proofs(self, indices: list[int]) -> list[tuple[bytes, InclusionProof] | None]:
        """Leaf and proof for each index, None beyond the rows. One job a storey fetches the chunks that are needed."""
        good = sorted({i for i in indices if 0 <= i < self.leaf_count})
        steps: dict[int, list[ProofStep]] = {i: [] for i in good}
        own: dict[int, bytes] = {}
        for storey, frame in enumerate(self.storeys[: max(1, len(self.storeys) - 1)]):
            at = {i: i >> (STEP * storey) for i in good}
            chunks = self._chunks(frame, sorted({a >> STEP for a in at.values()}))
            levels: dict[int, list[list[bytes]]] = {}
            for i, a in at.items():
                chunk = a >> STEP
                if chunk not in levels:
                    levels[chunk] = [chunks[chunk]]
                    while len(levels[chunk][-1]) > 1:
                        levels[chunk].append(level_above(levels[chunk][-1]))
                place = a & ((1 << STEP) - 1)
                if not storey:
                    own[i] = chunks[chunk][place]
                for level in levels[chunk][:-1]:
                    beside = place ^ 1
                    if beside < len(level):
                        steps[i].append(ProofStep(level[beside].hex(), beside < place))
                    place >>= 1
        return [(own[i], InclusionProof(i, tuple(steps[i]))) if i in own else None for i in indices]

    def _chunks(self, frame: DataFrame, wanted: list[int]) -> dict[int, list[bytes]]:
        out: dict[int, list[bytes]] = {c: [] for c in wanted}
        for at in range(0, len(wanted), 500):  # as many hashes at a time as 500 chunks have
            for r in frame.where(F.shiftright("idx", STEP).isin(wanted[at : at + 500])).orderBy("idx").collect():
                out[r["idx"] >> STEP].append(bytes.fromhex(r["hash"]))
        return out


def divergent_rows(ours: MerkleTree, theirs: MerkleTree) -> DataFrame:
    """idx of the rows that differ, up to the shorter side's length. Chunks with equal nodes aren't looked into."""
    a, b = ours.leaf_frame, theirs.leaf_frame
    if len(ours.storeys) > 2 and len(theirs.storeys) > 2:
        same = ours.storeys[1].join(theirs.storeys[1], ["idx", "hash"]).select(F.col("idx").alias("chunk"))
        a, b = (x.withColumn("chunk", F.shiftright("idx", STEP)).join(same, "chunk", "left_anti").drop("chunk") for x in (a, b))
    return a.withColumnRenamed("hash", "ours").join(b.withColumnRenamed("hash", "theirs"), "idx").where("ours <> theirs").select("idx")


@dataclass(frozen=True)
class Reconciliation:
    in_sync: bool
    divergent: tuple[int, ...] = ()


def reconcile_trees(ours: MerkleTree, theirs: MerkleTree) -> Reconciliation:
    """Two trees of one cluster: equal roots, or the rows that differ. Sides of different lengths are never in sync."""
    if ours.root_hex == theirs.root_hex:
        return Reconciliation(True)
    return Reconciliation(False, tuple(sorted(r["idx"] for r in divergent_rows(ours, theirs).collect())))
