"""What several operators share: durable intermediate tables, Arrow batches, word hashes, components."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.rows import discard
from driftline.operators.rows import materialised as durable

__all__ = ["discard", "durable"]

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_C1 = np.uint64(0xBF58476D1CE4E5B9)
_C2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is written as a table and done with: it does so once the driver has no reference to it any more.
    Its scheduler keeps the last job's until another one comes."""
    spark.range(0, 1, 1, 1).count()
    gc.collect()
    spark._jvm.System.gc()


#: So many links are joined in one task, a few MB.
FEW = 50_000

_HELD: dict = {}


def held(owner, make):
    """What a worker process keeps from task to task for one owner at a time; the next owner's first task frees it."""
    if owner not in _HELD:
        _HELD.clear()
        _HELD[owner] = make()
    return _HELD[owner]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20, holding: bool = False) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about `limit` bytes of text, or one row: so very long texts don't meet in one.
    Unless the caller holds something itself, what the worker kept for another is freed."""
    if not holding:
        _HELD.clear()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64))
        at = 0
        while at < n:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """UTF-8 bytes of a string column; null stays None."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def seeded(seed: int) -> np.uint64:
    return np.uint64((int(_STEP) * (seed + 1)) & int(MASK))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def lower_words(text: bytes | None) -> list[bytes]:
    """Words of op8's contract: A-Z lower-cased, cut at U+0020 and U+0009 to U+000D."""
    return text.lower().split() if text else []


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each place at which n words start; with fewer words one for all, with none none."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix(out + seeded(k)) ^ words[k : len(words) - n + 1 + k]
    return mix(out ^ seeded(n))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): each node that has a link, with the smallest node it reaches.

    Alternating large-star and small-star steps: each halves the depth at least, no step gathers a component
    into one task beyond the star of one node, and only a count of changes comes to the driver. Once FEW links or less are left,
    one task joins them all: each step has a task for each partition, and what the driver keeps of tasks fills its memory.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, size = _counted(edges)
    while size[0] > FEW:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        old = edges
        edges, now = _counted(small)
        discard(old)
        if now == size:
            break
        size = now
    if size[0] <= FEW:
        return edges.coalesce(1).mapInArrow(_joined, "node bigint, component bigint")
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all links, by union and find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        at = parent.setdefault(x, x)
        while parent[at] != at:
            parent[at] = at = parent[parent[at]]
        parent[x] = at
        return at

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            u, v = root(a), root(b)
            parent[max(u, v)] = min(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in list(parent)], pa.int64())], names=["node", "component"])


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    edges = durable(edges)
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return edges, (row[0], row[1])
