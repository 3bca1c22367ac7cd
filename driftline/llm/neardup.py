"""Operator 8, near-duplicates: fast similarity sketches, banding, exact confirmation, components.

A sketch has `coords` coordinates. Round i < coords throws every shingle into a hashed coordinate with the value
(i, hash); round coords + j puts every shingle into coordinate j. The smallest value stays, and rounds end when
every coordinate is filled: after one or a few for long texts, after 2 * coords at the latest. The share of equal
coordinates of two sketches is concentrated about the Jaccard similarity as with independent min-hashes.

Texts of one and the same shingle set form a class (a 128-bit hash of the set), and one document stands for it.
Classes that share a band are candidates. A bucket of m classes never gives all its m * (m - 1) / 2 pairs: in each
round some of its classes are pivots (one, then 16, 256 ...), each is compared with those of the bucket that are not yet in
its component, and then leaves the bucket. Pairs are confirmed on their full shingle sets, found links merge
components, and rounds go on until no bucket holds two components. Classes that share several buckets meet in one of them. So no candidate is left untested unless both
are already known to be connected.

Defined results: a null or wordless text has no shingles and no links by its text; rows that share a doc_id are
one node; a null doc_id is no node, its component_id and kept are null; an empty table gives no rows; ties go to
the smaller doc_id; of further columns none is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import components, discard, durable, lower_words, mix, release, seeded, shingle_hashes, slices, texts_of, word_hashes

COORDS, BAND_ROWS = 96, 4
_LOW, _HIGH, _FULL = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes."""
    return np.unique(shingle_hashes(word_hashes(lower_words(text)), n))


def fast_similarity_sketch(shingles: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """One value for each coordinate; `shingles` mustn't be empty."""
    out = np.full(coords, _FULL)
    for i in range(2 * coords):
        x = mix(shingles ^ seeded(i))
        value = (np.uint64(i) << _HIGH) | (x & _LOW)
        if i < coords:
            np.minimum.at(out, ((x >> _HIGH) % np.uint64(coords)).astype(np.intp), value)
        elif out[i - coords] == _FULL:
            out[i - coords] = value.min()
        if (i < coords or i == 2 * coords - 1) and not (out == _FULL).any():
            break
    return out


def band_keys(sketch: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    bands = sketch.reshape(-1, rows)
    key = np.arange(len(bands), dtype=np.uint64)
    for k in range(rows):
        key = mix(key + seeded(k)) ^ bands[:, k]
    return mix(key).view(np.int64)


BITS, SIGMAS = 1024, 5
_BIT_COLUMNS = [f"b{k}" for k in range(BITS // 64)]


def with_bits(bodies: DataFrame, n: int) -> DataFrame:
    """id, text and a sketch of BITS coordinates, one bit of each: two texts of similarity s differ in (1 - s) / 2 of them."""
    schema = "id bigint, text string, " + ", ".join(f"{b} bigint" for b in _BIT_COLUMNS)

    def run(batches):
        for batch in slices(batches, "text"):
            rows = []
            for text in texts_of(batch, "text"):
                own = shingle_set(text, n)
                sketch = mix(fast_similarity_sketch(own, BITS)) >> np.uint64(63) if len(own) else np.zeros(BITS)
                rows.append(np.packbits(sketch.astype(bool)).view(np.int64))
            columns = np.array(rows, np.int64).reshape(batch.num_rows, -1).T
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), *map(pa.array, columns)], names=["id", "text", *_BIT_COLUMNS])

    return bodies.where("text is not null").mapInArrow(run, schema)


def most_differing(percent: int) -> int:
    """More bits than this don't differ between texts of the similarity, SIGMAS standard deviations allowed for."""
    q = (1 - percent / 100) / 2
    return int(BITS * q + SIGMAS * (BITS * q * (1 - q)) ** 0.5)


def own_shingles(bodies: DataFrame, n: int) -> DataFrame:
    """id, own: how many shingles of each text stand in no other. Counted over all bodies; what a batch holds twice is told apart there."""

    def run(batches):
        for batch in slices(batches, "text"):
            sets = [shingle_set(t, n) for t in texts_of(batch, "text")]
            ids = np.repeat(np.array(batch.column("id").to_pylist(), np.int64), [len(x) for x in sets])
            key, first, times = np.unique(np.concatenate(sets), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[first], mask=times > 1)], names=["key", "id"])

    once = bodies.mapInArrow(run, "key bigint, id bigint").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id"))
    return once.where("n = 1 and id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("own"))


ROWS = "doc_id bigint, n_shingles bigint, set_hi bigint, set_lo bigint, bands array<bigint>"


def sketched(docs: DataFrame, n: int, coords: int, rows: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches, "text"):
            size, hi, lo, keys = [], [], [], []
            for text in texts_of(batch, "text"):
                own = shingle_set(text, n)
                size.append(len(own))
                if len(own):
                    digest = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                    hi.append(int(digest[0]))
                    lo.append(int(digest[1]))
                    keys.append(band_keys(fast_similarity_sketch(own, coords), rows))
                else:
                    hi.append(None)
                    lo.append(None)
                    keys.append([])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=[x.split()[0] for x in ROWS.split(", ")])

    return docs.mapInArrow(run, ROWS)


def confirmed(pairs: DataFrame, bodies: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose texts have 100 * intersection >= percent * union of shingles."""

    def run(batches):
        last, own = None, None
        for batch in slices(batches, "b_text", 1 << 20):
            a, b = batch.column("a"), batch.column("b")
            left, right = texts_of(batch, "a_text"), texts_of(batch, "b_text")
            good = []
            for x, y in zip(left, right, strict=True):
                if x != last:
                    last, own = x, shingle_set(x, n)
                other = shingle_set(y, n)
                both = len(np.intersect1d(own, other, assume_unique=True))
                good.append(100 * both >= percent * (len(own) + len(other) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = (bodies.select(F.col("id").alias(k), F.col("text").alias(f"{k}_text")) for k in "ab")
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "a_text", "b_text")
    return joined.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, coords: int = COORDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = durable(sketched(docs, n, coords, rows))
    some = table.where("n_shingles > 0 and doc_id is not null")
    classes = durable(some.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("size"), F.min_by("bands", "doc_id").alias("bands")))
    named = some.select("doc_id", "set_hi", "set_lo").join(classes.select("set_hi", "set_lo", "id"), ["set_hi", "set_lo"]).select("doc_id", "id").distinct()
    named = durable(named)  # the nodes and the class each belongs to

    # rows that share a doc_id but not a text are one node: their classes are connected from the start
    first = named.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("doc_id", "a")
    labels = durable(components(named.join(first, "doc_id").select("a", F.col("id").alias("b"))))

    slots = classes.select("id", "size", F.explode("bands").alias("key"))
    full = slots.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("key")
    members = slots.join(full, "key").join(labels.withColumnRenamed("node", "id"), "id", "left")
    members = durable(members.select("key", "id", "size", F.coalesce("component", "id").alias("component")))
    bodies = docs.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id").select(F.col("doc_id").alias("id"), "text")
    bodies = durable(with_bits(bodies.where(F.length(F.trim("text")) > 0), n))
    several = classes.groupBy("id").count().where("count > 1")
    own = own_shingles(bodies.select("id", "text"), n).join(several, "id", "left_anti")
    bits = bodies.join(several, "id", "left_anti").select("id", *_BIT_COLUMNS).join(classes.select("id"), "id", "left_semi").groupBy("id").agg(*[F.min(b).alias(b) for b in _BIT_COLUMNS])
    known = durable(bits.join(own, "id", "left"))
    found = members
    keys = members.groupBy("id").agg(F.collect_set("key").alias("keys"))  # a key for each band at most
    members = members.join(known, "id", "left").join(keys, "id").select("key", "id", "size", F.coalesce("own", F.lit(0)).alias("own"), *_BIT_COLUMNS, "keys", "component")
    members = durable(members.where((F.col("size") - F.col("own")) * 100 >= F.col("size") * percent))  # the others can't have a link
    discard(found)
    step = 0
    release(docs.sparkSession)
    while not members.isEmpty():
        slot = F.pmod(F.xxhash64("id"), F.lit(1 << min(4 * step, 20)))
        pivots = durable(members.groupBy("key", slot.alias("slot")).agg(F.min(F.struct("own", "id", "size", "component", *_BIT_COLUMNS, "keys")).alias("p")).select("key", "p.*"))
        met = members.alias("m").join(pivots.alias("p"), "key").where("m.component <> p.component and m.id <> p.id")
        most = F.least(F.col("m.size") - F.col("m.own"), F.col("p.size") - F.col("p.own"))  # shingles that they can share
        met = met.where(most * 100 >= (F.col("m.size") + F.col("p.size") - most) * percent)
        differing = sum((F.bit_count(F.col(f"m.{b}").bitwiseXOR(F.col(f"p.{b}"))) for b in _BIT_COLUMNS), F.lit(0))
        met = met.where(F.coalesce(differing, F.lit(0)) <= most_differing(percent))
        met = met.where(F.array_min(F.array_intersect("m.keys", "p.keys")) == F.col("key"))  # of the buckets that two share, the first is theirs
        met = met.select(F.least("m.id", "p.id").alias("a"), F.greatest("m.id", "p.id").alias("b")).distinct()
        pairs = durable(met)
        links = durable(confirmed(pairs, bodies, n, percent))
        linked = not links.isEmpty()
        if linked:  # components of components
            ends = links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
            merged = durable(components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))))
            old = labels.join(merged.select(F.col("node").alias("component"), F.col("component").alias("new")), "component", "left").select("node", F.coalesce("new", "component").alias("component"))
            before, labels = labels, durable(old.union(merged.join(labels.select("node"), "node", "left_anti").select("node", "component")))
            discard(before, merged)
        rest = members.join(pivots.select("key", "id"), ["key", "id"], "left_anti")
        if linked:
            rest = rest.drop("component").join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "size", "own", *_BIT_COLUMNS, "keys", F.coalesce("component", "id").alias("component"))
        open_ = rest.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
        before, members, step = members, durable(rest.join(open_, "key")), step + 1
        discard(before, pivots, pairs, links)
        release(docs.sparkSession)
    discard(members, known, bodies, classes)

    final = named.join(labels.withColumnRenamed("node", "id"), "id", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "id")).alias("component"))
    out = table.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
