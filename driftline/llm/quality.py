"""Operator 5, quality classifier: supervised subword embeddings.

Each word, each pair of neighbouring words and each byte 3-, 4- and 5-gram within a word (its borders included, letter
case kept) is hashed to a learned vector; a pair's hash is the exclusive or of its words', so all repeated words share one; a document is the average of its features' vectors; a softmax over two classes follows. Vectors and output layer are
trained here by plain numpy stochastic gradient descent on a bounded sample of labelled documents: the
`train_docs` smallest by hash, the bound a parameter. Only the text is read for a score.

As average and softmax input are linear in the features, a trained model comes down to one number a slot. It is rounded to a
fixed-point integer, so a score doesn't depend on how rows are dealt into batches. It is SLOTS numbers, and is
shipped to the executors, which score all rows over whole texts in one pass.

Defined results: null and empty texts have no features and get the output layer's bias; without usable labels all
scores are 0.5; repeated rows are scored each; a null doc_id is held out; of several labels of a document the mean
counts, 0.5 as good; an empty table gives no rows; of further columns none is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import slices, texts_of

BITS, DIM, FIXED = 15, 8, 1 << 16
SLOTS = 1 << BITS
TRAIN_DOCS, EPOCHS, RATE = 2000, 4, 0.5
#: A document's gradient is shared among its features; their rate is so many times the output layer's.
SPREAD = np.float32(200)
CUT = 0.3
_A, _B = np.uint32(0x01000193), np.uint32(0x9E3779B1)
_POWERS = np.cumprod(np.full(4096, 0x100000001B3, np.uint64))


def _slot(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint32(salt * 0x51ED27)) * _B
    return ((x ^ (x >> np.uint32(15))) * _A) >> np.uint32(32 - BITS)


def features(texts: list[bytes | None]):
    """Yields (slot of each feature, place of it in the joined text), and before that the places where texts begin and end."""
    blob = np.frombuffer(b"\n" + b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
    lengths = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
    begin = np.cumsum(lengths + 1) - lengths
    white = (blob == 32) | ((blob >= 9) & (blob <= 13))
    text = np.where(white, np.uint8(32), blob).astype(np.uint32)
    yield begin, begin + lengths
    inner, gram = ~white, text
    keep = np.ones(len(blob), bool)
    for n in range(2, 6):
        gram = gram[:-1] * _A + text[n - 1 :]
        if n > 2:
            keep = keep[: len(gram)] & inner[n - 2 : n - 2 + len(gram)]
            at = np.flatnonzero(keep)
            yield _slot(gram[at], n), at + 1
        else:
            keep = keep[: len(gram)]
    starts = np.flatnonzero(inner[1:] & white[:-1]) + 1
    if len(starts):
        ends = np.flatnonzero(white[1:] & inner[:-1]) + 1
        at = np.flatnonzero(inner)
        place = np.arange(len(at)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)
        word = np.add.reduceat((blob[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place % 4096], np.cumsum(ends - starts) - (ends - starts))
        word = (word ^ (word >> np.uint64(32))).astype(np.uint32)
        yield _slot(word, 1), starts
        owner = np.searchsorted(begin, starts, side="right")
        beside = owner[1:] == owner[:-1]
        yield _slot(word[1:] ^ word[:-1], 9)[beside], starts[1:][beside]


def bags(texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the slots of its features and how often each occurs."""
    parts = features(texts)
    begin, _ = next(parts)
    slots, places = zip(*parts, strict=True)
    slot, owner = np.concatenate(slots).astype(np.int64), np.searchsorted(begin, np.concatenate(places), side="right") - 1
    key, n = np.unique(owner * SLOTS + slot, return_counts=True)
    cut = np.searchsorted(key // SLOTS, np.arange(len(texts) + 1))
    return [(key[a:b] % SLOTS, n[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Model:
    """One number a slot and the bias, both in units of 1 / FIXED."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = np.rint(weight * FIXED).astype(np.int64), round(bias * FIXED)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        parts = features(texts)
        begin, end = next(parts)
        total, n = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for slot, place in parts:
            sums = np.concatenate([[0], np.cumsum(self.weight[slot])])
            a, b = np.searchsorted(place, begin), np.searchsorted(place, end)
            total, n = total + sums[b] - sums[a], n + b - a
        logit = (total / np.maximum(n, 1) + self.bias) / FIXED
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def train(samples: list[tuple[bytes, bytes, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Stochastic gradient descent over (slots as 16-bit numbers, counts as 32-bit floats, label), one document a step, the rate
    falling to zero."""
    if not samples:
        return Model(np.zeros(SLOTS), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (SLOTS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    step, steps = 0, epochs * len(samples)
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            slots, counts, label = np.frombuffer(samples[i][0], "<u2"), np.frombuffer(samples[i][1], "<f4"), samples[i][2]
            share = counts / max(np.float32(1), counts.sum())
            mean = share @ vectors[slots]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            wrong = p / p.sum()
            wrong[label] -= 1
            now = np.float32(rate * (1 - step / steps))
            back = wrong @ out
            out -= now * np.outer(wrong, mean)
            bias -= now * wrong
            vectors[slots] -= now * SPREAD * np.outer(share, back)
            step += 1
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_docs: int = TRAIN_DOCS) -> Model:
    """docs: doc_id, text; labels: doc_id and the label. Rows with crc32(doc_id) mod 5 = 0 are never learned from."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg(label).alias("label"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    picked = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # the broadcast has train_docs rows at most

    def run(batches):
        for batch in slices(batches, "text", 1 << 20):
            own = bags(texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x >= 0.5 for x in batch.column("label").to_pylist()], pa.bool_()), pa.array([s.astype("<u2").tobytes() for s, _ in own], pa.binary()), pa.array([n.astype("<f4").tobytes() for _, n in own], pa.binary())], names=["doc_id", "good", "slots", "counts"])

    rows = picked.select("doc_id", "label", "text").mapInArrow(run, "doc_id bigint, good boolean, slots binary, counts binary").collect()  # at most train_docs rows of SLOTS numbers
    return train([(bytes(r["slots"]), bytes(r["counts"]), int(r["good"])) for r in sorted(rows, key=lambda r: r["doc_id"])])


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("bigint").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", train_docs: int = TRAIN_DOCS, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = with_score(docs, fit(docs, labels, label, train_docs))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def with_score(docs: DataFrame, model: Model, keep: float | None = None) -> DataFrame:
    """doc_id and score; or, with `keep`, the rows of docs in all their columns whose score is at least that."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, "text", 1 << 20):
            score = shipped.value.score(texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"]) if keep is None else batch.filter(pa.array(score >= keep))

    return docs.mapInArrow(run, "doc_id bigint, score double" if keep is None else docs.schema)
