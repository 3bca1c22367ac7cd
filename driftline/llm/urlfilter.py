"""Operator 2, URL filters: rules first, else the ratio of two character language models.

The models are variable-order Markov chains over the bytes of a URL: the chance of a byte is its count after the
longest context seen, smoothed into the next shorter one, down to single bytes. One is counted over accepted and
one over rejected URLs, by default those that a rule has judged. A URL's score is the log-likelihood difference
over its length. The threshold is calibrated on a fifth of the judged URLs that the counts leave out: it is the one
with the best balanced accuracy there, the middle one of ties.

Counts are sums over every judged URL of the table, kept by the 64-bit hash of a gram or context in a distributed table that
grows with the grams there are. To be scored, URLs are put together in blocks of BLOCK bytes; the different grams of a block are joined
with the table, and what it says of them comes back to the block. Nothing of the model goes to the driver or is broadcast.

Defined results: a null url or one without "://" has an empty host and path, no rule, and is judged by the models
(score 0 if empty); without judged URLs of both kinds the threshold is 0; repeated rows each get their verdict;
an empty table gives no rows; of further columns none is read.
"""

from __future__ import annotations

import string
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import durable, mix, seeded, slices, texts_of

#: host, path, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: SLOTS: of Grams without keys.
ORDERS, SLOTS, SMOOTHING, BLOCK = 5, 1 << 16, 4.0, 1 << 17
#: Scores are calibrated in steps of 1 / STEPS between -LIMIT and LIMIT.
STEPS, LIMIT = 500, 8


def host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


class Grams:
    """Slots of the grams and contexts of a batch of URLs, for each order: their places in `keys` (sorted hashes that
    hold them all), without keys hashed into SLOTS. `doc` says whose each byte is, `keys_of` gives the hashes."""

    def __init__(self, urls: list[bytes], keys: np.ndarray | None = None):
        pad = b"\x02" * (ORDERS - 1)
        lengths = np.fromiter(map(len, urls), np.int64, len(urls))
        text = np.frombuffer(b"".join(pad + u for u in urls), np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(urls)), lengths + len(pad))
        starts = np.cumsum(lengths + len(pad)) - lengths - len(pad)
        self.at = np.flatnonzero(np.arange(len(text)) - starts[owner] >= len(pad)) if len(urls) else np.zeros(0, np.int64)
        self.doc, self.lengths = owner[self.at], lengths
        self.hashes, slots = [], []  # of gram and context, for each order
        context = np.zeros(len(self.at), np.uint64)  # of no byte
        for k in range(ORDERS):
            if k:
                context = mix(context + text[self.at - k] + np.uint64(1))
            gram = mix(context + (text[self.at] << np.uint64(9)) + np.uint64(7))
            self.hashes += [mix(x ^ seeded(2 * k + kind)) for kind, x in enumerate((gram, context))]
            slots += [(mix(x) % np.uint64(SLOTS)).astype(np.int64) for x in (gram, context)] if keys is None else [np.searchsorted(keys, x) for x in self.hashes[-2:]]
        self.gram, self.context = slots[::2], slots[1::2]

    def keys_of(self) -> tuple[np.ndarray, np.ndarray]:
        """The different hashes, sorted, and how often each occurs."""
        return np.unique(np.concatenate(self.hashes), return_counts=True)


def log_ratio(urls: list[bytes], model: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
    """model[class, order, kind, slot], class 1 accepted; per URL the difference of log-likelihoods over its length."""
    grams = Grams(urls, keys)
    logs = []
    for c in (0, 1):
        p = np.full(len(grams.at), 1 / 256)
        for k in range(ORDERS):
            p = (model[c, k, 0][grams.gram[k]] + SMOOTHING * p) / (model[c, k, 1][grams.context[k]] + SMOOTHING)
        logs.append(np.log(p))
    return np.bincount(grams.doc, logs[1] - logs[0], len(urls)) / np.maximum(grams.lengths, 1)


def _count(judged: DataFrame) -> DataFrame:
    """key, rejected, accepted: how often each gram and context occurs in each class."""

    def run(batches):
        for batch in slices(batches, "url", 1 << 20):
            accepted = np.array(batch.column("accepted").to_pylist(), bool)
            urls = texts_of(batch, "url")
            for c in (0, 1):
                key, n = Grams([u for u, a in zip(urls, accepted, strict=True) if a == c]).keys_of()
                counts = [n.astype(np.int64) if c == x else np.zeros(len(n), np.int64) for x in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), *counts)], names=["key", "rejected", "accepted"])

    return judged.mapInArrow(run, "key bigint, rejected bigint, accepted bigint").groupBy("key").agg(F.sum("rejected").alias("rejected"), F.sum("accepted").alias("accepted"))


def _blocks(frame: DataFrame) -> DataFrame:
    """block, rows: the rows of frame, as Arrow streams of about BLOCK bytes of URLs."""

    def run(batches):
        for batch in slices(batches, "url", BLOCK):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])

    return durable(frame.mapInArrow(run, "block string, rows binary"))


def _unpacked(rows) -> tuple[pa.RecordBatch, list[bytes]]:
    batch = next(iter(pa.ipc.open_stream(rows.as_buffer())))
    return batch, [u or b"" for u in texts_of(batch, "url")]


def _scored(frame: DataFrame, counts: DataFrame, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    blocks = _blocks(frame)

    def wanted(batches):
        for batch in batches:
            for block, rows in zip(batch.column("block"), batch.column("rows"), strict=True):
                key = Grams(_unpacked(rows)[1]).keys_of()[0]
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()] * len(key), pa.string()), pa.array(key.view(np.int64))], names=["block", "key"])

    def run(batches):
        for batch in batches:
            for rows, known in zip(batch.column("rows"), batch.column("known"), strict=True):
                own, urls = _unpacked(rows)
                keys = Grams(urls).keys_of()[0]
                model = np.zeros((2, len(keys)))
                if known.is_valid and len(known):
                    at = np.searchsorted(keys, known.values.field("key").to_numpy().view(np.uint64))
                    for c, name in enumerate(("rejected", "accepted")):
                        model[c, at] = known.values.field(name).to_numpy()
                score = log_ratio(urls, np.broadcast_to(model[:, None, None], (2, ORDERS, 2, len(keys))), keys)
                yield pa.RecordBatch.from_arrays([own.column(n) for n in names[:-1]] + [pa.array(score)], names=names)

    known = blocks.select("block", "rows").mapInArrow(wanted, "block string, key bigint").join(counts.hint("merge"), "key")
    known = known.groupBy("block").agg(F.collect_list(F.struct("key", "rejected", "accepted")).alias("known"))
    return blocks.join(known.hint("merge"), "block", "left").select("rows", "known").mapInArrow(run, schema)


def threshold_of(histogram: dict[tuple[bool, int], int]) -> float:
    """The lower edge of the best step: accepted URLs at or above it, rejected ones below."""
    n = 2 * STEPS * LIMIT + 1
    by = np.zeros((2, n))
    for (accepted, step), count in histogram.items():
        by[int(accepted), step + STEPS * LIMIT] += count
    if not by.sum(axis=1).all():
        return 0.0
    right = by[1][::-1].cumsum()[::-1] / by[1].sum() + (by[0].cumsum() - by[0]) / by[0].sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return (int(best[len(best) // 2]) - STEPS * LIMIT) / STEPS


def filter_urls(pages: DataFrame, rules=RULES, judged: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score. judged: (url, accepted) to learn from, else the rules' own verdicts."""
    frame = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_path(F.col("url"))
    frame = frame.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    frame = frame.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    if judged is None:
        judged = frame.where("by_rule is not null").select("url", (F.col("by_rule") == "allow").alias("accepted"))
    judged = judged.where("url is not null and accepted is not null").select("url", "accepted", (F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(5)) == 0).alias("held_out"))
    counts = durable(_count(judged.where("not held_out").select("url", "accepted")))
    tried = _scored(judged.where("held_out").select("url", "accepted"), counts, "accepted boolean, score double")
    step = F.greatest(F.lit(-STEPS * LIMIT), F.least(F.lit(STEPS * LIMIT), F.floor(F.col("score") * STEPS)))
    rows = tried.groupBy("accepted", step.cast("int").alias("step")).count().collect()  # at most 2 * (2 * STEPS * LIMIT + 1) rows
    threshold = threshold_of({(r[0], r[1]): r[2] for r in rows})
    out = _scored(frame, counts, "page_id bigint, host string, path string, rule string, by_rule string, score double")
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score")
