"""Operator 1, best-fit packing: token sequences of a fixed capacity, filled by best-fit decreasing.

Best-fit decreasing looks at nothing but lengths, and there are only `capacity` of them. So the exact packing of
any number of documents follows from the histogram of lengths: the driver runs best-fit decreasing over it with a
segment tree over remaining capacities, taking runs of bins that are alike at once, and hands back a table of
intervals (length, ranks, bins, offset) whose size depends on the capacity alone. Executors then look up where
the r-th piece of its length goes. No piece meets any other in one task.

Defined results: null and empty texts hold the end id alone; repeated rows are packed each for itself, null ids
too; an empty table gives no rows; of further columns none is read.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.shared import durable, held, slices, texts_of

PIECES = "bucket int, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, local_rank bigint"
#: Words whose ids a worker remembers; when full it starts anew. It bounds memory and has no part in the result.
REMEMBERED, LONGEST = 300_000, 64


class CapacityTree:
    """Segment tree over remaining capacities: which of them have open bins; the tightest fit takes log steps."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, capacity: int, there: bool) -> None:
        at = capacity + self.size
        self.any[at] = there
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of at least `need` that an open bin has."""
        at = need + self.size
        if self.any[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, ...]], int]:
    """Rows (length, first rank, first bin, pieces a bin, offset in the bin) and the number of bins.

    Pieces of one length are alike, so a bin that is the tightest for one takes as many as fit before any other
    bin becomes the tightest: a run of bins alike is filled at once.
    """
    tree, runs, rows, bins = CapacityTree(capacity), {}, [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            runs.setdefault(left, []).append((first, n))
            tree.set(left, True)

    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        while n:
            left = tree.tightest(length)
            if left is None:
                left, more = capacity, -(-n // (capacity // length))
                put(capacity, bins, more)
                bins += more
            first, m = runs[left].pop()
            if not runs[left]:
                tree.set(left, False)
            each, offset = left // length, capacity - left
            full = min(m, n // each)
            if full:
                rows.append((length, rank, first, each, offset))
                put(left - each * length, first, full)
                rank, n = rank + full * each, n - full * each
            if full < m and 0 < n < each:
                rows.append((length, rank, first + full, n, offset))
                put(left - n * length, first + full, 1)
                rank, n, full = rank + n, 0, full + 1
            put(left, first + full, m - full)
    return rows, bins


class Encoder:
    """Ids of words by the tokenizer. A word of letters alone is one pre-token for a byte-level BPE with word ends; its merges then run
    in tiktoken's loop over the very same vocabulary, six times as fast. There the word's end is the byte FF, which UTF-8 lacks:
    it joins the last byte first, as those pairs have the lowest ranks."""

    END = b"\xff"

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.piece = Tokenizer.from_str(tokenizer_json), None
        if (ranks := word_end_ranks(json.loads(tokenizer_json))) is not None:
            import tiktoken

            self.piece = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        out = [array("I", self.piece(w.lower() + self.END)).tobytes() if self.piece and _plain(w) else None for w in words]
        rest = [i for i, x in enumerate(out) if x is None]
        for at in range(0, len(rest), 20_000):
            some = rest[at : at + 20_000]
            for i, x in zip(some, self.tokenizer.encode_batch_fast([words[i].decode() for i in some], add_special_tokens=False), strict=True):
                out[i] = array("I", x.ids).tobytes()
        return out


def _plain(word: bytes) -> bool:
    """Letters alone, lower-cased and composed: what the tokenizer's normaliser and splitter leave in one piece."""
    if word.isascii():
        return word.isalpha()
    text = word.decode()
    return text.isalpha() and max(text) < "\u0130" and text == text.lower() and unicodedata.is_normalized("NFC", text)


def word_end_ranks(tokenizer: dict) -> dict[bytes, int] | None:
    """The vocabulary of a lower-casing byte-level BPE with word ends, as bytes; None for any other tokenizer."""
    model, end = tokenizer["model"], tokenizer["model"].get("end_of_word_suffix")
    steps = [n["type"] for n in (tokenizer.get("normalizer") or {}).get("normalizers", [])], [n["type"] for n in (tokenizer.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    if model.get("type") != "BPE" or not end or steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or model.get("continuing_subword_prefix"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"].get(a + b) for a, b in merges]
    singles = [model["vocab"].get(c + e) for e in ("", end) for c in back]
    if None in ids or None in singles or ids != sorted(ids) or (ids and ids[0] <= max(singles)) or max(singles[:256]) >= min(singles[256:]):
        return None
    names = {t: i for t, i in model["vocab"].items() if all(c in back for c in t.removesuffix(end))}
    return {bytes(back[c] for c in t.removesuffix(end)) + (Encoder.END if t.endswith(end) else b""): i for t, i in names.items()}


#: Marks that the tokenizer never joins to a letter or digit before them: ids of a word that ends so are those of the rest, then theirs.
TAIL = b".,!?;:|#$%&*"


def _lowered(text: bytes) -> bytes:
    """The tokenizer lowers letters itself; done here first, fewer words are new. A special token's name keeps its case."""
    return text if b"<|" in text else text.lower()


def pieces(docs: DataFrame, tokenizer_json: str, capacity: int, end_id: int) -> DataFrame:
    """One row for each piece. The tokenizer drops white space and joins nothing across it, so the ids of a text
    are those of its words (cut at ASCII white space) one after another, and a worker looks up words it has met."""
    shipped, key = docs.sparkSession.sparkContext.broadcast(tokenizer_json), zlib.crc32(tokenizer_json.encode())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder, known = held(("packing", key), lambda: (Encoder(shipped.value), {}))
        bucket, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text", 6 << 20, holding=True):
            split = [_lowered(text or b"").split() for text in texts_of(batch, "text")]
            new = set().union(*split)
            if len(known) + len(new) > REMEMBERED:
                known.clear()
            new.difference_update(known)
            tailed = {w: core for w in new if len(core := w.rstrip(TAIL)) < len(w) and core[-1:].isalnum()}
            parts = new.difference(tailed).union(tailed.values(), (w[len(core) :] for w, core in tailed.items())).difference(known)
            parts = list(parts)
            known.update(zip(parts, encoder.ids(parts), strict=True))
            known.update((w, known[core] + known[w[len(core) :]]) for w, core in tailed.items())
            out = []
            for doc_id, words in zip(batch.column("doc_id").to_pylist(), split, strict=True):
                ids = b"".join(map(known.__getitem__, words)) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    out.append((bucket, doc_id, piece, at // 4, n, zlib.crc32(part), int(seen[n])))
                    seen[n] += 1
            for w in [w for w in (*parts, *tailed) if len(w) > LONGEST]:
                del known[w]
            columns = list(zip(*out, strict=True))
            types = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        cut = durable(pieces(docs, file.read(), capacity, end_id))
    counts = durable(cut.groupBy("bucket", "length").agg(F.count("*").alias("n")))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows, _ = best_fit_decreasing(histogram, capacity)
    rows = np.array(sorted(rows) or [(0, 0, 0, 1, 0)], np.int64)
    table = spark.sparkContext.broadcast(rows)  # bounded by the capacity: some intervals a length

    before = counts.select("bucket", "length", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t, n, r = table.value, length.to_numpy(), rank.to_numpy()
        at = np.searchsorted((t[:, 0] << 44) + t[:, 1], (n << 44) + r, side="right") - 1
        j = r - t[at, 1]
        return pd.DataFrame({"sequence_id": t[at, 2] + j // t[at, 3], "offset": t[at, 4] + j % t[at, 3] * n})

    placed = cut.join(before, ["bucket", "length"]).withColumn("place", place(F.col("length"), F.col("local_rank") + F.col("before")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
