"""Operator 4, benchmark decontamination: spaced-seed hashing with verification.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A fixed mask such as 111011 is laid at every word of a
benchmark item and of a document; the words under its 1s are hashed, the others may differ. Equal hashes join a
place of the document with a place of the item; around it the two are laid side by side and compared word by
word. An item has leaked into a document if in some WINDOW words of it (all, if it has fewer) at least SHARE of
the words agree. The masks meet every such window of 15 words that has up to three substitutions, SHORT_MASKS with them those of shorter items that agree enough.

The benchmark side is dealt into blocks of about BLOCK_WORDS words, so a block's size is bounded whatever the
benchmark holds; each block's sorted seed hashes and words go to the executors, and documents stream past it in
one pass without a shuffle. Almost all benchmarks are one block; a larger one takes a pass a block.

Defined results: null texts and null items match nothing; an item of five to seven words matches only as a whole
and exactly, one of fewer words not at all; repeated rows match each; a null id stays null; empty tables give no
rows (and let all documents through); of further columns none is read, and `clean` keeps them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import durable, mix, seeded, slices, texts_of, word_hashes

MASKS = ("111011", "11111", "1101101")
#: Further ones for items of 8 to 14 words, some alignments of which none of MASKS meets.
SHORT_MASKS = ("1111", "11011", "1011")
WINDOW, SHARE, SHORTEST = 15, 0.8, 5
BLOCK_WORDS = 2_000_000
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_WEIGHT = np.array([mix(np.array([seeded(900 + k)]))[0] | np.uint64(1) for k in range(64)], np.uint64)
_FILTER_BITS = 22
#: Hits, and words under hits, that are looked at in one go; all the others follow.
HITS, WORDS = 200_000, 4_000_000


def words_of(text: bytes | None) -> np.ndarray:
    return word_hashes(text.translate(_LETTERS).split()) if text else np.zeros(0, np.uint64)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each place at which the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, seeded(hash_of(mask)), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += words[k : k + n] * _WEIGHT[k]
    return out ^ (out >> np.uint64(29))


def hash_of(mask: str) -> int:
    return int(mask, 2) + 64


class Block:
    """Benchmark items, ready to be met: sorted seeds, with the item and place of each, and the items' words."""

    def __init__(self, items: list[tuple[int | None, bytes | None]]):
        self.items = [(i, w) for i, t in items if len(w := words_of(t)) >= SHORTEST]
        whole = {"1" * len(w) for _, w in self.items if len(w) < 8}
        short = SHORT_MASKS if any(8 <= len(w) < WINDOW for _, w in self.items) else ()
        self.masks = [*dict.fromkeys([*MASKS, *short, *sorted(whole)])]
        self.words = np.concatenate([np.zeros(0, np.uint64), *[w for _, w in self.items]])
        self.length = np.array([len(w) for _, w in self.items], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.tables = []
        for mask in self.masks:
            fit = [k for k, (_, w) in enumerate(self.items) if (len(w) >= 8 and mask in MASKS) or (8 <= len(w) < WINDOW and mask in SHORT_MASKS) or (len(w) < 8 and len(w) == len(mask) and "0" not in mask)]
            own = [seeds(self.items[k][1], mask) for k in fit]
            key = np.concatenate([np.zeros(0, np.uint64), *own])
            item = np.repeat(np.array(fit, np.int64), [len(s) for s in own])
            place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(s)) for s in own]])
            head = np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] == 0)])[: len(key)]
            order = np.lexsort((~head, key))  # of one seed in a row the first comes first
            there = np.zeros(1 << _FILTER_BITS, bool)
            there[key >> np.uint64(64 - _FILTER_BITS)] = True
            self.tables.append((mask, key[order], item[order], place[order], np.append(0, np.cumsum(head[order])), np.packbits(there)))

    def leaks(self, texts: list[bytes | None]) -> list[tuple[int, int | None, int, int, int]]:
        """(text, item id, first word in the text, words compared, words that agree), the best place for each text and item."""
        split = [words_of(t) for t in texts]
        words = np.concatenate([np.zeros(0, np.uint64), *split])
        ends = np.cumsum([len(w) for w in split]).astype(np.int64)
        begins = ends - np.array([len(w) for w in split], np.int64)
        found, seen = [np.zeros((0, 5), np.int64)], np.zeros(0, np.int64)
        reach = int(self.length.max(initial=0))
        for mask, key, item, place, heads, packed in self.tables:
            if not len(key):
                continue
            there = np.unpackbits(packed).view(bool)
            own = seeds(words, mask)
            at = np.flatnonzero(there[own >> np.uint64(64 - _FILTER_BITS)])
            low, high = np.searchsorted(key, own[at]), np.searchsorted(key, own[at], side="right")
            at, low, high = at[low < high], low[low < high], high[low < high]
            text = np.searchsorted(ends, at, side="right")
            inside = at + len(mask) <= ends[text]
            at, low, high, text = at[inside], low[inside], high[inside], text[inside]
            # where a seed comes again at once in the text, it lies on a diagonal that was met a place before, unless it is the first of its row in the item
            again = (at > begins[text]) & (own[at] == own[at - 1])
            n = np.where(again, heads[high] - heads[low], high - low)
            for part in _parts(n, HITS):
                m = n[part]
                which = np.repeat(low[part], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                shift = np.repeat(at[part] - begins[text[part]], m) - place[which]
                code = np.unique((np.repeat(text[part], m) * len(self.items) + item[which]) * (len(words) + reach + 1) + shift + reach)
                code = code[~np.isin(code, seen)]
                seen = np.union1d(seen, code)
                pair, shift = np.divmod(code, len(words) + reach + 1)
                hits = np.stack([*np.divmod(pair, len(self.items)), shift - reach], 1)
                found.append(_best(np.concatenate([found.pop(), self._overlaps(words, begins, ends, hits)])))
        return [(t, self.items[k][0], start, size, agree) for t, k, start, size, agree in found[0].tolist()]

    def _overlaps(self, words: np.ndarray, begins: np.ndarray, ends: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Lays items on texts as hits (text, item, the text's place for the item's first word) say. Of those with a window in which enough words agree: text, item, where it begins, its length, how many agree."""
        out = [np.zeros((0, 5), np.int64)]
        text, item, shift = hits.T
        length, size = self.length[item], np.minimum(WINDOW, self.length[item])
        need = np.where(size < 8, size, -(-int(round(SHARE * 100)) * size // 100))
        low, high = np.maximum(0, -shift), np.minimum(length, ends[text] - begins[text] - shift)
        fits = np.flatnonzero(high - low >= size)
        for part in _parts((high - low)[fits], WORDS):
            own = fits[part]
            n = high[own] - low[own]
            first = np.cumsum(n) - n
            step = np.arange(n.sum()) - np.repeat(first, n) + np.repeat(low[own], n)
            same = self.words[np.repeat(self.begin[item[own]], n) + step] == words[np.repeat(begins[text[own]] + shift[own], n) + step]
            total = np.concatenate([[0], np.cumsum(same)])
            windows = n - size[own] + 1
            start = np.repeat(first - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
            agree = total[start + np.repeat(size[own], windows)] - total[start]
            value = agree * (len(same) + 1) - start  # most words, then the first place
            best = np.maximum.reduceat(value, np.cumsum(windows) - windows)
            most = -(-best // (len(same) + 1))
            at = most * (len(same) + 1) - best - first + low[own] + shift[own]
            out.append(np.stack([text[own], item[own], at, size[own], most], 1)[most >= need[own]])
        return np.concatenate(out)


def _parts(sizes: np.ndarray, limit: int) -> list[slice]:
    """Slices of what has these sizes so that each is of `limit` at most, or one element."""
    ends, out, at = np.cumsum(sizes), [], 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        out.append(slice(at, to))
        at = to
    return out


def _best(found: np.ndarray) -> np.ndarray:
    """For each text and item the row with the most agreeing words, the first in the text of several."""
    found = found[np.lexsort((found[:, 2], -found[:, 4], found[:, 1], found[:, 0]))]
    return found[np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)])[: len(found)]]


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> list:
    """The benchmark as broadcast blocks of about block_words words."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = max(1, -(-total // block_words))
    out = []
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        out.append(benchmark.sparkSession.sparkContext.broadcast(Block([(r[0], r[1].encode()) for r in own.collect()])))  # one bounded block
    return out


SCHEMA = "doc_id bigint, item_id bigint, start bigint, compared int, agreeing int"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start (word), compared, agreeing for each document and item that leaked into it."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for shipped in blocks(benchmark):

        def run(batches, shipped=shipped):
            for batch in slices(batches, "text", 2 << 20):
                rows = shipped.value.leaks(texts_of(batch, "text"))
                ids = batch.column("doc_id").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([ids[r[0]] for r in rows], pa.int64()), *[pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()), (4, pa.int32()))]], names=[x.split()[0] for x in SCHEMA.split(", ")])

        part = docs.mapInArrow(run, SCHEMA)
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs into whose text nothing leaked, in all their columns."""
    shipped_blocks = blocks(benchmark)
    for k, shipped in enumerate(shipped_blocks):

        def run(batches, shipped=shipped):
            for batch in slices(batches, "text", 2 << 20):
                bad = {r[0] for r in shipped.value.leaks(texts_of(batch, "text"))}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if k + 1 < len(shipped_blocks):  # one block at a time in a worker
            docs = durable(docs)
            shipped.unpersist()
    return docs
