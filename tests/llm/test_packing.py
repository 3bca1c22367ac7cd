import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftline.llm.packing import CapacityTree, Encoder, best_fit_decreasing, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fit = min((c for c in left if c >= n), default=None)
        if fit is None:
            left.append(capacity - n)
        else:
            left.remove(fit)
            left.append(fit - n)
    return sorted(left)


@pytest.mark.parametrize("seed", range(30))
def test_same_bins_as_one_document_at_a_time(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 10, 64])
    lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 300))]
    rows, bins = best_fit_decreasing({n: lengths.count(n) for n in set(lengths)}, capacity)
    want = one_by_one(lengths, capacity)
    assert bins == len(want)
    used = np.zeros((bins, capacity), int)
    for length in set(lengths):
        own = sorted(x[1:] for x in rows if x[0] == length)
        for rank in range(lengths.count(length)):
            first, b, each, offset = [x for x in own if x[0] <= rank][-1]
            at = offset + (rank - first) % each * length
            used[b + (rank - first) // each, at : at + length] += 1
    assert used.max(initial=0) <= 1
    assert sorted(capacity - used.sum(axis=1)) == want
    assert all((row[: row.sum()] == 1).all() for row in used)


def test_tree():
    tree = CapacityTree(10)
    for c in (3, 7, 10):
        tree.set(c, True)
    assert [tree.tightest(n) for n in (1, 3, 4, 7, 8, 10)] == [3, 3, 7, 7, 10, 10]
    tree.set(10, False)
    assert tree.tightest(8) is None


def test_pieces_against_the_tokenizer(spark):
    texts = ["", None, "The cat's mat.", "It's 1'000,5 x|y <|endoftext|>. É'S Ünïcode", "a b c  d\x1fe\x85f", "word " * 5000, "x" * 20000, "dup", "dup", "ﬁ Å Á. Σ. abc!!***", "<|endoftext|>a. b<|startoftext|>!!", "A <|ENDOFTEXT|> b"]
    docs = spark.createDataFrame([(None if i == 7 else i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, length int")
    got = pack(docs, PATH).collect()
    t = Tokenizer.from_file(PATH)
    want = []
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(None if i == 7 else i, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    key = lambda x: (x[0] is None, x)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=key) == sorted(want, key=key)
    check_places(got)


def test_words_against_the_tokenizer(spark):
    text = open(PATH, encoding="utf-8").read()
    t, own = Tokenizer.from_file(PATH), Encoder(text)
    assert own.piece
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()
    words = sorted({w for r in docs for w in r.text.lower().encode().split()})
    words += ["ÉTÉ", "été", "e\u0301te", "ÿ", "ÿÿa", "ıI", "İx", "ǅ", "ß", "ﬁn", "σς", "日本", "aª", "º", "x²", "µ", "ŉ", "ĳ", "a" * 500, "ĸ", "ĿA", "ǰ", "\u00ad"]
    words = [w if isinstance(w, bytes) else w.encode() for w in words]
    want = t.encode_batch([w.decode() for w in words], add_special_tokens=False)
    bad = [w for w, got, x in zip(words, own.ids(words), want, strict=True) if got != np.array(x.ids, "<u4").tobytes()]
    assert bad == []
    assert Encoder(text.replace('"Lowercase"', '"NFKC"')).piece is None


def check_places(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == len(one_by_one([r.length for r in rows], 4096))


def test_whole_table_and_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pack(docs, PATH).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    check_places(rows)
    assert pack(docs.limit(0), PATH).count() == 0
