import random
import zlib

import numpy as np

from driftline.llm.quality import SLOTS, Model, bags, classify, train


def test_bags_by_hand():
    texts = [b"ab cd ab", b"", None, b"  x  ", "é é".encode(), b"abcdef" * 3000]
    own = bags(texts)
    assert [int(n.sum()) for _, n in own[:4]] == [3 + 2 + 3 * 3, 0, 0, 1 + 1]  # words, pairs, and of each " ab", "ab ", " ab "
    assert len(own) == len(texts) and all((s[1:] > s[:-1]).all() for s, _ in own)
    assert [list(map(list, x)) for x in bags([texts[0]])] == [list(map(list, own[0]))]


def test_score_is_the_mean_of_the_features_whatever_the_batch():
    rng = np.random.default_rng(3)
    model = Model(rng.normal(size=SLOTS), 0.25)
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abcÉß.!|") for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 60))).encode() for _ in range(40)] + [None, b"", b" \n"]
    all_ = model.score(texts)
    for k, (slots, n) in enumerate(bags(texts)):
        z = ((model.weight[slots] * n).sum() / max(1, n.sum()) + model.bias) / (1 << 16)
        assert abs(1 / (1 + np.exp(-z)) - all_[k]) < 1e-12
        assert model.score([texts[k]])[0] == all_[k]


def test_training_without_samples():
    assert train([]).score([b"anything", None]).tolist() == [0.5, 0.5]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(rows[d].predicted, q) for d, q in truth.items() if rows[d].held_out]
    assert sum(p == q for p, q in held) / len(held) >= 0.9


def test_odd_rows(spark, documents):
    docs = documents([(1, None), (2, ""), (None, "some text"), (3, "good words here"), (3, "good words here"), (4, "x" * 50000)])
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 1), (3, 0), (4, 0)], "doc_id bigint, quality int")
    got = classify(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert {r.score for r in classify(docs, labels.limit(0)).collect()} == {0.5}
    assert classify(documents([]), labels).count() == 0
