import math
import random

import public_tokenizers

from driftline.llm.tokencount import BYTE_SCORE, MARK, Forward, count_tokens, vocabulary


def brute(word, pieces):
    """The best (score, fewest tokens) over all segmentations, by a plain left-to-right table."""
    score = {p: -round(math.log(r + 2) * 1e6) for r, p in enumerate(pieces)}
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        ways = [(best[end - 1][0] + n * BYTE_SCORE, best[end - 1][1] - n)]
        ways += [(best[s][0] + score[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in score]
        best.append(max(ways))
    return -best[-1][1]


def test_against_every_segmentation():
    r = random.Random(2)
    pieces = [MARK, MARK + "a", "a", "ab", "b", "abc", "cb", "bca", "é", "aa", "aaa", "éa"]
    forward = Forward(pieces)
    words = [MARK + "".join(r.choice("abcdé😀") for _ in range(r.randint(0, 9))) for _ in range(400)]
    for w in sorted(words) + words:
        assert forward.tokens(w) == brute(w, pieces)


def test_documents(spark, documents):
    pieces = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["", None, "The quick brown fox.", "a  b\tc\n", "ünïcode 日本語 😀", "x" * 300, "the the the", "The quick brown fox.", "word " * 3000]
    got = sorted((tuple(r) for r in count_tokens(documents([(None if i == 2 else i, t) for i, t in enumerate(texts)]), pieces).collect()), key=repr)
    want = []
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        want.append((None if i == 2 else i, len(words), sum(brute(MARK + w.decode(), pieces) if len(w) < 20 or w == b"x" * 300 else 0 for w in words)))
    assert got == sorted(want, key=repr)
    assert count_tokens(documents([]), pieces).count() == 0
