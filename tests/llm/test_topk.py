import math
import random

import pytest

from driftline.llm.topk import top_k


def brute(rows, every=50, k=5, scale=256):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        vec = min(v for i, v in ok if i == q)
        best = sorted((-sum(a * b for a, b in zip(vec, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(vec))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def ask(spark, rows, **kw):
    return sorted(map(tuple, top_k(spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id bigint, embedding array<double>, label int, score double"), **kw).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_against_all(spark, seed):
    r = random.Random(seed)
    rows = [(i, [r.choice((-1.5, -0.25, 0.0, 0.1, 0.5, 2.0)) if seed else r.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [(7, rows[3][1]), (50, [0.0] * 6), (100, [9.0] * 6), (450, [1e300] * 6), (451, [1e12] * 6), (None, [1.0] * 6), (460, None), (461, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (462, [math.nan] * 6), (463, [math.inf] * 6), (500, [1.0, 2.0]), (501, [3.0, 4.0]), (550, [])]
    big = [x for x in rows if x[0] not in (450, 451)]
    assert ask(spark, big) == brute(big)


def test_large_numbers(spark):
    rows = [(i, [float(2**33 + i), float(-(2**30) * i)]) for i in range(60)]
    want = [(q, n, v, max(-(2**63), min(2**63 - 1, s))) for q, n, v, s in brute(rows)]
    assert [x[3] for x in ask(spark, rows)] == [x[3] for x in want]


def test_empty(spark):
    assert ask(spark, []) == []
    assert ask(spark, [(0, [1.0])]) == []
