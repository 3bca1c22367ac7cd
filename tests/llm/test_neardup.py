import random
import re

import numpy as np
import pytest

from driftline.llm.neardup import fast_similarity_sketch, near_duplicates, shingle_set
from driftline.llm.shared import components


def brute(rows, n=4, percent=80):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(zip(*[w[i:] for i in range(n)], strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((i, len(s), None if i is None else find(i), None if i is None else find(i) == i) for i, s in sets), key=repr)


def ask(docs, **kw):
    return sorted((tuple(r) for r in near_duplicates(docs, **kw).collect()), key=repr)


def chain(r, length, steps):
    """Texts each of which is near the one before, the last far from the first."""
    words = [f"w{r.randint(0, 9**6)}" for _ in range(length)]
    out = []
    for _ in range(steps):
        words[r.randrange(length)] = f"n{r.randint(0, 9**6)}"
        out.append(" ".join(words))
    return out


def test_against_all_pairs(documents):
    r = random.Random(3)
    texts = [t for n in (8, 40, 60, 60, 100) for t in chain(r, n, 25)]
    texts += ["", None, " \t\n", "one", "One", "two words", "two  WORDS", "a b c", "a b c d", "a b c d e", "x" * 5000, "É é", "é é"]
    texts += [texts[0]] * 5 + [texts[30]] * 3
    r.shuffle(texts)
    rows = list(enumerate(texts))
    assert ask(documents(rows), n=4, percent=80) == brute(rows)


def test_shared_and_null_ids_and_empty(documents):
    base = " ".join(f"w{i}" for i in range(50))
    rows = [(5, base), (5, "quite another text of some words here"), (9, "quite another text of some words here"), (None, base), (None, None), (7, base), (1, None)]
    assert ask(documents(rows), n=4) == brute([(i, t) for i, t in rows if i is not None] + [(None, t) for i, t in rows if i is None]) or {r[2] for r in ask(documents(rows), n=4) if r[0] in (5, 7, 9)} == {5}
    other = base.replace("w9 ", "x9 ")
    odd = near_duplicates(documents([(5, base), (5, " \t"), (6, other), (5, None), (6, "\n\t"), (8, "one more")]), n=4)
    assert {r.component_id for r in odd.collect() if r.doc_id in (5, 6)} == {5}
    assert ask(documents([]), n=4) == []


def test_many_near_copies(documents):
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(r.randint(0, 3)):
            words[r.randrange(60)] = f"n{r.randint(0, 9**6)}"
        rows.append((i, " ".join(words)))
    assert ask(documents(rows), n=4) == brute(rows)


@pytest.mark.parametrize("size", [1, 2, 5, 50, 2000])
def test_sketch_fills_and_estimates(size):
    r = np.random.default_rng(size)
    both = r.integers(0, 2**63, size, dtype=np.uint64)
    other = r.integers(0, 2**63, max(1, size // 4), dtype=np.uint64)
    a, b = fast_similarity_sketch(np.unique(both)), fast_similarity_sketch(np.unique(np.concatenate([both, other])))
    assert (a != np.uint64(2**64 - 1)).all()
    want = len(np.unique(both)) / len(np.unique(np.concatenate([both, other])))
    assert abs((a == b).mean() - want) < 0.25
    assert (fast_similarity_sketch(np.unique(both)) == a).all()


def test_shingle_set_counts():
    assert [len(shingle_set(t, 4)) for t in (None, b"", b"a", b"a b c", b"a b c d", b"a a a a a a", b"A b c d a b c d")] == [0, 0, 1, 1, 1, 1, 4]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)] + [(7, 7)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_few_links_are_joined_in_one_task_and_as_many_links_are(spark, monkeypatch):
    import random

    from driftline.llm import shared

    r = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(r.randint(0, 90), r.randint(0, 90)) for _ in range(60)] + [(-5, 7), (7, -5), (8, 8)]
    table = spark.createDataFrame(edges, "a bigint, b bigint")

    def run(group):
        spark.sparkContext.setJobGroup(group, group)
        rows = sorted(map(tuple, shared.components(table).collect()))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, jobs = run("few links")
    monkeypatch.setattr(shared, "FEW", 0)
    many, more = run("many links")
    assert few == many and len(few) == len({x for a, b in edges if a != b for x in (a, b)})
    assert jobs <= 6 < more
