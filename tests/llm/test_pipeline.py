import re
import zlib

import corpus_pipeline as c
from tests_llm_helpers import brute_kept

SF = "/root/testdata/sf0.001"


def plain_words(text):
    """Words as decontamination takes them: runs of letters, digits and anything beyond ASCII."""
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leaked(text, item):
    """Whether some window of 15 words of the item (all, if it has fewer) lies somewhere in the text with 80 % of its words."""
    a, b = plain_words(text), plain_words(item)
    if len(b) < 5:
        return False
    size = len(b) if len(b) < 8 else min(15, len(b))
    need = size if len(b) < 8 else -(-80 * size // 100)
    where = {}
    for k, w in enumerate(b):
        where.setdefault(w, []).append(k)
    for shift in {at - k for at, w in enumerate(a) for k in where.get(w, ())}:
        low, high = max(0, -shift), min(len(b), len(a) - shift)
        same = [b[k] == a[k + shift] for k in range(low, high)]
        if any(sum(same[k : k + size]) >= need for k in range(len(same) - size + 1)):
            return True
    return False


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        path = c.durable(out)
        after = {r.doc_id: r for r in path.collect()}
        if stage is c.quality_stage:
            good = [i for i in before if labels.get(i) == 1]
            assert set(after) <= set(before) and sum(i in after for i in good) >= 0.95 * len(good)
        elif stage is c.near_duplicate_stage:
            assert set(after) == brute_kept({i: r.text for i, r in before.items()}, 5, 80), name
        elif stage is c.decontamination_stage:
            assert set(after) == {i for i, r in before.items() if not any(leaked(r.text, t) for t in items)}, name
        else:
            assert set(after) == set(before)
            assert not any('token = "' in r.text and "[SECRET]" not in r.text for r in after.values())
            assert all(r.n_chars == len(r.text) for r in after.values())
        if stage is not c.secrets_stage:
            assert all(after[i] == before[i] for i in after)  # what stays is untouched
        docs, before = path, after
    packed = c.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(before)


def test_quality_stage_on_documents_it_has_not_learned_from(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in c.quality_stage(spark, docs, sf).select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    good, bad = ([i for i, q in labels.items() if q == k] for k in (1, 0))
    assert sum(i in kept for i in good) >= 0.95 * len(good) and sum(i not in kept for i in bad) >= 0.7 * len(bad)


def odd(documents, benchmark):
    """Nulls, empty texts, an id that is null or stands twice, repeats, a long text and a leaked passage."""
    return documents([(1, None), (2, ""), (None, "text without an id"), (3, "same words here again and on"), (4, "same words here again and on"), (5, "x " * 20000), (5, "another of that id"), (6, f"before it {benchmark} and after"), (7, 'password = "hunter2HorseBattery99Staple"')])


def test_odd_rows_of_every_stage(spark, documents):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if len(plain_words(r.text)) >= 15)
    docs = odd(documents, item)
    rows = sorted((str(r.doc_id), r.text) for r in docs.where("text is not null").collect())
    ids = lambda df: sorted(str(r.doc_id) for r in df.collect())
    every = ids(docs)

    kept = c.quality_stage(spark, docs, SF)
    assert kept.columns == docs.columns and set(ids(kept)) <= set(every)
    by_text = {}
    for r in kept.collect():
        by_text.setdefault(r.text, []).append(r.doc_id)
    assert by_text.get("same words here again and on", [3, 4]) in ([3, 4], [4, 3])  # equal texts stay or go together

    kept = c.near_duplicate_stage(spark, docs, SF)
    assert kept.columns == docs.columns and ids(kept) == [x for x in every if x != "4"]

    kept = c.decontamination_stage(spark, docs, SF)
    assert kept.columns == docs.columns and ids(kept) == sorted(x for x in every if x != "6")

    kept = c.secrets_stage(spark, docs, SF)
    assert kept.columns == docs.columns and ids(kept) == every
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text is not None and r.doc_id != 7) == [x for x in rows if x[0] != "7"]
    assert all(r.n_chars == len(r.text) for r in kept.collect() if r.doc_id == 7)

    packed = c.packing_stage(spark, docs, SF).collect()
    assert {str(r.doc_id) for r in packed} == set(every)
    assert [r.length for r in packed if r.doc_id in (1, 2)] == [1, 1]  # the end token
    assert sum(r.length for r in packed if r.doc_id == 5) > 4096 and max(r.length for r in packed) <= 4096


def test_run_over_odd_and_empty_tables(spark, documents, tmp_path):
    assert c.run(spark, SF).count() > 100
    odd(documents, "nothing of a benchmark").write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    got = {r.doc_id for r in c.run(spark, str(tmp_path)).collect()}
    assert got <= {None, 1, 2, 3, 5, 6, 7} and 4 not in got
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in c.run(spark, str(tmp_path)).collect()} == {None, 1, 2, 3, 5, 6, 7}  # no labels, so none is rejected
    documents([]).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0
