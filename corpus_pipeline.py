"""A corpus pipeline: judge, deduplicate, decontaminate, redact, pack.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes each one's result as Parquet in the
cluster's shared folder and hands the table on. All but the last return the columns of documents. SQL can't
express the stages, so ORACLE_SQL is None; tests hold each stage against a brute-force version of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import decontam, neardup, packing, quality, secrets
from driftline.llm.shared import discard, durable

#: A document is rejected if its chance of good quality is below this.
QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose text the classifier doesn't reject. Rows in, rows out in their order; null texts count as empty, of rows that share a doc_id each is judged by its text. Labels of null ids or null quality
    teach nothing; without any label, and from an empty table, nothing is rejected."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), labels)
    return quality.with_score(docs, model, keep=QUALITY)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near-duplicates (five-word shingles, 0.8 or more).
    Rows with a null doc_id stay; of rows that share a doc_id all stay or none."""
    gone = neardup.near_duplicates(docs, n=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out the documents into which a benchmark item leaked. Null and empty texts stay, whole long texts are looked at;
    each row is judged for itself, whatever its doc_id, so repeated rows go or stay together; null items and an empty benchmark take nothing out."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows. Every row stays; null and empty texts stay as they are, texts are searched in
    full, and equal texts give equal texts, whatever their doc_id. An empty table gives an empty one."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into token sequences of 4096, every row: a null text counts as empty and has the end token only, longer ones than a sequence are
    cut, rows that share a doc_id are packed each, and places among equal lengths are free. An empty table gives no rows."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over documents."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
        discard(*last)
        last = [docs]
    packed = STAGES[-1][1](spark, docs, sf_dir)
    discard(*last)  # packing has cut all texts into a table of its own by now
    return packed
