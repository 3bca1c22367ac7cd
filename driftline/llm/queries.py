"""The queries of the training-data operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from driftline.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.urlfilter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from driftline.llm.tokencount import count_tokens, vocabulary

    return count_tokens(_table(spark, sf_dir, "documents"), vocabulary(public_tokenizers.path("piece_bpe_32k.model")))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.decontam import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.substring import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"), passage=50, similarity=0.8)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), n=4, percent=80)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.secrets import find_secrets

    return find_secrets(_table(spark, sf_dir, "documents"))


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.llm.pii import pseudonymised

    key = spark.conf.get("spark.driftline.pseudonym.key", "the user's own key goes here")  # one of your own makes pseudonyms secret
    return pseudonymised(_table(spark, sf_dir, "documents"), key=key)


def queries() -> dict:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_url_filters, op3_token_counts, op4_benchmark_decontamination, op5_quality_classifier, op6_exact_top_k, op7_substring_dedup, op8_minhash_near_dedup, op9_secret_scans, op10_pii_pseudonyms)}


OP6 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e) where q.vec_id % 50 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""

OP8 = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), g as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) end as s
  from w
), u as (
  select doc_id, unnest(s) as x from g
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from u a join u b on a.x = b.x and a.doc_id < b.doc_id group by all
), l as (
  select a, b from p join g ga on ga.doc_id = a join g gb on gb.doc_id = b where 100 * n >= 80 * (len(ga.s) + len(gb.s) - n)
), e as (
  select a, b from l union all select b, a from l
), c(node, root) as (
  select doc_id, doc_id from g union select c.node, e.b from c join e on e.a = c.root
), m as (
  select node, min(root) as component_id from c group by node
)
select g.doc_id, cast(len(s) as bigint) as n_shingles, component_id, g.doc_id = component_id as kept from g join m on m.node = g.doc_id
"""


def oracle_sql() -> dict:
    return {"op6_exact_top_k": OP6, "op8_minhash_near_dedup": OP8}
