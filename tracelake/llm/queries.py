"""The queries of this subpackage: each applies one operator to its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import language_crf, license_scan, packing, quality_rules, record_files, sentencepiece_unigram, simhash, token_counts, topk, url_filter
from tracelake.llm.common import table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file lies on this machine; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_unigram.round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digests(table(spark, sf_dir, "documents"), vocabulary())


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.identify(table(spark, sf_dir, "documents"))


def op9_record_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_files.record_digests(table(spark, sf_dir, "documents"), vocabulary())


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_sentencepiece_unigram, op2_token_counts, op3_quality_rules, op4_simhash, op5_best_fit_packing, op6_url_filter, op7_exact_topk, op8_language_id, op9_record_output, op10_license_scan]
    return {f.__name__: f for f in own}


TOP_K_SQL = """with vectors as (select vec_id, list_transform(embedding, lambda v: floor(64 * cast(v as double))) as x from embeddings
where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda v: v is null or isnan(v) or isinf(v))) = 0),
scored as (select q.vec_id as query_id, c.vec_id, cast(coalesce(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])), 0) as bigint) as score
from vectors q, vectors c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(q.x) = len(c.x)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 20"""


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": url_filter.sql(), "op7_exact_topk": TOP_K_SQL, "op10_license_scan": license_scan.sql()}
