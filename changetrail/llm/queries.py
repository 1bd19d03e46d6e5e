"""The registered queries of this subpackage, each over its whole table with production settings."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changetrail.llm import (byte_bpe, fingerprints, license_scan, line_dedup, mixing, near_dedup,
                             ngram_join, periodic_runs, secret_scan, spelling_variants, substring_dedup, top_k, toxicity)
from changetrail.llm.storage import table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

RANKS = "byte_bpe_50k.tiktoken"


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


@query
def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_sentences", "n_removed", "text")


@query
def op2_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_secret_scan(spark, sf_dir):
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


@query
def op4_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


@query
def op5_byte_bpe(spark, sf_dir):
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"),
                                     public_tokenizers.path(RANKS), public_tokenizers.PATTERN,
                                     with_ids=False)


@query
def op6_mixing(spark, sf_dir):
    return mixing.training_order(mixing.assign(table(spark, sf_dir, "documents")))


@query
def op8_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", "text")


@query
def op9_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"),
                                    table(spark, sf_dir, "labels"))


@query
def op7_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return top_k.nearest_by_product(vectors, F.col("vec_id") % 100 == 0)


ORACLE["op7_top_k"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id query_id, c.vec_id,
    list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)
), ordered as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int "rank"
  from scored
)
select query_id, "rank", vec_id, score from ordered where "rank" <= 10
"""


@query
def op10_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


@query
def op11_spelling_variants(spark, sf_dir):
    return spelling_variants.variants(table(spark, sf_dir, "documents"), plant=True)


@query
def op12_ngram_join(spark, sf_dir):
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


@query
def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.find_runs(table(spark, sf_dir, "documents"), plant=True, with_text=False)
