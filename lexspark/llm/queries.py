"""The queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, clustering, decontamination, jaccard_join, packing, pii, pitman_yor, quality, sharding, substring, token_counts, token_output, variants
from .common import read_table
from .sql import ORACLE


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), shards=8)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_words(read_table(spark, sf_dir, "documents"))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(read_table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), limit=1024)


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read_table(spark, sf_dir, "documents"))


def op7_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(read_table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op8_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_files(read_table(spark, sf_dir, "documents"))


def op9_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op11_pair_occurrence_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read_table(spark, sf_dir, "documents"))


def op12_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(read_table(spark, sf_dir, "embeddings"), k=8, rounds=10, salt="3:")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.document_variants(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_jump_sharding,
        op2_substring_dedup,
        op3_pitman_yor,
        op4_personal_data,
        op5_token_counts,
        op6_quality_cascade,
        op7_parity_sketch_join,
        op8_repair_token_files,
        op9_benchmark_containment,
        op10_residual_packing,
        op11_pair_occurrence_bpe,
        op12_annulus_clusters,
        op13_spelling_variants,
    )
}
