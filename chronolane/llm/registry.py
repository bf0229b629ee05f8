"""Queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, backoff_lm, bpe, compression, filter_audit, jaccard, jpeg, mixing, pii, ranked_search, sharding, toxicity, wavelet
from .shared import documents, table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The default tokenizer file; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_sets(spark, documents(spark, sf_dir))


def op1_mixing_hierarchical_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


def op2_bpe_forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), vocabulary())


def op3_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"))


def op4_toxicity_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.store(spark, documents(spark, sf_dir), vocabulary())


def op6_jpeg_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.features(jpeg.store(documents(spark, sf_dir)))


def op7_pii_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(documents(spark, sf_dir))


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_backoff_automaton_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score(documents(spark, sf_dir))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_mixing_hierarchical_budget, op2_bpe_forced_boundaries, op3_adaptive_dimension_scan, op4_toxicity_weak_supervision, op5_wavelet_shards, op6_jpeg_thumbnails, op7_pii_anchor_expansion, op8_ngram_jaccard_join, op9_compression_quality, op10_backoff_automaton_lm, op11_filter_interaction_audit, op12_ranked_lexical_search, op13_sampled_splitters)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing_hierarchical_budget": mixing.MIXTURE_SQL,
        "op8_ngram_jaccard_join": jaccard.SIMILAR_SQL,
        "op11_filter_interaction_audit": filter_audit.AUDIT_SQL,
        "op12_ranked_lexical_search": ranked_search.SEARCH_SQL,
        "op13_sampled_splitters": sharding.SHARD_SQL,
    }
