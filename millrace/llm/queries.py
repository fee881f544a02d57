"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import capfilters, contextmix, fingerprints, jaccardjoin, licenses, mixture, packing, shards, tokenfile, toxicity
from .common import read


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_spherical_cap_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


def op2_balanced_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(read(spark, sf_dir, "documents"))


def op3_addressable_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_file(read(spark, sf_dir, "documents"), tokenizer_path())


def op4_multi_order_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccardjoin.jaccard_components(read(spark, sf_dir, "documents"))


def op5_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op8_automaton_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_one_permutation_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op10_context_mixing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contextmix.scores(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_spherical_cap_near_duplicates,
        op2_balanced_label_shards,
        op3_addressable_token_file,
        op4_multi_order_jaccard,
        op5_source_mixture,
        op6_differencing_packing,
        op7_license_scan,
        op8_automaton_toxicity,
        op9_one_permutation_fingerprints,
        op10_context_mixing_scores,
    )
}
ORACLES = {"op5_source_mixture": mixture.ORACLE, "op7_license_scan": licenses.oracle()}
