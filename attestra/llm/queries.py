"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from . import byte_bpe, centroids, jaccard, language, layout, packing, ppm, simhash, sketches, stable_knn, substrings, urls, whitening
from .common import table


#: The rules of the URL query.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page."""
    return urls.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op2_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprints and likenesses of every document."""
    return sketches.edit_checks(table(spark, sf_dir, "documents"))


def op3_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    return language.held_out_languages(table(spark, sf_dir, "documents"))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    return ppm.held_out_scores(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, text of every page."""
    return layout.extracted(table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return substrings.digests(substrings.repeats(table(spark, sf_dir, "documents")))


def op9_stable_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest of every row whose vec_id 20 divides."""
    return stable_knn.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of a document."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of the first four components of every vector."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return jaccard.joined(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector."""
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_ratio": op1_url_ratio,
    "op2_scaled_sketch": op2_scaled_sketch,
    "op3_compression_language": op3_compression_language,
    "op4_ppm": op4_ppm,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_simhash": op6_simhash,
    "op7_layout_text": op7_layout_text,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_stable_knn": op9_stable_knn,
    "op10_best_fit": op10_best_fit,
    "op11_whitening": op11_whitening,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_centroids": op13_centroids,
}

ORACLE_SQL: dict[str, str] = {}
