"""The registered queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirewarden.llm import language_id, license_scan, manifest, quality, url_filter
from wirewarden.llm.ann_forest import nearest
from wirewarden.llm.bloom_lm import score, split
from wirewarden.llm.bpe import encode_decode
from wirewarden.llm.common import read, remainder
from wirewarden.llm.decontaminate import find_leaks
from wirewarden.llm.jaccard_join import jaccard_components
from wirewarden.llm.packing import pack_documents
from wirewarden.llm.substring_dedup import remove_duplicates
from wirewarden.llm.whitening import whiten


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_duplicates(read(spark, sf_dir, "documents"), with_text=False).drop("text")


def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    out = encode_decode(read(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), split("doc_id", 7, 2))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(True))
    network = language_id.train(docs.filter(~held_out))
    return language_id.predict(docs, network).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)


#: The rules of the registered query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.rules_frame(spark, URL_RULES)).drop("bad_mean", "bad_lower")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op8_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_genetic_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(read(spark, sf_dir, "documents"))


def op13_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_url_filter": op2_url_filter,
    "op3_language_id": op3_language_id,
    "op4_license_scan": op4_license_scan,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_bpe_encode_decode": op6_bpe_encode_decode,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_hash_prefix_forest": op8_hash_prefix_forest,
    "op9_bloom_lm": op9_bloom_lm,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_genetic_packing": op11_genetic_packing,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_lanczos_whitening": op13_lanczos_whitening,
}
ORACLE_SQL: dict[str, str] = {"op2_url_filter": url_filter.oracle(URL_RULES), "op4_license_scan": license_scan.oracle(), "op12_merkle_manifest": manifest.oracle()}
