"""A training-corpus pipeline: language ID, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, which has the columns of `documents`; all but the
last return these columns. Rows without an id are neither compared nor cut, but filtered and tokenised like others; rows that repeat an id are kept or dropped
together; null and empty texts go in the first stage; an empty table passes every stage. `run` writes each stage's rows as Parquet in the cluster's shared folder and reads them
again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirewarden.llm import language_id
from wirewarden.llm.bpe import encode_decode
from wirewarden.llm.common import exclude, read, shared_folder
from wirewarden.llm.decontaminate import without_leaks
from wirewarden.llm.jaccard_join import jaccard_components
from wirewarden.llm.substring_dedup import remove_duplicates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that have no language for the network: null texts and those without a letter. Documents without `lang` get the predicted one.
    Where no row has a label there is nothing to predict from, and `lang` stays null."""
    network = language_id.train(docs)
    if network is None:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    kept = language_id.predict(docs, network, keep=COLUMNS[1:]).filter(F.col("lang_pred") != language_id.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of linked documents."""
    groups = jaccard_components(docs)
    return exclude(docs.select(*COLUMNS), groups.filter("component_id <> doc_id").select("doc_id"), "doc_id")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words in windows of 50 words that a document with a smaller id has."""
    cut = remove_duplicates(docs, keep=("lang", "source", "n_chars"))
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length.cast("long")).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy of a benchmark item."""
    return without_leaks(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_decode(docs, TOKENIZER).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("bpe_encode_decode", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Language identification and the exact joins are not expressible in SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None
