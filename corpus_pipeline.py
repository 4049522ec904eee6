"""A training-data pipeline over `documents`: each stage works on all that its predecessor kept.

Language ID, near-copy removal, substring dedup, mixing to target weights, and BPE encoding. All stages but the last return the
columns of `documents`; doc_id is unique up to the mix, which repeats documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, jaccard_join, language_id, mixing, substring_dedup
from spanloom.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose words speak for their language by less than this against the next one (0.5: as much for it) go.
LEAST_SCORE = 0.55


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text is null, has no letter, or has a language that the model (learned from these rows) can't tell."""
    docs = docs.select(*COLUMNS)
    found = language_id.identify(docs, language_id.train(docs))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the document with the least doc_id stays."""
    return jaccard_join.without_near_copies(docs.select(*COLUMNS), n_words=5, num=80, den=100)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur in an earlier document leave the text, and n_chars follows; a document left without text goes."""
    kept = substring_dedup.dedup_substrings(docs.select(*COLUMNS))
    kept = kept.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    return kept.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document of the mix, with digests of ids and decoded text."""
    return bpe.encode_documents(docs, keep_ids=True)


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("substring dedup", substring_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: Language models, shingle joins and merges are no SQL; tests hold run() against a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
