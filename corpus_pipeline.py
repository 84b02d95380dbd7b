"""A corpus pipeline of five stages: quality, repeated lines, near copies, mixing, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import byte_bpe, line_dedup, mixing, quality_crf, simhash_dedup
from lodestrata.llm.common import file_bytes, table
from lodestrata.plans.shared import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; a null or empty text counts as the average document does."""
    field = quality_crf.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_crf.score_column(spark, field) >= quality_crf.THRESHOLD)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every line in one place. n_chars follows the text where it was right before; a document may end up empty."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash links stays."""
    return simhash_dedup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every copy that the mix takes."""
    return mixing.take(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of every row."""
    ranks_file = file_bytes(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encode_documents(docs, ranks_file, public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality", quality), ("line_dedup", lines), ("simhash_dedup", near_copies), ("mixing", mixed), ("byte_bpe", encoded)]

#: The classifier's fit cannot be expressed in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
