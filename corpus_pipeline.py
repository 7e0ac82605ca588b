"""The corpus pipeline: five stages over `documents`, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm import bpe, decontam, linededup, neardup, quality
from lorebase.llm.common import materialize, shared_dir, table

ID, TEXT = "doc_id", "text"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier rejects go; rows without an id stay, as they can't be named.

    Null texts are scored as empty ones; each row of a repeated id is judged by its own text; an empty table stays empty.
    """
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned blocks that an earlier document has are deleted from the later one; no row goes.

    Null texts and rows without an id stay as they are; an empty table stays empty.
    """
    kept = linededup.dedup(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length(TEXT)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of texts at a five-word similarity of 0.8 stays; rows without an id stay.

    Null texts count as empty, and empty texts are copies of one another; repeated rows of a document that stays all
    stay; an empty table stays empty.
    """
    groups = neardup.groups(docs, ID, TEXT)
    gone = materialize(groups.where(F.col(ID) != F.col("component_id")).select(F.col(ID).alias("id"), "v"), spark, "gone")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(ID).alias("id"), F.xxhash64(F.coalesce(F.col(TEXT), F.lit(""))).alias("v"))
    return rows.join(gone, ["id", "v"], "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item within its budget of edits go; null texts and rows without an id stay."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with what decoding them gives held against the text; null texts have none."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_checked(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("byte_bpe", encode),
]

#: Learned weights, alignments and edit distances are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
