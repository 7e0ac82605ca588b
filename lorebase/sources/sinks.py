"""Sinks: tables of the knowledge base, JSON lines, answer files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1, K2, K7, K8: JSON lines; append for a debug log."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_tables(tables: dict[str, DataFrame], folder: str, keys: dict[str, str] | None = None) -> None:
    """K3, K5, K9: one Parquet table each; a repeated key is an error, as in a table with a primary key."""
    for name, df in tables.items():
        key = (keys or {}).get(name)
        if key and df.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{name}.{key} isn't unique")
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_postings(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """K4: postings by ranges of terms, so that a query's terms prune files by their statistics."""
    postings.repartitionByRange(buckets, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def write_answers_csv(df: DataFrame, path: str) -> None:
    """K6: id and ret with a byte order mark before the header."""
    df.select(F.col("id").alias("﻿id"), "ret").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
