"""Stored answers read again and made ready without asking a model.

A log of answers is JSON lines, appended to whenever a question was answered: an id may come several times, and a line
may be broken. Lines that aren't records, or have no id, are kept apart; of an id's records the one with the latest time
counts, on ties the one with the larger digest, so that the order of files and lines decides nothing. Answers are made
ready by column expressions, and figures are counted while they are written, in the same pass.

Cases: null and empty answers are made ready as empty ones; an empty folder of lines gives no answers; further fields of
a record are ignored; records without a time come before those with one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import submission

RECORD = "id string, at long, question string, answer string, sources array<string>, image_ids array<string>, references array<struct<title:string,text_snippet:string>>"
BROKEN = "_broken"


class Log(NamedTuple):
    """answers: the last record of each id. broken: lines that are no records."""

    answers: DataFrame
    broken: DataFrame


def read(spark: SparkSession, path: str) -> Log:
    lines = spark.read.text(path).where(F.trim("value") != "")
    record = F.from_json("value", f"{RECORD}, {BROKEN} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    rows = lines.select("value", record.alias("r"))
    fine = F.col(f"r.{BROKEN}").isNull() & F.col("r.id").isNotNull()
    empty = F.array().cast("array<string>")
    # A sum over each task's rows goes before the shuffle, so that an id with very many records is no load.
    last = rows.where(fine).groupBy(F.col("r.id").alias("id")).agg(F.max_by("r", F.struct(F.coalesce("r.at", F.lit(-(1 << 62))), F.xxhash64("value"))).alias("r"), F.count(F.lit(1)).alias("n_records"))
    answers = last.select(
        "id", F.col("r.at").alias("at"), F.coalesce("r.question", F.lit("")).alias("question"), F.coalesce("r.answer", F.lit("")).alias("answer"), F.coalesce("r.sources", empty).alias("sources"),
        F.coalesce("r.image_ids", empty).alias("image_ids"), F.coalesce("r.references", F.array().cast("array<struct<title:string,text_snippet:string>>")).alias("references"), "n_records",
    )
    return Log(answers, rows.where(~fine).select("value"))


def renewed(answers: DataFrame, overrides: DataFrame | None = None, template: Column | None = None) -> DataFrame:
    """answers with ret: normalised again, or with a template reprocessed; overrides: id, override (a stated answer).

    The overrides are joined by id at any size, and an id that they name twice takes the first in order.
    """
    rows = answers.withColumn("override", F.lit(None).cast("string"))
    if overrides is not None:
        rows = answers.join(overrides.groupBy("id").agg(F.min("override").alias("override")), "id", "left")
    if template is not None:
        return rows.withColumn("ret", submission.reprocessed("answer", "question", "image_ids", template, F.col("override")))
    return rows.withColumn("ret", F.coalesce("override", submission.normalized("answer", "question", "sources", "image_ids", "references")))


def write(rows: DataFrame, path: str) -> dict[str, int]:
    """Writes id and ret as CSV, and gives the figures of A11, counted by the tasks that write."""
    figures = submission.reprocess_counts()
    seen = Observation("reprocess")
    observed = rows.observe(seen, *figures)
    observed.select("id", "ret").write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return {k: int(v) for k, v in seen.get.items()}
