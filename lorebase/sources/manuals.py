"""Scans of raw manuals, pictures, questions and fixtures; a manual that can't be parsed goes to quarantine."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import common_escapes, manual_text, strip

PAYLOAD = "struct<text:string,ids:array<string>,ok:boolean>"
# Fixed value: a list of quoted ids that ends a broken manual.
TAIL = r'(?s),\s*(\[(?:"[^"]+"\s*,\s*)*"[^"]*"\s*\])\s*\]\s*$'


def literal_payload(raw: Column) -> Column:
    """A Python literal of text and ids; only rows that no JSON parser took come here."""

    @F.pandas_udf(PAYLOAD)
    def run(column: pd.Series) -> pd.DataFrame:
        rows = []
        for x in column:
            try:
                data = ast.literal_eval(x) if x is not None else None
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                rows.append((None, None, None))
                continue
            ok = isinstance(data, list) and len(data) >= 2 and isinstance(data[1], list)
            rows.append((str(data[0]), [str(i) for i in data[1]], True) if ok else (None, None, False))
        return pd.DataFrame(rows, columns=["text", "ids", "ok"])

    return run(raw)


def parse(raw: DataFrame, value: str = "value") -> DataFrame:
    """S3: adds text, image_ids and parse_mode (json, literal, tail-recovery, or failed) to raw files.

    A file that a parser takes but that isn't a list of text and list fails; it doesn't fall through to the next.
    """
    v = F.col(value)
    plain = {"allowSingleQuotes": "false"}
    as_json = F.from_json(v, "array<string>", plain)
    out = raw.withColumn("__j", as_json).withColumn("__ids", F.from_json(F.get("__j", F.lit(1)), "array<string>", plain))
    is_list = strip(v).startswith("[") & F.col("__j").isNotNull()
    # Any other whole JSON value is taken too, and is of the wrong shape.
    is_other = ~strip(v).startswith("[") & F.try_parse_json(v).isNotNull()
    json_taken = is_list | is_other
    json_right = is_list & (F.size("__j") >= 2) & F.col("__ids").isNotNull()
    out = out.withColumn("__json", F.when(json_right, "right").when(json_taken, "wrong").otherwise("no"))
    # The literal parser sees null for rows that are done, so that no text is sent to Python for them.
    out = out.withColumn("__l", literal_payload(F.when(F.col("__json") == "no", v)))
    tail = F.regexp_extract(v, TAIL, 1)
    head = F.regexp_replace(strip(F.regexp_replace(v, F.lit(TAIL), F.lit(""))), F.lit(r'^\["?|"$'), F.lit(""))
    recovered = tail != ""
    mode = F.when(F.col("__json") == "right", "json").when(F.col("__json") == "wrong", "failed").when(F.col("__l.ok"), "literal").when(F.col("__l.ok") == F.lit(False), "failed").when(recovered, "tail-recovery").otherwise("failed")
    out = out.withColumn("parse_mode", mode)
    text = F.when(F.col("parse_mode") == "json", F.get("__j", F.lit(0))).when(F.col("parse_mode") == "literal", F.col("__l.text")).when(F.col("parse_mode") == "tail-recovery", common_escapes(head))
    ids = F.when(F.col("parse_mode") == "json", F.col("__ids")).when(F.col("parse_mode") == "literal", F.col("__l.ids")).when(F.col("parse_mode") == "tail-recovery", F.from_json(tail, "array<string>"))
    return out.withColumn("text", text).withColumn("image_ids", ids).drop("__j", "__ids", "__json", "__l")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Whole text files as manuals: manual_id, product_name, source_path, text, image_ids, pic_count, parse_mode."""
    raw = spark.read.text(f"{folder}/*.txt", wholetext=True).select("value", F.col("_metadata.file_path").alias("source_path"))
    stem = F.regexp_replace(F.element_at(F.split(F.url_decode("source_path"), "/"), -1), F.lit(r"\.txt$"), F.lit(""))
    out = parse(raw).withColumn("manual_id", stem).withColumn("text", manual_text("text"))
    return out.select("manual_id", F.regexp_replace("manual_id", F.lit("手册$"), F.lit("")).alias("product_name"), "source_path", "text", "image_ids", F.regexp_count("text", F.lit("(?i)<PIC>")).alias("pic_count"), "parse_mode")


def quarantine(manuals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manuals that were parsed, and those that weren't."""
    failed = F.col("parse_mode") == "failed"
    return manuals.where(~failed), manuals.where(failed)


def pictures(spark: SparkSession, folder: str) -> DataFrame:
    """image_id, file_name, path; of files with one stem the last in order wins."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(name.alias("file_name"), "path").where(F.lower("file_name").rlike(r"\.(jpg|jpeg|png)$"))
    stem = F.regexp_replace("file_name", F.lit(r"\.[^.]+$"), F.lit(""))
    return rows.groupBy(stem.alias("image_id")).agg(F.max(F.struct("file_name", "path")).alias("f")).select("image_id", "f.*")


def chunks_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a stated schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def fixture(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of cases."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def questions_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Id and question; another header is an error; limit takes the first by id."""
    header = spark.read.text(path).first()
    if header is None or header[0].lstrip("﻿").strip() != "id,question":
        raise ValueError("the header must be id,question")
    rows = spark.read.schema("id string, question string").csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=True)
    return rows if limit is None else rows.orderBy(F.col("id").try_cast("long") if hasattr(F.col("id"), "try_cast") else "id", "id").limit(limit)


def question_lines(spark: SparkSession, path: str) -> DataFrame:
    """One question a line; blank lines and comments are skipped."""
    rows = spark.read.text(path).select(strip("value").alias("question"))
    return rows.where((F.col("question") != "") & ~F.col("question").startswith("#"))


def encoded_picture(c: str) -> Column:
    """The bytes of Base64 text or a data URL; null if it is neither."""
    body = F.regexp_replace(F.col(c), F.lit("^data:[^,]*,"), F.lit(""))
    return F.try_to_binary(F.regexp_replace(body, F.lit(r"\s+"), F.lit("")), F.lit("base64"))
