"""Answers and evidence read texts where they are: what is shuffled and written has none."""

import os
import sys

from pyspark.sql import functions as F

from lorebase.operators import fuse, index, orchestrate

sys.path.insert(0, os.path.dirname(__file__))
from test_growth import QUERIES, agrees, documents  # noqa: E402
from test_orchestrate import TEXTS, parts, run  # noqa: E402, F401


def test_turns_are_answered_without_writing_texts(spark, parts, monkeypatch):  # noqa: F811
    search, topics, scenarios = parts
    said = [(c, 0, "How to press the brake lever") for c in range(6)] + [(9, 0, "Charge the battery"), (10, 0, "zebra crossing")]
    whole = run(spark, parts, said)
    seen, asked, write = [], [], orchestrate.written
    monkeypatch.setattr(orchestrate, "written", lambda df, what: seen.append(df.columns) or write(df, what))

    def narrow(questions, k):
        asked.append(questions.count())
        return search(questions, k).select("query_id", "chunk_id", "score")

    chunks = spark.createDataFrame(TEXTS, "chunk_id long, text string, title string, product_name string")
    monkeypatch.setattr(index, "SENT", 2)  # several passes over the chunks
    got = run(spark, (narrow, topics, scenarios), said, chunks=chunks)
    assert got == whole and asked == [3] and got[9, 0].branch == "manual" and 0 < got[9, 0].faithfulness <= 1
    assert seen and not any({"text", "part", "context"} & set(columns) for columns in seen)


def test_context_is_sized_without_its_texts(spark):
    rows = [(q, r, "ab" * n) for q, lengths in enumerate([[900, 900, 150], [1999, 3], [2000, 1], [5], [2500, 5]]) for r, n in enumerate(lengths, 1)]
    rows = spark.createDataFrame(rows, "query_id long, evidence_rank int, part string")
    want = {tuple(r) for r in fuse.context_parts(rows).select("query_id", "evidence_rank", "kept_chars", "is_reference").collect()}
    got = {tuple(r) for r in fuse.context_sizes(rows.select("query_id", "evidence_rank", F.length("part").alias("n")), F.col("n")).select("query_id", "evidence_rank", "kept_chars", "is_reference").collect()}
    assert got == want and len(got) == 7


def test_found_rows_go_to_the_texts(spark, tmp_path):
    items = spark.createDataFrame([(0, "red lamp"), (1, "boat über green"), (2, "zzz"), (3, "lamp lamp blue x1")], "item_id long, text string")
    docs = documents(spark, 60).dropDuplicates(["doc_id"]).withColumn("text", F.concat("text", F.lit(". More of the red boat and the lamp.")))
    for name in ("evidence_rerank", "evidence_filter", "context_budget"):
        assert agrees(spark, tmp_path / name, name, documents=docs, benchmark=items)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["evidence_rerank"](spark, str(tmp_path / "evidence_rerank"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
