"""Retrieval modes behind one contract: a mode takes questions and an index and gives query_id, chunk_id, score, rank.

An index is a folder of tables: chunks, postings, statistics, and vectors by chunk_id (a vector hit finds its chunk by that
id, not by a row's place). Modes are looked up by name, so that others can be added.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dense, fuse
from . import index as I


class Index(NamedTuple):
    """The tables of an index; vectors may be missing."""

    chunks: DataFrame
    postings: DataFrame
    statistics: DataFrame
    vectors: DataFrame | None = None


def build(chunks: DataFrame, folder: str, model=None) -> None:
    """Writes an index over chunk_id, text and what else chunks have. model as in dense.embed; False: no vectors."""
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
    I.postings(chunks, "chunk_id").repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/postings")
    I.statistics(chunks).write.mode("overwrite").parquet(f"{folder}/statistics")
    if model is not False:
        dense.embed(chunks.select("chunk_id", "text"), model=model).select("chunk_id", "embedding").write.mode("overwrite").parquet(f"{folder}/vectors")


def load(spark: SparkSession, folder: str) -> Index:
    """The tables of an index. Vectors that were never written are no error."""
    from pyspark.errors import AnalysisException

    tables = [spark.read.parquet(f"{folder}/{name}") for name in ("chunks", "postings", "statistics")]
    try:
        vectors = spark.read.parquet(f"{folder}/vectors")
    except AnalysisException:
        vectors = None
    return Index(*tables, vectors)


def sparse(questions: DataFrame, index: Index, k: int) -> DataFrame:
    """BM25 over the postings. questions: query_id, text and, for vectors, embedding."""
    terms = questions.select("query_id", F.explode(F.array_distinct(I.terms("text"))).alias("term"))
    return I.best(I.gathered(terms, index.postings, index.statistics, "chunk_id"), k).withColumnRenamed("bm25", "score")


def vector(questions: DataFrame, index: Index, k: int) -> DataFrame:
    """Ten times the cosine, to three places."""
    if index.vectors is None:
        raise ValueError("this index has no vectors")
    asked = questions if "embedding" in questions.columns else dense.embed(questions)
    found = dense.search(index.vectors, asked.select(F.col("query_id").alias("chunk_id"), "embedding"), k, "chunk_id")
    return found.select("query_id", F.col("near_id").alias("chunk_id"), F.round(10 * F.col("cosine"), 3).alias("score"), "rank")


def hybrid(questions: DataFrame, index: Index, k: int) -> DataFrame:
    """Both lists, fused by their ranks; without vectors the words alone."""
    fetch = max(2 * k, 10)
    words = sparse(questions, index, fetch)
    near = vector(questions, index, fetch) if index.vectors is not None else words.limit(0)
    fused = fuse.hybrid(words, near, k)
    return fused.select("query_id", "chunk_id", F.col("rrf_score").alias("score"), F.col("rrf_rank").alias("rank"))


#: V1, V2, V3, V5: modes by name.
MODES: dict[str, Callable[[DataFrame, Index, int], DataFrame]] = {"sparse": sparse, "vector": vector, "hybrid": hybrid}


def retrieve(mode: str, questions: DataFrame, index: Index, k: int = 10) -> DataFrame:
    """query_id, chunk_id, score, rank and the chunk's other columns, by a mode's name; an unknown one is an error."""
    if mode not in MODES:
        raise ValueError(f"no retrieval mode {mode!r}; there are {', '.join(sorted(MODES))}")
    return MODES[mode](questions, index, k).join(index.chunks, "chunk_id")


def variants(questions: DataFrame) -> DataFrame:
    """variant_no, variant, query_id, text: the question alone, with a picture's summary, and with what the picture shows.

    questions: query_id, text, summary (null or empty without a picture), visual (struct of generate.visual_terms).
    """
    terms = F.array_join(F.slice(F.array_distinct(F.flatten(F.array(*[F.coalesce(F.col(f"visual.{n}"), F.array().cast("array<string>")) for n in ("component_terms", "status_terms", "issue_terms", "other_terms")]))), 1, 8), " ")
    pictured = F.coalesce(F.col("summary"), F.lit("")) != ""
    own = F.array(
        F.struct(F.lit(0).alias("variant_no"), F.lit("text_only").alias("variant"), F.col("text").alias("text")),
        F.when(pictured, F.struct(F.lit(1).alias("variant_no"), F.lit("multimodal_fused").alias("variant"), F.concat_ws(" ", "text", "summary").alias("text"))),
        F.when(pictured & (terms != ""), F.struct(F.lit(2).alias("variant_no"), F.lit("visual_focus").alias("variant"), F.concat_ws(" ", F.col("text"), terms).alias("text"))),
    )
    return questions.select("query_id", F.explode(F.filter(own, lambda v: v.isNotNull())).alias("v")).select("query_id", "v.*")


def retrieve_variants(mode: str, questions: DataFrame, index: Index, k: int = 10) -> DataFrame:
    """Each variant is searched by itself and the lists are fused: query_id, chunk_id, fusion_score, variant_hits, score."""
    asked = variants(questions)
    rows = retrieve(mode, asked.select(F.struct("query_id", "variant_no").alias("query_id"), "text"), index, k)
    rows = rows.select("query_id.query_id", "query_id.variant_no", (F.col("rank") - 1).alias("rank"), "chunk_id", "score")
    return I.top(fuse.fuse_variants(rows), "query_id", [F.col("fusion_score").desc(), F.col("chunk_id")], k)


def references(parts: DataFrame, results: DataFrame) -> DataFrame:
    """Results of a question's parts with the part they answer, in order. parts: query_id, sub_id, text. results: query_id, sub_id, rank, ..."""
    own = parts.select("query_id", "sub_id", F.col("text").alias("sub_question_text"), F.regexp_extract("sub_id", "[0-9]+", 0).cast("int").alias("sub_question_index"))
    return results.join(own, ["query_id", "sub_id"])


def resolved_pictures(rows: DataFrame, pictures: DataFrame, probed: DataFrame | None = None, key: str = "query_id", ids: str = "image_ids") -> DataFrame:
    """Key, images: each row's ids in order as structs of image_id, file_name and exists; an id that the index lacks is looked for among the probed files."""
    wanted = rows.select(key, F.posexplode(ids).alias("pos", "image_id"))
    found = wanted.join(pictures.select("image_id", F.col("file_name").alias("known")), "image_id", "left")
    found = found.join(probed.select("image_id", F.col("file_name").alias("other")), "image_id", "left") if probed is not None else found.withColumn("other", F.lit(None).cast("string"))
    name = F.coalesce("known", "other")
    own = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "image_id", name.alias("file_name"), name.isNotNull().alias("exists")))).alias("l"))
    return rows.select(key).join(own, key, "left").select(key, F.coalesce(F.transform("l", lambda x: F.struct(x["image_id"].alias("image_id"), x["file_name"].alias("file_name"), x["exists"].alias("exists"))), F.array().cast("array<struct<image_id:string,file_name:string,exists:boolean>>")).alias("images"))
