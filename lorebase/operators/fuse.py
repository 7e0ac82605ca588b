"""Fusion of ranked lists, evidence, context and confidence; every rule is a window or an aggregate over whole query sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact, overlap_in
from .index import top

# Fixed values of fusion and evidence.
RRF_K = 60
TOP_LEAST, KEEP_LEAST, KEPT = 4.0, 3.0, 4
CONTEXT_CHARS, CUT_LEAST = 4000, 200
NO_CANDIDATES = 0.15


def rrf(lists: list[DataFrame], k: int | None = None, key: str = "chunk_id") -> DataFrame:
    """query_id, key, rrf_score. lists: query_id, key, rank from 1; a row's score is the sum of 1 / (60 + rank)."""
    rows = reduce(DataFrame.unionByName, [x.select("query_id", key, "rank") for x in lists])
    out = rows.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 6).alias("rrf_score"), F.count(F.lit(1)).alias("n_lists"))
    return out if k is None else top(out, "query_id", [F.col("rrf_score").desc(), F.col(key)], k, "rrf_rank")


def hybrid(sparse: DataFrame, dense: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """Both lists are cut at max(2k, 10), fused and cut at k; without dense rows the sparse order is kept."""
    fetch = max(2 * k, 10)
    return rrf([sparse.where(F.col("rank") <= fetch), dense.where(F.col("rank") <= fetch)], k, key)


def fuse_variants(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """query_id, key, fusion_score, variant_hits, score. rows: query_id, variant_no from 0, rank from 0, key, score.

    The score folds over the variants in order: the first sets it, each later one takes the larger and adds 1.2. So it
    is the largest of each variant's own points plus 1.2 for each variant after it, and for itself but for the first,
    which is one aggregate.
    """
    points = F.col("score") + F.greatest(F.lit(0.0), 2.6 - 0.25 * F.col("rank")) + F.when(F.col("variant_no") > 0, 1.0).otherwise(0.0)
    w = Window.partitionBy("query_id", key).orderBy("variant_no")
    n = Window.partitionBy("query_id", key)
    rows = rows.withColumn("__p", points).withColumn("__k", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(n))
    return rows.groupBy("query_id", key).agg(
        F.round(F.max(F.col("__p") + 1.2 * (F.col("__n") - F.col("__k") + (F.col("__k") > 1).cast("int"))), 3).alias("fusion_score"), F.count(F.lit(1)).alias("variant_hits"), F.max("score").alias("score")
    )


def evidence_score(rows: DataFrame) -> DataFrame:
    """Adds evidence_score and the overlaps. rows: score, title, text, n_images, variant_hits, query_terms, image_terms, component_terms, status_terms, issue_terms.

    Rows that share a title and a text may have them as __t and __x in place of these, made compact once."""
    if "__x" not in rows.columns:
        rows = rows.withColumns({"__t": compact("title"), "__x": compact("text")})
    both = F.concat("__t", "__x")  # compact texts have no line end between them
    q, i, u = (overlap_in(both, F.col(c)) for c in ("query_terms", "image_terms", "issue_terms"))
    tc, xc, ts, xs = (overlap_in(F.col(w), F.col(c)) for c in ("component_terms", "status_terms") for w in ("__t", "__x"))
    out = rows.withColumns({"query_overlap": q, "image_overlap": i, "issue_overlap": u, "__tc": tc, "__xc": xc, "__ts": ts, "__xs": xs})
    out = out.withColumns({"component_overlap": F.col("__tc") + F.col("__xc"), "status_overlap": F.col("__ts") + F.col("__xs")})
    shown, seen = F.col("n_images") > 0, F.col("image_overlap") > 0
    add = lambda test, v: F.when(test, v).otherwise(0.0)
    total = (
        F.col("score")
        + F.least(1.1 * F.col("query_overlap"), F.lit(5.0))
        + F.least(1.8 * F.col("image_overlap"), F.lit(5.4))
        + F.least(1.8 * F.col("__tc") + 0.9 * F.col("__xc"), F.lit(4.8))
        + F.least(1.2 * F.col("__ts") + 1.5 * F.col("__xs"), F.lit(4.6))
        + F.least(1.6 * F.col("issue_overlap"), F.lit(3.2))
        + add(shown & seen, 1.0)
        + add((F.col("component_overlap") > 0) & (F.col("status_overlap") > 0), 2.0)
        + add((F.col("issue_overlap") > 0) & shown, 0.8)
        + add(F.col("variant_hits") >= 2, 1.5)
        - add(~seen & (F.size("image_terms") > 0) & (F.col("query_overlap") <= 1) & ~shown, 1.2)
    )
    return out.withColumn("evidence_score", F.round(total, 3)).drop("__tc", "__xc", "__ts", "__xs", "__t", "__x")


def evidence_order() -> list[Column]:
    """L7."""
    return [F.col("evidence_score").desc(), (F.col("component_overlap") + F.col("status_overlap")).desc(), F.col("image_overlap").desc(), F.col("query_overlap").desc(), F.col("n_images").desc(), F.col("chunk_id")]


def filter_evidence(rows: DataFrame, order: list[Column], score: str = "evidence_score", kept: int = KEPT) -> DataFrame:
    """Of queries whose best row has enough points, the first rows of the best row's product, one for each title."""
    w = Window.partitionBy("query_id").orderBy(*order)
    best = rows.withColumns({"__n": F.row_number().over(w), "__p": F.first("product_name").over(w), "__s": F.first(score).over(w)})
    fit = best.where((F.col("__s") >= TOP_LEAST) & (F.col(score) >= KEEP_LEAST) & ((F.col("__p") == "") | (F.col("product_name") == F.col("__p"))))
    key = compact("title")
    first = fit.withColumn("__k", F.row_number().over(Window.partitionBy("query_id", key).orderBy("__n"))).where((F.col("__k") == 1) | (key == ""))
    return top(first, "query_id", [F.col("__n")], kept, "evidence_rank").drop("__n", "__p", "__s", "__k")


def context_sizes(rows: DataFrame, size: Column, most: int = CONTEXT_CHARS) -> DataFrame:
    """Adds kept_chars and is_reference to the rows whose part fits, or is the first that doesn't and is cut: all that
    is decided of a context without its texts. size: a part's length. rows: query_id, evidence_rank."""
    w = Window.partitionBy("query_id").orderBy("evidence_rank")
    out = rows.withColumn("__size", size).withColumn("__upto", F.sum("__size").over(w)).withColumn("__before", F.col("__upto") - F.col("__size"))
    whole = F.col("__upto") <= most
    out = out.withColumn("__first", (~whole) & (F.coalesce(F.lag(F.col("__upto")).over(w), F.lit(0)) <= most))
    left = F.lit(most) - F.col("__before")
    cut = F.col("__first") & (left > CUT_LEAST)
    out = out.where(whole | cut).withColumn("kept_chars", F.when(whole, F.col("__size")).otherwise(left)).withColumn("is_reference", whole)
    return out.drop("__size", "__upto", "__before", "__first")


def cut_part(part: Column) -> Column:
    """A part as far as it is kept, beside kept_chars and is_reference."""
    return F.when(F.col("is_reference"), part).otherwise(F.concat(F.substring(part, F.lit(1), F.col("kept_chars").cast("int")), F.lit("……")))


def context_parts(rows: DataFrame, most: int = CONTEXT_CHARS) -> DataFrame:
    """Adds part, kept_chars and is_reference: whole parts while they fit, the first that doesn't is cut if enough is left.

    Lengths are positive, so that a running sum tells where parts stop fitting. rows: query_id, evidence_rank, part.
    """
    return context_sizes(rows, F.length("part"), most).withColumn("part", cut_part(F.col("part")))


def part_text(n: Column, product: Column, title: Column, score: Column, text: Column, ids: Column | None = None) -> Column:
    """A part's head and body."""
    head = F.concat(F.lit("[参考"), n.cast("string"), F.lit("] 产品："), product, F.lit(" | 章节："), title, F.lit(" | 检索分："), score.cast("string"), F.lit("\n"), F.trim(text))
    return head if ids is None else F.when(F.size(ids) > 0, F.concat(head, F.lit("\n（相关配图："), F.array_join(ids, ", "), F.lit("）"))).otherwise(head)


def confidence(rows: DataFrame, score: str = "score", rank: str = "rank", queries: DataFrame | None = None) -> DataFrame:
    """query_id, confidence from the best score and its lead over the second.

    queries: all query_ids, of which those without a row get 0.15.
    """
    r = F.col(rank)
    best = rows.groupBy("query_id").agg(F.max(F.when(r == 1, F.col(score))).alias("a"), F.coalesce(F.max(F.when(r == 2, F.col(score))), F.lit(0.0)).alias("b"))
    value = 0.35 + F.least(F.col("a") / 50.0, F.lit(0.45)) + F.least(F.greatest(F.col("a") - F.col("b"), F.lit(0.0)) / 40.0, F.lit(0.15))
    found = best.select("query_id", F.round(F.least(value, F.lit(0.95)), 2).alias("confidence"))
    if queries is None:
        return found
    return queries.select("query_id").distinct().join(found, "query_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(NO_CANDIDATES)))


def mean_confidence(rows: DataFrame, key: str = "query_id") -> DataFrame:
    """Key, confidence: the mean over a question's parts."""
    return rows.groupBy(key).agg(F.round(F.avg("confidence"), 2).alias("confidence"))


def ordered_distinct(rows: DataFrame, group: str, order: str, values: str, most: int | None = None) -> DataFrame:
    """The values of a group's rows in order, each once, at most so many."""
    lists = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(values).alias("v")))).alias("l"))
    flat = F.array_distinct(F.flatten(F.transform("l", lambda x: x["v"])))
    return lists.select(group, (flat if most is None else F.slice(flat, 1, most)).alias(values))
