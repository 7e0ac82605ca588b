"""The build of a knowledge base: pictures bound to places, chunks with labels, records and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import classify, generate
from .shared import written

# Fixed value: the manual that holds many English products.
OMNIBUS = "汇总英文"


def bind_pictures(manuals: DataFrame, key: str = "manual_id", text: str = "text", ids: str = "image_ids") -> DataFrame:
    """Key, pos, image_id (null where ids have run out): the n-th place takes the n-th id, ids left over are ignored."""
    places = F.regexp_count(F.col(text), F.lit("(?i)<PIC>"))
    rows = manuals.where(places > 0).select(key, F.explode(F.sequence(F.lit(0), places - 1)).alias("pos"), F.col(ids).alias("ids"))
    return rows.select(key, "pos", F.get("ids", F.col("pos")).alias("image_id"))


def marked_text(text: Column, ids: Column) -> Column:
    """J7 within a text: each place becomes its picture's marker."""
    parts = F.split(text, "(?i)<PIC>")
    marker = lambda k: F.coalesce(F.concat(F.lit("\n[[PIC:"), F.get(ids, k - 1), F.lit("]]\n")), F.lit("\n[[PIC_MISSING]]\n"))
    return F.array_join(F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(F.concat(marker(k), p))), "")


def picture_mismatch(manuals: DataFrame, key: str = "manual_id", pics: str = "pic_count", ids: str = "image_ids") -> DataFrame:
    """A4: manuals whose places and ids differ in number."""
    n, m = F.col(pics), F.size(ids)
    return manuals.where(n != m).select(key, n.cast("long").alias("pic_count"), m.cast("long").alias("image_count"), F.greatest(n - m, F.lit(0)).cast("long").alias("unmatched_pic_count"), F.greatest(m - n, F.lit(0)).cast("long").alias("extra_image_count"))


def picture_records(files: DataFrame, manual_refs: DataFrame, chunk_refs: DataFrame) -> DataFrame:
    """Every picture that a folder, a manual or a chunk names, with who refers to it."""
    m = manual_refs.groupBy("image_id").agg(F.array_sort(F.collect_set("manual_id")).alias("referenced_by"))
    c = chunk_refs.groupBy("image_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    out = files.withColumn("exists", F.lit(True)).join(m, "image_id", "full_outer").join(c, "image_id", "full_outer")
    return out.withColumn("exists", F.coalesce("exists", F.lit(False)))


def missing_pictures(manual_refs: DataFrame, files: DataFrame) -> DataFrame:
    """References without a file, once for each manual."""
    return manual_refs.join(files.select("image_id"), "image_id", "left_anti").select("manual_id", "image_id").distinct()


def chunk_manuals(manuals: DataFrame, max_chars: int = generate.MAX_CHARS) -> DataFrame:
    """Chunks of manuals with ids, numbers and labels. manuals: manual_id, product_name, source_path, text, image_ids."""
    marked = manuals.withColumn("marked", marked_text(F.col("text"), F.col("image_ids")))
    sections = marked.select("manual_id", F.posexplode(generate.sections("marked")).alias("section_index", "section")).where(~classify.toc_like("section"))
    sections = sections.withColumn("row", F.struct("manual_id", "section_index", T.title("section").alias("title")))
    parts = generate.pack_chunks(sections.withColumn("units", generate.sentence_units("section")), "units", max_chars, "row")
    parts = parts.select("row.*", "part", T.without_markers("chunk").alias("text"), generate.marker_ids("chunk").alias("image_ids"))
    parts = parts.where((F.col("text") != "") & ~classify.low_value("text", F.col("image_ids")))
    order = Window.partitionBy("manual_id").orderBy("section_index", "part")
    parts = parts.withColumn("chunk_index", F.row_number().over(order) - 1)
    out = parts.join(manuals.select("manual_id", "product_name", "source_path"), "manual_id")
    english = F.col("product_name") == OMNIBUS
    domain = F.when(english, classify.domain(F.concat("title", F.lit("\n"), "text"))).otherwise("")
    out = out.withColumns({"chunk_id": T.chunk_id("manual_id", "chunk_index", "text"), "char_count": F.length("text"), "is_toc": classify.toc_like("text"), "has_ocr_noise": classify.ocr_noise("text"), "semantic_type": classify.semantic_type("title", "text"), "domain_label": domain})
    # Written once; only ids and labels go through the scans.
    out = written(out.withColumn("__row", F.monotonically_increasing_id()), "chunks")
    near = classify.backfill_domain(out.select("__row", "manual_id", "chunk_index", "domain_label"), "manual_id", "chunk_index")
    out = out.drop("domain_label").join(near.select("__row", "domain_label", "domain_inferred"), "__row").withColumn("domain_inferred", F.col("domain_inferred") & english)
    out = out.withColumn("domain_label", F.when(english, F.col("domain_label")).otherwise(""))
    unlabelled = english & (F.col("domain_label") == "") | F.col("domain_inferred") & F.lit(False)
    score = classify.clean_score(F.col("is_toc"), F.col("has_ocr_noise"), unlabelled | F.col("domain_inferred")) + F.when(F.col("domain_inferred"), 0.05).otherwise(0.0)
    steps = classify.step_count("text")
    meta = F.struct(
        (F.size("image_ids") > 0).alias("has_image"), F.col("domain_label"), F.col("is_toc"), F.col("has_ocr_noise"), F.col("semantic_type"),
        (F.col("semantic_type") == "procedure").alias("is_procedure"), ((F.col("semantic_type") == "safety_warning") & (steps < 2)).alias("is_warning_only"),
        F.round(score, 2).alias("clean_score"), F.col("domain_inferred"),
    )
    return out.select("chunk_id", "manual_id", "product_name", "source_path", "title", "text", "image_ids", "section_index", "chunk_index", "char_count", meta.alias("metadata"))


def rollup(chunks: DataFrame, key: str, size: str) -> DataFrame:
    """A2: chunks and characters of each manual."""
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunk_count"), F.sum(size).cast("long").alias("char_count"))
