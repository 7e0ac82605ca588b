"""Queries of text normalisation (T1 to T22) over documents, pages, events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T
from .base import TITLED, lit, query, squeeze, strip, table


@query(r"SELECT doc_id, md5(regexp_replace(lower(text), '\s+', '', 'g')) AS norm_md5, length(regexp_replace(lower(text), '\s+', '', 'g')) AS n FROM documents")
def normalize_text(spark, sf_dir):
    norm = T.compact("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(norm.cast("binary")).alias("norm_md5"), F.length(norm).cast("long").alias("n"))


@query(rf"""SELECT item_id, {squeeze(rf"regexp_replace({strip('text')}, '[，,。；;：:！!？?()\[\]" + '"' + "“”‘’]', ' ', 'g')")} AS query_text FROM benchmark""")
def query_text(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.query_text("text").alias("query_text"))


@query(f"WITH {TITLED} SELECT doc_id, title FROM titled")
def derive_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.title("text").alias("title"))


@query("SELECT doc_id, left(regexp_replace(lower(text), '[^a-zA-Z0-9一-鿿]+', '', 'g'), 240) AS sentence_key FROM documents")
def sentence_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.sentence_key("text").alias("sentence_key"))


@query(f"SELECT conv_id, turn, md5({strip('text')}) AS said_md5 FROM conversations")
def strip_think(spark, sf_dir):
    said = F.concat(F.lit("<think>"), F.left("text", F.lit(50)), F.lit("\n</think> "), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.without_thinking(said).cast("binary")).alias("said_md5"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_parse(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT doc_id, 'chunk_' || substr(sha1(concat_ws(':', source, doc_id, left(text, 120))), 1, 12) AS chunk_id FROM documents")
def chunk_id_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.chunk_id("source", "doc_id", "text").alias("chunk_id"))


def _ocr_sql() -> str:
    x = "text"
    for old, new in lexicon.OCR_PAIRS:
        x = f"replace({x}, {lit(old)}, {lit(new)})"
    steps = [(r"(^|[^\p{L}\p{N}_])lf($|[^\p{L}\p{N}_])", r"\1If\2"), ("([,.;:!?])([A-Za-z])", r"\1 \2"), ("([a-z])([0-9])", r"\1 \2"), ("([0-9])([A-Za-z])", r"\1 \2")]
    # Without look-around a capital that ends one match can't begin the next, hence twice.
    steps += [("([a-z])([A-Z][a-z])", r"\1 \2")] * 2
    sql = f"SELECT doc_id, {x} AS x FROM documents"
    for pattern, to in steps:
        sql = f"SELECT doc_id, regexp_replace(x, {lit(pattern)}, {lit(to)}, 'g') AS x FROM ({sql})"
    return f"SELECT doc_id, md5(x) AS repaired_md5 FROM ({sql})"


@query(_ocr_sql())
def ocr_repair(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.ocr_repair("text").cast("binary")).alias("repaired_md5"))


def _latex_sql() -> str:
    sql = "SELECT doc_id, text AS x FROM documents"
    for pattern, to in ((r"\\[A-Za-z]+\*?", " "), (r"\\[,;:!~% ]+", " "), (r"[{}$]+", " "), (r"[_^]\s*[A-Za-z0-9+\-*/=().]+", " "), (r"\s+([,.;:!?])", r"\1")):
        sql = f"SELECT doc_id, regexp_replace(x, {lit(pattern)}, {lit(to)}, 'g') AS x FROM ({sql})"
    return f"SELECT doc_id, md5(x) AS plain_md5 FROM ({sql})"


@query(_latex_sql())
def latex_noise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.without_latex("text").cast("binary")).alias("plain_md5"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def unicode_unescape(spark, sf_dir):
    """Documents with some letters written as escapes come back as they were."""
    coded = F.col("text")
    for c in "éèßüñçó":
        coded = F.replace(coded, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.unescape(coded).cast("binary")).alias("text_md5"))


@query(
    f"""WITH {TITLED}, ids AS (SELECT doc_id, title, list_transform(range(doc_id % 4), lambda k: 'img_' || doc_id || '_' || k) AS ids FROM titled)
    SELECT doc_id, CASE WHEN len(ids) > 0 THEN '"' || title || repeat('<PIC>', len(ids)) || '";[' || list_aggregate(list_transform(ids, lambda i: '"' || i || '"'), 'string_agg', ', ') || ']'
           ELSE title END AS ret FROM ids"""
)
def image_suffix(spark, sf_dir):
    ids = F.transform(F.slice(F.sequence(F.lit(0), F.lit(3)), F.lit(1), (F.col("doc_id") % 4).cast("int")), lambda k: F.concat(F.lit("img_"), F.col("doc_id").cast("string"), F.lit("_"), k.cast("string")))
    rows = table(spark, sf_dir, "documents").select("doc_id", T.title("text").alias("title"), ids.alias("ids"))
    return rows.select("doc_id", T.picture_suffix("title", "ids").alias("ret"))


_TAGS = ((r"(?s)<(script|style)\b.*?</(script|style)>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]*>", " "), ("&amp;", "&"), (r"\s+", " "))


def _pages_sql() -> str:
    sql = "SELECT page_id, url, html AS x FROM pages"
    for pattern, to in _TAGS:
        sql = f"SELECT page_id, url, regexp_replace(x, {lit(pattern)}, {lit(to)}, 'g') AS x FROM ({sql})"
    return f"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, md5(trim(x)) AS text_md5, length(trim(x)) AS n FROM ({sql})"


@query(_pages_sql())
def pages_clean_text(spark, sf_dir):
    x = F.col("html")
    for pattern, to in _TAGS:
        x = T.sub(x, pattern, to)
    x = F.trim(x)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.md5(x.cast("binary")).alias("text_md5"), F.length(x).cast("long").alias("n"))
