"""Registered queries of a question's parts with their results, and of text operators that other queries use in passing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify, fuse, generate, retrieve, submission
from ..operators import index as I
from ..operators.shared import shared_dir
from ..sources import replay
from . import planted
from .base import ORACLE_SQL, TERMS, lit, query, squeeze, strip, table
from .planted import over_conversations, over_documents
from .search_queries import _BM25

PART_K, MOST_SOURCES = 3, 5


def _parts(spark, sf_dir):
    """query_id, sub_id, text: the parts of each user turn."""
    rows = planted.conversations(spark, sf_dir).where("role = 'user'").select(F.concat("conv_id", F.lit(":"), "turn").alias("query_id"), F.explode(generate.sub_questions("text")).alias("q"))
    return rows.select("query_id", "q.sub_id", F.col("q.normalized").alias("text"))


def _results(spark, sf_dir):
    """query_id, sub_id, rank, chunk_id, source, score: the first documents of each part by BM25."""
    docs = table(spark, sf_dir, "documents")
    asked = _parts(spark, sf_dir).select(F.struct("query_id", "sub_id").alias("owner"), F.explode(F.array_distinct(I.terms("text"))).alias("term")).where(F.length("term") >= 3)
    first = I.best(I.hits(asked, docs), PART_K, "owner")
    return first.join(docs.select("doc_id", "source"), "doc_id").select("owner.query_id", "owner.sub_id", "rank", F.col("doc_id").alias("chunk_id"), "source", F.col("bm25").alias("score"))


_PARTS = f"""{planted._TURNS}, sp AS ({ORACLE_SQL["split_questions"]}), pt AS (SELECT conv_id || ':' || turn AS owner, sub_id, CAST(substr(sub_id, 2) AS INTEGER) AS sub_question_index, normalized, conv_id || ':' || turn || '|' || sub_id AS query_id FROM sp),
qt AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({TERMS.format('normalized')}) AS term FROM pt) WHERE length(term) >= 3),
{_BM25[_BM25.index('dt AS'):]}, rs AS (SELECT query_id, owner, sub_id, sub_question_index, normalized, doc_id, source, bm25, rank FROM bm JOIN pt USING (query_id) JOIN documents USING (doc_id) WHERE rank <= {PART_K})"""


@query(f"WITH {_PARTS} SELECT owner AS query_id, sub_id, sub_question_index, normalized AS sub_question_text, CAST(rank AS INTEGER) AS rank, doc_id AS chunk_id FROM rs")
def part_references(spark, sf_dir):
    """What was found for a question's parts, with the part it belongs to."""
    found = retrieve.references(_parts(spark, sf_dir), _results(spark, sf_dir))
    return found.select("query_id", "sub_id", "sub_question_index", "sub_question_text", "rank", "chunk_id")


@query(
    f"""WITH {_PARTS}, ab AS (SELECT query_id, max(bm25) FILTER (WHERE rank = 1) AS a, coalesce(max(bm25) FILTER (WHERE rank = 2), 0) AS b FROM rs GROUP BY 1),
    cf AS (SELECT owner, CASE WHEN a IS NULL THEN 0.15 ELSE round(least(0.35 + least(a / 50.0::DOUBLE, 0.45) + least(greatest(a - b, 0.0) / 40.0::DOUBLE, 0.15), 0.95), 2) END::DOUBLE AS c FROM pt LEFT JOIN ab USING (query_id)),
    so AS (SELECT owner, source, min(sub_question_index * 100 + rank) AS o FROM rs GROUP BY 1, 2),
    sl AS (SELECT owner, array_to_string(list(source ORDER BY o)[1:{MOST_SOURCES}], '|') AS sources FROM so GROUP BY 1)
    SELECT owner AS query_id, round(CAST(CAST(avg(c) AS VARCHAR) AS DECIMAL(30, 20)), 2)::DOUBLE AS confidence, count(*) AS n_parts, coalesce(any_value(sources), '') AS sources FROM cf LEFT JOIN sl USING (owner) GROUP BY 1"""
)
def part_answers(spark, sf_dir):
    """A question's confidence is the mean of its parts'; their sources in order, each once, at most five."""
    parts, results = _parts(spark, sf_dir), _results(spark, sf_dir)
    key = lambda df: df.withColumn("query_id", F.struct("query_id", "sub_id"))
    sure = fuse.confidence(key(results), "score", "rank", key(parts)).select("query_id.query_id", "confidence")
    ordered = retrieve.references(parts, results).select("query_id", (F.col("sub_question_index") * 100 + F.col("rank")).alias("at"), F.array("source").alias("sources"))
    listed = fuse.ordered_distinct(ordered, "query_id", "at", "sources", MOST_SOURCES)
    mean = fuse.mean_confidence(sure).join(sure.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_parts")), "query_id")
    return mean.join(listed, "query_id", "left").select("query_id", "confidence", "n_parts", F.coalesce(F.array_join("sources", "|"), F.lit("")).alias("sources"))


# Turns ask for pictures by the letters of their conversation; some the index has, some only the folder, some neither.
_IDS = "[conv_id % 5, turn % 3, conv_id % 2 + 10, 99]"


@query(f"""WITH w AS (SELECT conv_id || ':' || turn AS query_id, unnest({_IDS}) AS i, generate_subscripts({_IDS}, 1) AS k FROM conversations WHERE role = 'user'),
    f AS (SELECT *, CASE WHEN i IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) THEN 'p' || i || '.png' WHEN i IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) THEN 'p' || i || '.jpg' END AS n FROM w)
    SELECT query_id, string_agg('p' || i || '=' || coalesce(n, 'missing'), ',' ORDER BY k) AS images FROM f GROUP BY 1""")
def turn_pictures(spark, sf_dir):
    """Pictures of turns in order, out of the index, else out of the files that were found."""
    docs = table(spark, sf_dir, "documents")
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat("conv_id", F.lit(":"), "turn").alias("query_id"), F.array(*[F.concat(F.lit("p"), F.expr(x).cast("string")) for x in _IDS[1:-1].split(", ")]).alias("image_ids"))
    files = lambda n, end: docs.where(F.col("doc_id") % n == 0).select(F.concat(F.lit("p"), "doc_id").alias("image_id"), F.concat(F.lit("p"), "doc_id", F.lit(end)).alias("file_name"))
    found = retrieve.resolved_pictures(rows, files(2, ".png"), files(3, ".jpg"))
    return found.select("query_id", F.array_join(F.transform("images", lambda x: F.concat(x["image_id"], F.lit("="), F.coalesce(x["file_name"], F.lit("missing")))), ",").alias("images"))


@query(over_conversations(rf"""WITH t AS (SELECT conv_id, turn, {squeeze(strip("regexp_replace('\"' || text || ':(*', '[\"''():*]+', ' ', 'g')"))} AS term FROM conversations) SELECT conv_id, turn, CASE WHEN length(term) >= 2 THEN term ELSE '' END AS term FROM t"""))
def search_terms(spark, sf_dir):
    """T7."""
    rows = planted.conversations(spark, sf_dir).select("conv_id", "turn", F.concat(F.lit('"'), "text", F.lit(":(*")).alias("said"))
    return rows.select("conv_id", "turn", T.search_term("said").alias("term"))


@query(over_documents(rf"""WITH a AS (SELECT doc_id, {strip("regexp_replace(replace(replace('**`' || text || '`** `', '**', ''), '`', ''), '[ \\t]+', ' ', 'g')")} AS plain,
    left({strip(squeeze(r"regexp_replace(text, '(^|\n)\s*\d+[.、)]\s*', '；', 'g')"))}, 200) AS caption FROM documents) SELECT doc_id, md5(plain) AS plain_md5, length(plain) AS n_chars FROM a"""))
def plain_text(spark, sf_dir):
    """T14."""
    rows = planted.documents(spark, sf_dir).select("doc_id", T.without_markdown(F.concat(F.lit("**`"), "text", F.lit("`** `"))).alias("plain"))
    return rows.select("doc_id", F.md5(F.col("plain").cast("binary")).alias("plain_md5"), F.length("plain").cast("long").alias("n_chars"))


@query(over_documents(r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) >= 8 AND len(regexp_extract_all(text, '[A-Za-z]')) > len(regexp_extract_all(text, '[一-鿿]')) AS ascii_heavy FROM documents"""))
def ascii_heavy(spark, sf_dir):
    """P16."""
    return planted.documents(spark, sf_dir).select("doc_id", classify.ascii_heavy("text").alias("ascii_heavy"))


@query(over_documents(rf"""SELECT doc_id, md5(trim({squeeze(r"regexp_replace(replace(regexp_replace(text || ' [[PIC:a]] -', '\[\[PIC[^\]]*\]\]', ' ', 'g'), '#', ' '), '\\u[0-9a-fA-F]{4}', ' ', 'g')")}, ' -|')) AS evidence_md5 FROM documents"""))
def evidence_text(spark, sf_dir):
    """T10."""
    rows = planted.documents(spark, sf_dir).select("doc_id", T.evidence(F.concat("text", F.lit(" [[PIC:a]] -"))).alias("e"))
    return rows.select("doc_id", F.md5(F.col("e").cast("binary")).alias("evidence_md5"))


@query("""WITH m AS (SELECT doc_id, regexp_extract_all(text || '[[PIC:p' || doc_id % 7 || ']] [[PIC:q]][[PIC:p' || doc_id % 3 || ']]', '\\[\\[PIC:([^\\]]+)\\]\\]', 1) AS ids FROM documents)
    SELECT doc_id, array_to_string(list_filter(ids, lambda x, k: list_position(ids, x) = k), ',') AS image_ids FROM m""")
def marker_lists(spark, sf_dir):
    """G17."""
    marked = F.concat("text", F.lit("[[PIC:p"), (F.col("doc_id") % 7).cast("string"), F.lit("]] [[PIC:q]][[PIC:p"), (F.col("doc_id") % 3).cast("string"), F.lit("]]"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(generate.marker_ids(marked), ",").alias("image_ids"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'UNKNOWN，未知尺寸，' ELSE 'PNG，' || page_id % 900 || 'x' || length(url) || '，' END || printf('%.1f', octet_length(encode(html)) / 1024.0::DOUBLE) || 'KB' AS summary FROM pages WHERE html IS NOT NULL""")
def file_summaries(spark, sf_dir):
    """A line for each page as if it were a file of its bytes; every fourth has no known sides."""
    rows = table(spark, sf_dir, "pages").where("html IS NOT NULL")
    known, side = F.col("page_id") % 4 != 0, lambda c: F.when(F.col("page_id") % 4 != 0, c)
    line = T.file_summary(F.when(known, "PNG").otherwise("UNKNOWN"), F.octet_length("html"), side((F.col("page_id") % 900).cast("int")), side(F.length("url")))
    return rows.select("page_id", line.alias("summary"))


# A log of answers: each assistant's turn, with a label, as a refusal, empty or plain, by its number; every third comes
# twice, first with other words; every seventh line is broken.
_TEMPLATE, _OVERRIDE = "我们会尽快为您核实处理。", "请以包装内的说明为准。"
_SAID = "CASE n % 5 WHEN 0 THEN '结论：' || text WHEN 1 THEN '根据现有资料无法回答此问题。' WHEN 2 THEN '' ELSE text END"
_ASKED = "CASE WHEN n % 2 = 0 THEN '我要退货' ELSE '怎么充电' END"
_NUMBERED = "SELECT conv_id || '-' || turn AS id, 7 * conv_id + turn AS n, text FROM conversations WHERE role = 'assistant' AND text IS NOT NULL"


def _log(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant' AND text IS NOT NULL").select(F.concat("conv_id", F.lit("-"), "turn").alias("id"), (7 * F.col("conv_id") + F.col("turn")).alias("n"), "text")
    ids = F.when(F.col("n") % 3 == 0, F.array(F.concat(F.lit("p"), (F.col("n") % 4).cast("string")))).otherwise(F.array().cast("array<string>"))
    last = F.struct("id", F.col("n").cast("long").alias("at"), F.expr(_ASKED).alias("question"), F.expr(_SAID).alias("answer"), ids.alias("image_ids"))
    old = F.struct("id", (F.col("n") - 1).cast("long").alias("at"), F.lit("alt").alias("question"), F.lit("an older answer, which no longer counts").alias("answer"), ids.alias("image_ids"))
    lines = F.array_compact(F.array(F.to_json(last), F.when(F.col("n") % 3 == 0, F.to_json(old)), F.when(F.col("n") % 7 == 0, F.lit('{"id": "broken'))))
    folder = shared_dir(spark, "answers")
    rows.select(F.explode(lines).alias("value")).write.text(folder)
    overrides = rows.where("n % 11 = 0").select("id", F.lit(_OVERRIDE).alias("override"))
    return replay.read(spark, folder), overrides


_READY = rf"""b AS ({_NUMBERED}), s AS (SELECT id, n, {_ASKED} AS question, {_SAID} AS answer, CASE WHEN n % 3 = 0 THEN 'p' || n % 4 END AS pic FROM b),
    c AS (SELECT *, trim({strip(squeeze("replace(answer, '结论：', '')"))}, ' |;；，,。') AS t FROM s),
    d AS (SELECT *, CASE WHEN n % 5 = 1 OR length(regexp_replace(t, '\s+', '', 'g')) < 15 THEN NULL WHEN regexp_matches(t, '[。！？.!?]$') THEN t ELSE t || '。' END AS own FROM c),
    e AS (SELECT *, CASE WHEN n % 11 = 0 THEN {lit(_OVERRIDE)} WHEN own IS NULL AND n % 2 = 0 THEN {lit(_TEMPLATE)}
        WHEN pic IS NULL THEN coalesce(own, {lit(submission.MANUAL_ANSWER)}) ELSE '"' || rtrim(coalesce(own, {lit(submission.MANUAL_ANSWER)}), '。！？.!?') || '<PIC>。";["' || pic || '"]' END AS ret FROM d)"""


@query(f"WITH {_READY} SELECT id, CAST(CASE WHEN n % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_records, md5(ret) AS ret_md5 FROM e")
def replayed_answers(spark, sf_dir):
    """A log of answers read again; the last record of an id, made ready."""
    log, overrides = _log(spark, sf_dir)
    rows = replay.renewed(log.answers, overrides, F.lit(_TEMPLATE))
    return rows.select("id", "n_records", F.md5(F.col("ret").cast("binary")).alias("ret_md5"))


@query(f"""WITH {_READY} SELECT count(*) AS total, count(*) FILTER (WHERE pic IS NOT NULL) AS with_images, count(*) FILTER (WHERE contains(ret, '<PIC>')) AS with_pic, count(*) FILTER (WHERE n % 11 = 0) AS cs_specific,
    count(*) FILTER (WHERE n % 11 <> 0 AND n % 2 = 0 AND n % 5 = 1) AS cs_template, count(*) FILTER (WHERE n % 5 = 1 AND NOT contains(ret, '根据现有资料')) AS refusal_cleaned, count(*) FILTER (WHERE n % 7 = 0) AS broken FROM e""")
def replay_figures(spark, sf_dir):
    """Figures of the answers as they are made ready, and broken lines."""
    log, overrides = _log(spark, sf_dir)
    figures = submission.reprocess_statistics(replay.renewed(log.answers, overrides, F.lit(_TEMPLATE)))
    broken = log.broken.agg(F.count(F.lit(1)).alias("broken")).withColumn("k", F.lit(1))
    return figures.withColumn("k", F.lit(1)).join(broken, "k").drop("k")
