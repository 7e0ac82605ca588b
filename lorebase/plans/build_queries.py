"""Queries of the build of a knowledge base: sections, chunks, pictures, labels, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T
from ..operators import classify, generate, ingest, tables
from ..operators.scan import numbered
from ..sources import manuals
from . import planted
from .base import ORACLE_SQL, TITLED, any_in, lit, query, squeeze, strip, table
from .planted import over_documents


@query(over_documents(rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '(^|\n)(#\s+)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '') AS p FROM documents),
    e AS (SELECT doc_id, unnest(p) AS section, generate_subscripts(p, 1) - 1 AS section_index FROM s)
    SELECT doc_id, CAST(section_index AS INTEGER) AS section_index, length(section) AS n_chars, md5(section) AS section_md5 FROM e"""))
def section_split(spark, sf_dir):
    rows = planted.documents(spark, sf_dir).select("doc_id", F.posexplode(generate.sections("text")).alias("section_index", "s"))
    return rows.select("doc_id", "section_index", F.length("s").cast("long").alias("n_chars"), F.md5(F.col("s").cast("binary")).alias("section_md5"))


_UNITS = rf"""units AS (
    SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([。！？!?；;])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'), lambda x: {strip('x')}), lambda x: x <> '') AS u
    FROM documents
)"""


@query(f"WITH {_UNITS} SELECT doc_id, len(u) AS n_units, md5(coalesce(array_to_string(u, '|'), '')) AS units_md5 FROM units")
def sentence_units(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", generate.sentence_units("text").alias("u"))
    return rows.select("doc_id", F.size("u").cast("long").alias("n_units"), F.md5(F.array_join("u", "|").cast("binary")).alias("units_md5"))


@query(
    f"""WITH RECURSIVE {_UNITS},
    e AS (SELECT doc_id, unnest(u) AS unit, generate_subscripts(u, 1) AS k FROM units),
    f AS (
        SELECT doc_id, k, unit, length(unit) AS n, 0 AS part, CAST(CASE WHEN length(unit) > 1200 THEN -1 ELSE length(unit) + 1 END AS BIGINT) AS size FROM e WHERE k = 1
        UNION ALL
        SELECT e.doc_id, e.k, e.unit, length(e.unit),
               CASE WHEN length(e.unit) <= 1200 AND f.size >= 0 AND f.size + length(e.unit) + 1 <= 1200 THEN f.part ELSE f.part + 1 END,
               CAST(CASE WHEN length(e.unit) > 1200 THEN -1 WHEN f.size < 0 THEN length(e.unit) + 1
                    WHEN f.size + length(e.unit) + 1 <= 1200 THEN f.size + length(e.unit) + 1 ELSE length(e.unit) END AS BIGINT)
        FROM f JOIN e ON e.doc_id = f.doc_id AND e.k = f.k + 1
    ),
    g AS (SELECT doc_id, part, string_agg(unit, chr(10) ORDER BY k) AS chunk, max(n) AS n FROM f GROUP BY doc_id, part),
    h AS (
        SELECT doc_id, part, 0 AS j, chunk FROM g WHERE n <= 1200
        UNION ALL
        SELECT doc_id, part, j, substr(chunk, j * 1200 + 1, 1200) FROM (SELECT *, unnest(range((n + 1199) // 1200)) AS j FROM g WHERE n > 1200)
    ),
    t AS (SELECT doc_id, part, j, {strip('chunk')} AS chunk FROM h)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part, j) - 1 AS INTEGER) AS part, length(chunk) AS n_chars, md5(chunk) AS chunk_md5 FROM t WHERE chunk <> ''"""
)
def pack_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", generate.sentence_units("text").alias("units"))
    packed = generate.pack_chunks(rows, "units")
    return packed.select("doc_id", "part", F.length("chunk").cast("long").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


# The same rows by table functions in SQL.
def _by_sql(spark, text: str, **frames):
    tables.register(spark)
    return spark.sql(text, **frames)


@query(ORACLE_SQL["section_split"])
def section_split_sql(spark, sf_dir):
    """V8, G1."""
    return _by_sql(spark, "SELECT d.doc_id, s.section_index, CAST(length(s.section) AS LONG) AS n_chars, md5(CAST(s.section AS BINARY)) AS section_md5 FROM {docs} d, LATERAL section_rows(d.text) s", docs=planted.documents(spark, sf_dir))


@query(ORACLE_SQL["sentence_units"])
def sentence_units_sql(spark, sf_dir):
    """A row stays one row, be it without units or of an id that comes twice."""
    text = """SELECT doc_id, CASE WHEN said THEN count(pos) END AS n_units, md5(CAST(array_join(transform(array_sort(collect_list(CASE WHEN pos IS NOT NULL THEN struct(pos, unit) END)), x -> x.unit), '|') AS BINARY)) AS units_md5
        FROM {docs} d, LATERAL unit_rows(d.text, true) u GROUP BY row, doc_id, said"""
    docs = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.col("text").isNotNull().alias("said"))
    return _by_sql(spark, text, docs=docs)


@query(ORACLE_SQL["pack_chunks"])
def pack_chunks_sql(spark, sf_dir):
    """Units of a document are a partition of the function's table."""
    text = """WITH units AS (SELECT d.doc_id, u.pos, u.unit FROM {docs} d, LATERAL unit_rows(d.text) u)
        SELECT doc_id, part, CAST(length(chunk) AS LONG) AS n_chars, md5(CAST(chunk AS BINARY)) AS chunk_md5 FROM chunk_rows(TABLE(units) PARTITION BY doc_id ORDER BY pos)"""
    return _by_sql(spark, text, docs=table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_index FROM documents")
def chunk_number(spark, sf_dir):
    rows = numbered(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"], "n")
    return rows.select("doc_id", "source", (F.col("n") - 1).alias("chunk_index"))


@query("SELECT source, count(*) AS chunk_count, CAST(sum(n_chars) AS BIGINT) AS char_count FROM documents GROUP BY source")
def manual_rollup(spark, sf_dir):
    return ingest.rollup(table(spark, sf_dir, "documents"), "source", "n_chars")


@query(
    """SELECT count(DISTINCT source) AS manual_count, count(*) AS chunk_count, CAST(sum(n_chars) AS BIGINT) AS char_count, CAST(max(n_chars) AS BIGINT) AS largest,
    count(*) FILTER (WHERE contains(text, '# ')) AS with_heading FROM documents"""
)
def build_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(
        F.count_distinct("source").alias("manual_count"), F.count(F.lit(1)).alias("chunk_count"), F.sum("n_chars").cast("long").alias("char_count"), F.max("n_chars").cast("long").alias("largest"),
        F.count_if(F.col("text").contains("# ")).alias("with_heading"),
    )


# Manuals with picture places out of documents: each line end is a place, ids come from the document's number.
_PICTURED = """pictured AS (
    SELECT doc_id, len(string_split(text, chr(10))) - 1 AS pic_count, list_transform(range(doc_id % 12), lambda k: 'img_' || (doc_id // 3) || '_' || k) AS ids FROM documents
),
refs AS (SELECT doc_id, unnest(ids) AS image_id FROM pictured),
files AS (SELECT DISTINCT image_id, image_id || '.png' AS file_name FROM refs WHERE substr(md5(image_id), 1, 1) < 'c')"""


def _pictured(spark, sf_dir):
    ids = F.transform(F.slice(F.sequence(F.lit(0), F.lit(11)), F.lit(1), (F.col("doc_id") % 12).cast("int")), lambda k: F.concat(F.lit("img_"), F.floor(F.col("doc_id") / 3).cast("string"), F.lit("_"), k.cast("string")))
    text = F.replace("text", F.lit("\n"), F.lit("\n<PIC>\n"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("manual_id"), text.alias("text"), ids.alias("image_ids"))
    return rows.withColumn("pic_count", F.regexp_count("text", F.lit("<PIC>")))


def _refs(manuals):
    return manuals.select("manual_id", F.explode("image_ids").alias("image_id"))


def _files(manuals):
    return _refs(manuals).where(F.substring(F.md5(F.col("image_id").cast("binary")), 1, 1) < "c").select("image_id", F.concat("image_id", F.lit(".png")).alias("file_name")).distinct()


@query(f"WITH {_PICTURED} SELECT doc_id AS manual_id, CAST(pos AS INTEGER) AS pos, ids[pos + 1] AS image_id FROM (SELECT *, unnest(range(pic_count)) AS pos FROM pictured)")
def image_binding(spark, sf_dir):
    return ingest.bind_pictures(_pictured(spark, sf_dir))


@query(f"WITH {_PICTURED} SELECT doc_id AS manual_id, pic_count, len(ids) AS image_count, greatest(pic_count - len(ids), 0) AS unmatched_pic_count, greatest(len(ids) - pic_count, 0) AS extra_image_count FROM pictured WHERE pic_count <> len(ids)")
def pic_mismatch(spark, sf_dir):
    return ingest.picture_mismatch(_pictured(spark, sf_dir))


@query(f"WITH {_PICTURED} SELECT DISTINCT doc_id AS manual_id, image_id FROM refs WHERE image_id NOT IN (SELECT image_id FROM files)")
def missing_images(spark, sf_dir):
    rows = _pictured(spark, sf_dir)
    return ingest.missing_pictures(_refs(rows), _files(rows))


@query(
    f"""WITH {_PICTURED}, b AS (SELECT doc_id, ids[pos + 1] AS image_id FROM (SELECT *, unnest(range(pic_count)) AS pos FROM pictured)),
    r AS (SELECT image_id, string_agg(DISTINCT doc_id, ',' ORDER BY doc_id) AS referenced_by FROM refs GROUP BY 1),
    c AS (SELECT image_id, string_agg(DISTINCT doc_id, ',' ORDER BY doc_id) AS chunk_ids FROM b WHERE image_id IS NOT NULL GROUP BY 1)
    SELECT image_id, file_name, file_name IS NOT NULL AS "exists", referenced_by, chunk_ids FROM r FULL JOIN files USING (image_id) FULL JOIN c USING (image_id)"""
)
def image_records(spark, sf_dir):
    rows = _pictured(spark, sf_dir)
    bound = ingest.bind_pictures(rows).where("image_id is not null").withColumnRenamed("manual_id", "chunk_id")
    out = ingest.picture_records(_files(rows), _refs(rows), bound)
    return out.select("image_id", "file_name", "exists", F.array_join("referenced_by", ",").alias("referenced_by"), F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'literal' WHEN 2 THEN 'tail-recovery' ELSE 'failed' END AS parse_mode,
    CASE WHEN doc_id % 4 < 3 THEN md5(CASE WHEN doc_id % 4 = 2 THEN 'a "b" ' ELSE '' END || trim(regexp_replace(text, '[^a-zA-Z0-9]+', ' ', 'g'))) END AS text_md5,
    CASE WHEN doc_id % 4 < 3 THEN 2 END AS n_ids FROM documents"""
)
def parse_modes(spark, sf_dir):
    """Raw manuals out of documents, well formed, as Python literals, with broken quotes, and beyond repair."""
    docs = table(spark, sf_dir, "documents").withColumn("t", F.trim(T.sub("text", "[^a-zA-Z0-9]+", " ")))
    ids = [F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit(x)) for x in ("_a", "_b")]
    kind = F.col("doc_id") % 4
    form = lambda head, quote: F.concat(F.lit(head), F.col("t"), F.lit(f"{quote}, [{quote}"), ids[0], F.lit(f"{quote}, {quote}"), ids[1], F.lit(f"{quote}]]"))
    raw = F.when(kind == 0, form('["', '"')).when(kind == 1, form("['", "'")).when(kind == 2, form('["a "b" ', '"')).otherwise(F.concat(F.lit('["'), F.col("t"), F.lit('", no list')))
    out = manuals.parse(docs.select("doc_id", raw.alias("value")))
    return out.select("doc_id", "parse_mode", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.when(F.col("image_ids").isNotNull(), F.size("image_ids")).alias("n_ids"))


_TOC = rf"""(
    SELECT doc_id, CASE WHEN length(c) < 80 THEN hits >= 3 ELSE dotted >= 2 OR (len(rows) >= 6 AND paged / len(rows) >= 0.65) END AS is_toc FROM (
        SELECT *, len(list_filter(rows, lambda x: regexp_matches(x, '\.{{5,}}|…{{3,}}'))) AS dotted, len(list_filter(rows, lambda x: regexp_matches(x, '[0-9]{{1,3}}\s*$'))) AS paged,
               coalesce(list_sum(list_transform(rows, lambda x: len(regexp_extract_all(x, '[A-Za-z][A-Za-z /,''()-]{{2,}}\.?\s*[0-9]{{1,3}}(\s|$)')))), 0) AS hits
        FROM (SELECT doc_id, {strip('text')} AS c, list_filter(list_transform(string_split({strip('text')}, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS rows FROM documents)
    )
)"""


@query(over_documents(f"SELECT doc_id, is_toc FROM {_TOC}"))
def toc_like(spark, sf_dir):
    return planted.documents(spark, sf_dir).select("doc_id", classify.toc_like("text").alias("is_toc"))


@query(
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
    n AS (SELECT *, {squeeze(f"lower({strip("regexp_replace(line, '^[# ]+', '')")})")} AS t FROM l)
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, t = '' OR t IN ('warranty', 'note', 'notes', 'notice') OR (length(t) < 24 AND NOT regexp_matches(t, '[0-9]|[。！？!?；;]'))
           OR (len(list_filter(string_split(t, ' '), lambda w: w <> '')) <= 4 AND (ends_with(t, 'warranty') OR ends_with(t, 'notice'))) AS low_value FROM n"""
)
def low_value(spark, sf_dir):
    """For each line of each document whether it would carry nothing as a fragment."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", classify.low_value("line").alias("low_value"))


_STEPS = r"""len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*(?:[0-9]+[).、]|[A-Z][).]|[a-z][).]|[①-⑳])\s+')))
    + len(regexp_extract_all(text, '(?:^|\s)(?:[0-9]+[).、])\s+[A-Z一-鿿]'))"""


@query(over_documents(f"SELECT doc_id, {_STEPS} AS n_steps FROM documents"))
def step_count(spark, sf_dir):
    return planted.documents(spark, sf_dir).select("doc_id", classify.step_count("text").cast("long").alias("n_steps"))


def semantic_sql() -> str:
    return f"""kinds AS (
    SELECT doc_id, CASE WHEN is_toc THEN 'toc' WHEN warned AND NOT (procedure AND steps >= 2) THEN 'safety_warning' WHEN {any_in('body', lexicon.TROUBLE)} THEN 'troubleshooting'
           WHEN {any_in('body', lexicon.PARTS)} THEN 'parts_list' WHEN {any_in('body', lexicon.SPECIFICATION)} THEN 'specification' WHEN procedure THEN 'procedure'
           WHEN warned OR {any_in('body', lexicon.SAFETY)} THEN 'safety_warning' ELSE 'general' END AS semantic_type
    FROM (SELECT *, {any_in('body', lexicon.PROCEDURE)} OR steps >= 2 AS procedure, {any_in('head', lexicon.SAFETY)} AS warned
          FROM (SELECT doc_id, {squeeze("lower(title || chr(10) || text)")} AS body, {squeeze('lower(title)')} AS head, {_STEPS} AS steps FROM titled)) JOIN {_TOC} USING (doc_id)
)"""


@query(over_documents(f"WITH {TITLED}, {semantic_sql()} SELECT doc_id, semantic_type FROM kinds"))
def semantic_type(spark, sf_dir):
    rows = planted.documents(spark, sf_dir).select("doc_id", "text", T.title("text").alias("title"))
    return rows.select("doc_id", classify.semantic_type("title", "text").alias("semantic_type"))


def domain_sql(text: str, domains: dict[str, tuple[str, ...]], frm: str, key: str) -> str:
    """key, domain, score, pos of every domain with a hint."""
    def point(h):
        test = f"contains(t, {lit(h)})" if " " in h or "-" in h else f"list_contains(w, {lit(h)})"
        return f"CASE WHEN {test} THEN {2 if ' ' in h else 1} ELSE 0 END"
    rows = ", ".join("{" + f"'pos': {k}, 'domain': {lit(n)}, 'score': {' + '.join(map(point, h))}" + "}" for k, (n, h) in enumerate(domains.items()))
    return rf"""(SELECT {key}, d.domain AS domain, d.score AS score, d.pos AS pos FROM (
        SELECT {key}, unnest([{rows}]) AS d FROM (SELECT {key}, t, regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+') AS w FROM (SELECT {key}, {squeeze(f'lower({text})')} AS t FROM {frm}))) WHERE d.score > 0)"""


_BEST = f"(SELECT doc_id, arg_max(domain, score * 100 - pos) AS domain FROM {domain_sql('text', lexicon.CHUNK_DOMAINS, 'documents', 'doc_id')} GROUP BY doc_id)"


@query(over_documents(f"SELECT doc_id, coalesce(domain, '') AS domain FROM documents LEFT JOIN {_BEST} USING (doc_id)"))
def domain_argmax(spark, sf_dir):
    return planted.documents(spark, sf_dir).select("doc_id", classify.domain("text").alias("domain"))


@query(over_documents(f"SELECT doc_id, count(*) AS n_groups, string_agg(domain, ',' ORDER BY pos) AS groups FROM {domain_sql('text', lexicon.QUERY_DOMAINS, 'documents', 'doc_id')} GROUP BY doc_id"))
def domain_groups(spark, sf_dir):
    rows = planted.documents(spark, sf_dir).select("doc_id", classify.domain_groups("text").alias("g")).where(F.size("g") > 0)
    return rows.select("doc_id", F.size("g").cast("long").alias("n_groups"), F.array_join("g", ",").alias("groups"))


@query(over_documents(f"""WITH b AS (SELECT doc_id, is_toc, regexp_matches(text, {lit(classify.NOISE)}) AS noise FROM documents JOIN {_TOC} USING (doc_id))
    SELECT doc_id, greatest(1, 10 - CASE WHEN is_toc THEN 4 ELSE 0 END - CASE WHEN noise THEN 2 ELSE 0 END - CASE WHEN coalesce(domain, '') = '' THEN 1 ELSE 0 END) / 10.0::DOUBLE AS clean_score
    FROM b LEFT JOIN {_BEST} USING (doc_id)"""))
def clean_score(spark, sf_dir):
    score = classify.clean_score(classify.toc_like("text"), classify.ocr_noise("text"), classify.domain("text") == "")
    return planted.documents(spark, sf_dir).select("doc_id", score.alias("clean_score"))


@query(over_documents(f"""WITH r AS (SELECT doc_id, source, coalesce(domain, '') AS d, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents LEFT JOIN {_BEST} USING (doc_id)),
    w AS (SELECT *, last_value(CASE WHEN d <> '' THEN n END IGNORE NULLS) OVER p AS pn, last_value(CASE WHEN d <> '' THEN d END IGNORE NULLS) OVER p AS pd,
                 first_value(CASE WHEN d <> '' THEN n END IGNORE NULLS) OVER f AS fn, first_value(CASE WHEN d <> '' THEN d END IGNORE NULLS) OVER f AS fd
          FROM r WINDOW p AS (PARTITION BY source ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY source ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    x AS (SELECT *, CASE WHEN pd = fd AND n - pn <= 12 AND fn - n <= 12 THEN pd WHEN n - pn <= 5 THEN pd WHEN fn - n <= 5 THEN fd END AS g FROM w)
    SELECT doc_id, CASE WHEN d = '' AND g IS NOT NULL THEN g ELSE d END AS domain_label, d = '' AND g IS NOT NULL AS domain_inferred FROM x"""))
def domain_backfill(spark, sf_dir):
    rows = planted.documents(spark, sf_dir).select("doc_id", "source", classify.domain("text").alias("domain_label"))
    return classify.backfill_domain(rows, "source", "doc_id").select("doc_id", "domain_label", "domain_inferred")


@query()
def knowledge_base(spark, sf_dir):
    """The whole build over documents as manuals; its parts have SQL of their own."""
    rows = table(spark, sf_dir, "documents")
    own = rows.select(F.col("doc_id").cast("string").alias("manual_id"), F.when(F.col("lang") == "en", ingest.OMNIBUS).otherwise(F.col("source")).alias("product_name"), F.col("source").alias("source_path"), F.col("text"), F.array().cast("array<string>").alias("image_ids"))
    out = ingest.chunk_manuals(own)
    return out.select("chunk_id", "manual_id", "section_index", "chunk_index", "char_count", "title", "metadata.*")
