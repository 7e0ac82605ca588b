"""Queries of analysis and retrieval. The benchmark's items are the questions, documents the chunks, sources the products."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T
from ..operators import classify, dense, fuse, generate, grams, rank, retrieve, sums
from ..operators import index as I
from ..operators.shared import written
from . import planted
from .base import TERMS, TITLED, any_in, lit, query, squeeze, strip, table
from .build_queries import domain_sql, semantic_sql
from .planted import over_documents

K = 10
STOP = "(" + ", ".join(lit(w) for w in lexicon.STOP_EN) + ")"
#: The tokens of a query after its punctuation has become space.
QUERY = squeeze(rf"regexp_replace({strip('text')}, '[，,。；;：:！!？?()\[\]" + '"' + "“”‘’]', ' ', 'g')")
TOKENS = f"regexp_extract_all({QUERY}, '{generate.TOKEN.replace(generate.CJK, '一-鿿')}')"


@query(f"SELECT doc_id, len(t) AS n_tokens, md5(coalesce(array_to_string(t, ' '), '')) AS tokens_md5 FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", generate.tokens("text").alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query(
    f"""WITH t AS (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) AS k FROM (SELECT item_id, {TOKENS} AS t FROM benchmark)),
    u AS (SELECT item_id, upper(w) AS w, min(k) AS k FROM t WHERE lower(w) NOT IN {STOP} AND length(w) >= 2 GROUP BY 1, 2)
    SELECT item_id, count(*) AS n, string_agg(w, '|' ORDER BY k) AS keywords FROM u GROUP BY 1"""
)
def ngrams(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", generate.keywords("text").alias("w"))
    return rows.select("item_id", F.size("w").cast("long").alias("n"), F.array_join("w", "|").alias("keywords"))


_WORDS = f"list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9._-]*'), lambda w: lower(w)), lambda w: length(w) >= 3 AND w NOT IN {STOP})"
_GRAMS = "list_filter(list_concat(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k+2], ' ')), list_transform(range(1, len(w)), lambda k: array_to_string(w[k:k+1], ' '))), lambda p: length(p) >= 8)[1:8]"


@query(f"SELECT doc_id, array_to_string({_GRAMS}, '|') AS phrases FROM (SELECT doc_id, {_WORDS} AS w FROM documents)")
def ascii_phrases(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(generate.ascii_phrases("text"), "|").alias("phrases"))


@query(f"SELECT doc_id, m AS model, count(*) AS n FROM (SELECT doc_id, upper(unnest(regexp_extract_all(text, '{generate.MODEL}'))) AS m FROM documents) GROUP BY 1, 2")
def models_products(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(generate.MODEL), F.lit(0))).alias("m"))
    return rows.groupBy("doc_id", F.upper("m").alias("model")).agg(F.count(F.lit(1)).alias("n"))


@query(over_documents("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {any_in('t', h)} THEN {lit(n)} END" for n, h in lexicon.INTENT_HINTS.items())
    + "], lambda x: x IS NOT NULL), ',') AS intents FROM (SELECT doc_id, lower(text) AS t FROM documents)"))
def query_intents(spark, sf_dir):
    return planted.documents(spark, sf_dir).select("doc_id", F.array_join(classify.query_intents("text"), ",").alias("intents"))


_KEYS = {"".join(k.lower().split()): v for k, v in lexicon.SYNONYMS.items()}


@query(over_documents("WITH k AS (SELECT unnest([" + ", ".join("{" + f"'p': {n}, 'k': {lit(k)}, 'v': {list(v)!r}" + "}" for n, (k, v) in enumerate(_KEYS.items()))
    + r"""]) AS s), e AS (SELECT doc_id, s.p AS p, unnest(s.v) AS v, generate_subscripts(s.v, 1) AS i FROM documents, k WHERE contains(regexp_replace(lower(text), '\s+', '', 'g'), s.k))
    SELECT doc_id, string_agg(v, ',' ORDER BY o) AS expanded FROM (SELECT doc_id, v, min(100 * p + i) AS o FROM e GROUP BY 1, 2) GROUP BY 1"""))
def synonyms(spark, sf_dir):
    rows = planted.documents(spark, sf_dir).select("doc_id", generate.synonyms("text").alias("e")).where(F.size("e") > 0)
    return rows.select("doc_id", F.array_join("e", ",").alias("expanded"))


@query(
    f"""WITH g AS (SELECT item_id, {_GRAMS} AS p FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
    t AS (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) AS k FROM (SELECT item_id, {TOKENS} AS t FROM benchmark)),
    a AS (SELECT item_id, unnest(p) AS w, 0 AS b, generate_subscripts(p, 1) AS k FROM g UNION ALL SELECT item_id, upper(w), 1, k + 100 FROM t WHERE lower(w) NOT IN {STOP} AND length(w) >= 2),
    u AS (SELECT item_id, w, min(b) AS b, min(k) AS k FROM a GROUP BY 1, 2)
    SELECT item_id, string_agg(w, '|' ORDER BY b, -len(string_split(w, ' ')), -length(w), k) AS terms FROM u GROUP BY 1"""
)
def term_priority(spark, sf_dir):
    rows = generate.analyze(table(spark, sf_dir, "benchmark"))
    return rows.select("item_id", F.array_join(generate.prioritized(F.col("phrases"), F.col("keywords"), F.col("products")), "|").alias("terms"))


@query(f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) GROUP BY 1, 2) GROUP BY term")
def postings(spark, sf_dir):
    rows = I.postings(table(spark, sf_dir, "documents"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("cf"))


def _questions(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(I.terms("text"))).alias("term"))
    return rows.where(F.length("term") >= 3)


_BM25 = f"""qt AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest({TERMS.format('text')}) AS term FROM benchmark) WHERE length(term) >= 3),
dt AS (SELECT doc_id, {TERMS.format('text')} AS w FROM documents),
st AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM dt),
po AS (SELECT doc_id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM dt) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
sc AS (
    SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS bm25
    FROM qt JOIN po USING (term) JOIN df USING (term), st GROUP BY 1, 2
),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS rank FROM sc) WHERE rank <= 20)"""


def _hits(spark, sf_dir):
    """Where the questions' terms are, with whether the title has them too."""
    return I.hits(_questions(spark, sf_dir), table(spark, sf_dir, "documents"), title=T.title("text"))


def _bm25(spark, sf_dir, k, hits=None):
    return I.best(I.hits(_questions(spark, sf_dir), table(spark, sf_dir, "documents")) if hits is None else hits, k)


@query(f"WITH {_BM25} SELECT query_id, doc_id, bm25, CAST(rank AS INTEGER) AS rank FROM bm WHERE rank <= {K}")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, K)


_KEYWORD = f"""tw AS (SELECT doc_id, list_distinct({TERMS.format('title')}) AS t, list_distinct({TERMS.format('text')}) AS x FROM titled),
hw AS (SELECT doc_id, term, CASE WHEN list_contains(t, term) THEN 3500 ELSE 1200 END AS points FROM (SELECT doc_id, t, unnest(x) AS term FROM tw)),
ks AS (SELECT query_id, doc_id, CAST(sum(points) AS BIGINT) AS score_milli FROM qt JOIN hw USING (term) GROUP BY 1, 2),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score_milli DESC, doc_id) AS rank FROM ks) WHERE rank <= 20)"""


def _keyword(spark, sf_dir, k, hits=None):
    """Terms of the title count 3.5, of the text alone 1.2, in thousandths."""
    hits = _hits(spark, sf_dir) if hits is None else hits
    points = lambda tf, dl, title, value: 1200.0 + 2300.0 * title
    return sums.best(hits.queries, hits.numbers, hits.rows, k, points, score="score_milli").withColumn("score_milli", F.col("score_milli").cast("long"))


@query(f"WITH {TITLED}, {_BM25}, {_KEYWORD} SELECT query_id, doc_id, score_milli, CAST(rank AS INTEGER) AS rank FROM kw WHERE rank <= {K}")
def keyword_topk(spark, sf_dir):
    return _keyword(spark, sf_dir, K)


_RRF = "rf AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf_score, count(*) AS n_lists FROM (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM kw) GROUP BY 1, 2)"


def _lists(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return [f(spark, sf_dir, 2 * K, hits).select("query_id", F.col("doc_id").alias("chunk_id"), "rank") for f in (_bm25, _keyword)]


@query(f"WITH {TITLED}, {_BM25}, {_KEYWORD}, {_RRF} SELECT query_id, doc_id AS chunk_id, rrf_score, n_lists FROM rf")
def rrf(spark, sf_dir):
    return fuse.rrf(_lists(spark, sf_dir))


# The dense side: documents and questions have the embedding of their number, where there is one.
_DENSE = """dn AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) AS INTEGER) AS rank, cosine FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0 AS cosine
    FROM embeddings q JOIN benchmark ON item_id = q.vec_id, embeddings v SEMI JOIN documents ON doc_id = v.vec_id))"""


def _index(spark, sf_dir):
    """The tables of an index over documents with a kept table of vectors."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source")
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    vectors = table(spark, sf_dir, "embeddings").join(own, "vec_id", "left_semi").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return retrieve.Index(docs, I.postings(docs, "chunk_id"), I.statistics(docs), vectors)


def _asked(spark, sf_dir):
    """The questions that have a vector, and their text."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return rows.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")


@query(
    f"""WITH qt AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest({TERMS.format('text')}) AS term FROM benchmark JOIN embeddings ON vec_id = item_id)),
    {_BM25[_BM25.index('dt AS'):]}, {_DENSE},
    rf AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM dn WHERE rank <= 20) GROUP BY 1, 2)
    SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank, source FROM (SELECT query_id, doc_id AS chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM rf) JOIN documents ON doc_id = chunk_id WHERE rank <= {K}"""
)
def hybrid_topk(spark, sf_dir):
    """Words and vectors, fused."""
    return retrieve.retrieve("hybrid", _asked(spark, sf_dir), _index(spark, sf_dir), K).select("query_id", "chunk_id", "score", "rank", "source")


@query(f"WITH {_DENSE} SELECT query_id, doc_id AS chunk_id, round(10 * cosine, 3) AS score, rank FROM dn WHERE rank <= {K}")
def dense_topk(spark, sf_dir):
    """Ten times the cosine."""
    return retrieve.retrieve("vector", _asked(spark, sf_dir), _index(spark, sf_dir), K).select("query_id", "chunk_id", "score", "rank")


@query(
    f"""SELECT query_id, near_id, cosine, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, near_id) AS rank FROM (
            SELECT q.vec_id AS query_id, v.vec_id AS near_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) + 0.0 AS cosine
            FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)) WHERE rank <= {K}"""
)
def vector_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return dense.search(rows, rows.where(F.col("vec_id") % 50 == 0), K)


def _chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), T.title("text").alias("title"), "text", F.col("source").alias("product_name"))


_LIKE = f"""pr AS (
    WITH g AS (SELECT item_id, {_GRAMS} AS p FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
    t AS (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) AS k FROM (SELECT item_id, {TOKENS} AS t FROM benchmark)),
    a AS (SELECT item_id, unnest(p) AS w, 0 AS b, generate_subscripts(p, 1) AS k FROM g UNION ALL SELECT item_id, upper(w), 1, k + 100 FROM t WHERE lower(w) NOT IN {STOP} AND length(w) >= 2),
    u AS (SELECT item_id, w, min(b) AS b, min(k) AS k FROM a GROUP BY 1, 2)
    SELECT item_id AS query_id, w AS term, row_number() OVER (PARTITION BY item_id ORDER BY b, -len(string_split(w, ' ')), -length(w), k) AS n FROM u
),
te AS (SELECT query_id, term, lower(term) AS needle, greatest(16, least(80, 200 // least(count(*) OVER (PARTITION BY query_id), 6))) AS most FROM pr WHERE n <= 14),
lo AS (SELECT doc_id, lower(title) AS lt, lower(text) AS lx, lower(source) AS lp, length(title) AS nt, length(text) AS nx FROM titled),
li AS (
    SELECT query_id, term, doc_id, like_score, n FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, term ORDER BY like_score DESC, nt, nx, doc_id) AS n FROM (
            SELECT query_id, term, doc_id, nt, nx, most, 3 * contains(lt, needle)::INT + 2 * contains(lp, needle)::INT + contains(lx, needle)::INT AS like_score FROM te, lo
            WHERE contains(lt, needle) OR contains(lx, needle) OR contains(lp, needle))) WHERE n <= most
)"""


def _like(spark, sf_dir):
    questions = generate.analyze(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"))
    return rank.like_candidates(questions, _chunks(spark, sf_dir), K)


@query(f"WITH {TITLED}, {_LIKE} SELECT query_id, term, doc_id AS chunk_id, like_score, CAST(n AS INTEGER) AS n FROM li")
def like_candidates(spark, sf_dir):
    return _like(spark, sf_dir)


@query(
    f"""WITH {TITLED}, asked AS (SELECT item_id, text FROM benchmark UNION ALL SELECT -1, 'src1'), {_LIKE.replace('FROM benchmark', 'FROM asked')}, tf AS (SELECT query_id, lower(term) AS needle FROM pr WHERE n <= 10), la AS (SELECT query_id, doc_id, max(like_score) AS like_score FROM li GROUP BY 1, 2),
    few AS (SELECT query_id FROM te LEFT JOIN la USING (query_id) GROUP BY 1 HAVING count(DISTINCT doc_id) < {max(rank.fetch_size(K), 40)}),
    fb AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY nt, nx, doc_id) AS n FROM (
        SELECT DISTINCT query_id, doc_id, nt, nx FROM tf JOIN few USING (query_id), lo WHERE contains(lt, needle) OR contains(lx, needle) OR contains(lp, needle))) WHERE n <= {rank.fetch_size(K)})
    SELECT query_id, doc_id AS chunk_id, like_score, like_score IS NULL AS is_fallback FROM la FULL JOIN fb USING (query_id, doc_id)"""
)
def fetched_candidates(spark, sf_dir):
    """L2, L4: candidates with the fallback of queries that find few. One more question, -1, has a single term that many rows hold."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").union(spark.range(-1, 0).select("id", F.lit("src1")))
    questions = generate.analyze(asked)
    return rank.fetched(questions, _chunks(spark, sf_dir), K)


@query(
    f"""WITH {TITLED}, {_BM25}, {_LIKE}, la AS (SELECT query_id, doc_id, max(like_score) AS like_score FROM li GROUP BY 1, 2)
    SELECT query_id, doc_id AS chunk_id, like_score, bm25 AS fts_rank, CASE WHEN bm25 IS NULL THEN 0 ELSE 1 END AS fts_hit FROM la FULL JOIN bm USING (query_id, doc_id)"""
)
def merge_candidates(spark, sf_dir):
    fts = _bm25(spark, sf_dir, 2 * K).select("query_id", F.col("doc_id").alias("chunk_id"), F.col("bm25").alias("fts_rank"))
    return rank.merge(_like(spark, sf_dir), fts)


@query()
def score_rows(spark, sf_dir):
    """All of the score over merged candidates; its parts have SQL of their own, its order is tested on small cases."""
    questions = generate.analyze(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")).withColumnRenamed("text", "query_text")
    chunks = _chunks(spark, sf_dir).withColumnRenamed("text", "chunk_text")
    labels = {"is_toc": classify.toc_like("chunk_text"), "has_ocr_noise": classify.ocr_noise("chunk_text"), "semantic_type": classify.semantic_type("title", "chunk_text"), "domain_label": classify.domain("chunk_text")}
    pairs = merge_candidates(spark, sf_dir)
    # Only chunks that some query asks for are labelled; their text joins after the candidates are few.
    wanted = chunks.join(pairs.select("chunk_id").distinct(), "chunk_id", "left_semi").withColumns(labels)
    wanted = wanted.withColumns({"clean_score": classify.clean_score(F.col("is_toc"), F.col("has_ocr_noise"), F.lit(False)), "is_warning_only": (F.col("semantic_type") == "safety_warning") & (classify.step_count("chunk_text") < 2), "image_ids": F.array().cast("array<string>")})
    scored = rank.score(pairs.join(rank.with_norms(wanted), "chunk_id").join(I.sent(rank.with_intents(questions)), "query_id"))
    return rank.final(scored, K).select("query_id", "chunk_id", "score", "title_hits", "text_hits", "product_match", "rank")


_FIT = {"procedure": {"procedure": 5.5, "safety_warning": -3.5}, "safety_warning": {"safety_warning": 5.0, "procedure": 0.8}, "troubleshooting": {"troubleshooting": 6.0, "procedure": 1.2, "safety_warning": -2.0}, "parts_list": {"parts_list": 5.0, "specification": 1.5}, "specification": {"specification": 5.0, "parts_list": 1.0}}


@query(over_documents(f"WITH {TITLED}, {semantic_sql()}, i AS (SELECT doc_id, semantic_type AS kind, lower(title) AS t FROM titled JOIN kinds USING (doc_id)), j AS (SELECT *, "
    + ", ".join(f"{any_in('t', h)} AS has_{n}" for n, h in lexicon.INTENT_HINTS.items())
    + " FROM i) SELECT doc_id, CASE WHEN kind = 'general' THEN 0.0 WHEN NOT (" + " OR ".join(f"has_{n}" for n in lexicon.INTENT_HINTS) + ") THEN 0.0 ELSE round("
    + " + ".join(f"CASE WHEN has_{n} THEN CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in own.items()) + " ELSE 0 END ELSE 0 END" for n, own in _FIT.items())
    + ", 1) END::DOUBLE AS alignment FROM j"))
def semantic_alignment(spark, sf_dir):
    rows = planted.documents(spark, sf_dir).select("doc_id", "text", T.title("text").alias("title"))
    fit = rank.semantic_alignment(classify.semantic_type("title", "text"), classify.query_intents("title"), F.lit(False))
    return rows.select("doc_id", F.round(fit, 1).alias("alignment"))


# Two variants of each question's list: BM25 as text only, keywords as a second one, both as scores of like size.
_VARIANTS = "va AS (SELECT query_id, doc_id, 0 AS v, rank - 1 AS r, bm25 AS s FROM bm UNION ALL SELECT query_id, doc_id, 1, rank - 1, score_milli / 1000.0::DOUBLE FROM kw)"


def _variants(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    rows = [
        _bm25(spark, sf_dir, 2 * K, hits).select("query_id", F.lit(0).alias("variant_no"), (F.col("rank") - 1).alias("rank"), F.col("doc_id").alias("chunk_id"), F.col("bm25").alias("score")),
        _keyword(spark, sf_dir, 2 * K, hits).select("query_id", F.lit(1).alias("variant_no"), (F.col("rank") - 1).alias("rank"), F.col("doc_id").alias("chunk_id"), (F.col("score_milli") / 1000.0).alias("score")),
    ]
    return rows[0].unionByName(rows[1])


_FUSED = f"""WITH {TITLED}, {_BM25}, {_KEYWORD}, {_VARIANTS},
po2 AS (SELECT *, s + greatest(0, 2.6 - 0.25 * r) + CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END AS p, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY v) AS k, count(*) OVER (PARTITION BY query_id, doc_id) AS n FROM va),
fu AS (SELECT query_id, doc_id, round(max(p + 1.2 * (n - k + CASE WHEN k > 1 THEN 1 ELSE 0 END)), 3) AS fusion_score, count(*) AS variant_hits, max(s) AS score FROM po2 GROUP BY 1, 2)"""


@query(f"{_FUSED} SELECT query_id, doc_id AS chunk_id, fusion_score, variant_hits, score FROM fu")
def variant_fusion(spark, sf_dir):
    return fuse.fuse_variants(_variants(spark, sf_dir))


_EVIDENCE = f"""{_FUSED},
qw AS (SELECT query_id, list(term) AS terms FROM qt GROUP BY 1),
ev AS (
    SELECT query_id, doc_id, title, source, text, score, round(score + least(1.1 * q, 5.0) + CASE WHEN variant_hits >= 2 THEN 1.5 ELSE 0 END, 3) AS evidence_score, q AS query_overlap FROM (
        SELECT fu.*, title, source, text, len(list_filter(terms, lambda w: contains(regexp_replace(lower(title || chr(10) || text), '\\s+', '', 'g'), w))) AS q FROM fu JOIN titled USING (doc_id) JOIN qw USING (query_id))
),
eo AS (SELECT *, row_number() OVER w AS n, first_value(source) OVER w AS p, first_value(evidence_score) OVER w AS s FROM ev WINDOW w AS (PARTITION BY query_id ORDER BY evidence_score DESC, query_overlap DESC, doc_id)),
ek AS (SELECT *, regexp_replace(lower(title), '\\s+', '', 'g') AS key FROM eo WHERE s >= 4 AND evidence_score >= 3 AND source = p),
ef AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n) AS evidence_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY n) AS k FROM ek) WHERE k = 1 OR key = '') WHERE evidence_rank <= 4)"""


def _evidence(spark, sf_dir):
    none = F.array().cast("array<string>")
    terms = _questions(spark, sf_dir).groupBy("query_id").agg(F.collect_list("term").alias("query_terms"))
    # What was found goes to the texts, which are many more and stay where they are; titles are made for what was found alone.
    found = I.sent(written(fuse.fuse_variants(_variants(spark, sf_dir)), "fused"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("product_name"))
    rows = found.join(docs, "chunk_id").withColumn("title", T.title("text")).join(I.sent(terms), "query_id")
    rows = rows.withColumns({"n_images": F.lit(0), "image_terms": none, "component_terms": none, "status_terms": none, "issue_terms": none})
    return fuse.evidence_score(rows)


def _kept(spark, sf_dir):
    return fuse.filter_evidence(_evidence(spark, sf_dir), fuse.evidence_order())


@query(f"{_EVIDENCE} SELECT query_id, doc_id AS chunk_id, evidence_score, query_overlap FROM ev")
def evidence_rerank(spark, sf_dir):
    return _evidence(spark, sf_dir).select("query_id", "chunk_id", "evidence_score", F.col("query_overlap").cast("long").alias("query_overlap"))


@query(f"{_EVIDENCE} SELECT query_id, doc_id AS chunk_id, evidence_score, CAST(evidence_rank AS INTEGER) AS evidence_rank FROM ef")
def evidence_filter(spark, sf_dir):
    return _kept(spark, sf_dir).select("query_id", "chunk_id", "evidence_score", "evidence_rank")


@query(
    f"""{_EVIDENCE},
    cp AS (SELECT query_id, evidence_rank, '[参考' || evidence_rank || '] 产品：' || source || ' | 章节：' || title || ' | 检索分：' || doc_id || chr(10) || trim(text) AS part FROM ef),
    cr AS (SELECT *, sum(length(part)) OVER (PARTITION BY query_id ORDER BY evidence_rank) AS upto FROM cp),
    cf AS (SELECT *, upto - length(part) AS before, upto > 4000 AND coalesce(lag(upto) OVER (PARTITION BY query_id ORDER BY evidence_rank), 0) <= 4000 AS first FROM cr)
    SELECT query_id, CAST(evidence_rank AS INTEGER) AS evidence_rank, CAST(CASE WHEN upto <= 4000 THEN length(part) ELSE 4000 - before END AS BIGINT) AS kept_chars, upto <= 4000 AS is_reference,
           md5(CASE WHEN upto <= 4000 THEN part ELSE left(part, CAST(4000 - before AS BIGINT)) || '……' END) AS part_md5
    FROM cf WHERE upto <= 4000 OR (first AND 4000 - before > 200)"""
)
def context_budget(spark, sf_dir):
    rows = _kept(spark, sf_dir)
    part = fuse.part_text(F.col("evidence_rank"), F.col("product_name"), F.col("title"), F.col("chunk_id"), F.col("text"))
    out = fuse.context_parts(rows.select("query_id", "evidence_rank", part.alias("part")))
    return out.select("query_id", "evidence_rank", F.col("kept_chars").cast("long").alias("kept_chars"), "is_reference", F.md5(F.col("part").cast("binary")).alias("part_md5"))


@query(
    f"""WITH {_BM25}, ab AS (SELECT query_id, max(bm25) FILTER (WHERE rank = 1) AS a, coalesce(max(bm25) FILTER (WHERE rank = 2), 0) AS b FROM bm GROUP BY 1)
    SELECT query_id, CASE WHEN a IS NULL THEN 0.15 ELSE round(least(0.35 + least(a / 50.0::DOUBLE, 0.45) + least(greatest(a - b, 0.0) / 40.0::DOUBLE, 0.15), 0.95), 2) END AS confidence
    FROM (SELECT item_id AS query_id FROM benchmark UNION ALL SELECT -1) LEFT JOIN ab USING (query_id)"""
)
def confidence(spark, sf_dir):
    """One more question, -1, finds nothing."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).union(spark.range(-1, 0).toDF("query_id"))
    return fuse.confidence(_bm25(spark, sf_dir, 2), "bm25", queries=asked)


@query(
    rf"""WITH z AS (SELECT doc_id, regexp_extract_all(text, '[一-鿿]+') AS r FROM planted), t AS (SELECT doc_id, unnest(list_filter(r, lambda x: length(x) > 6)) AS token FROM z),
    u AS (SELECT DISTINCT doc_id, token FROM t), s AS (SELECT doc_id, token, list_filter([{", ".join(map(lit, lexicon.DOMAIN_PHRASES))}], lambda p: contains(token, p)) AS a,
        flatten([{", ".join(f"CASE WHEN contains(token, {lit(k)}) THEN [{', '.join(map(lit, (k, *v)))}] ELSE [] END" for k, v in lexicon.SYNONYMS.items())}]) AS b,
        list_filter(string_split_regex(token, '{generate.CUTS}'), lambda x: length(x) BETWEEN 2 AND 8) AS c FROM u),
    v AS (SELECT *, list_concat(a, b, c[1:6], CASE WHEN len(a) = 0 AND len(c) = 0 THEN list_concat(list_transform(range(1, length(token) - 2), lambda k: substr(token, k, 4))[1:4], list_transform(range(1, length(token) - 1), lambda k: substr(token, k, 3))[1:4]) ELSE [] END) AS w FROM s)
    SELECT doc_id, token, array_to_string(list_filter(w, lambda x, k: list_position(w, x) = k), '|') AS terms FROM v""".replace("WITH z", f"WITH {planted._DOCS}, z", 1)
)
def long_terms(spark, sf_dir):
    """Terms of long runs of ideographs."""
    runs = F.filter(F.regexp_extract_all("text", F.lit("[一-鿿]+"), F.lit(0)), lambda x: F.length(x) > 6)
    rows = planted.documents(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(runs)).alias("token"))
    return rows.select("doc_id", "token", F.array_join(generate.long_terms(F.col("token")), "|").alias("terms"))


_WORD_COUNT = "len(list_filter({}, lambda w: contains({}, regexp_replace(lower(w), '\\s+', '', 'g'))))"


@query(
    rf"""WITH {planted._DOCS}, {TITLED.replace('documents', 'planted')}, d AS (SELECT doc_id, regexp_replace(lower(title), '\s+', '', 'g') AS t, regexp_replace(lower(title), '\s+', '', 'g') || regexp_replace(lower(text), '\s+', '', 'g') AS x FROM titled),
    g AS (SELECT doc_id, list(domain) AS own FROM {domain_sql('text', lexicon.QUERY_DOMAINS, 'planted', 'doc_id')} GROUP BY 1),
    q AS (SELECT * FROM (VALUES (0, ['install', 'vacuum', 'side'], ['side brush'], ['vacuum']), (1, ['camera', 'lens'], [], ['camera']), (2, ['motherboard'], [], [])) AS v(query_id, words, phrases, groups)),
    n AS (SELECT *, {_WORD_COUNT.format('words', 'x')} AS k, {_WORD_COUNT.format('words', 't')} AS kt, {_WORD_COUNT.format('phrases', 'x')} AS p, {_WORD_COUNT.format('phrases', 't')} AS pt,
          len(list_filter(words, lambda w: length(w) >= 6 AND contains(x, w))) > 0 AS long, len(list_filter(groups, lambda z: list_contains(coalesce(own, []), z))) AS shared FROM q, d LEFT JOIN g USING (doc_id))
    SELECT query_id, doc_id, round(least(1.6 * k, 9.0) + least(1.8 * kt, 6.0) + least(4.0 * p, 12.0) + least(3.0 * pt, 9.0) + CASE WHEN k <= 1 AND p = 0 THEN CASE WHEN long THEN 4.0 ELSE -12.0 END WHEN k >= 3 OR p >= 1 THEN 4.0 ELSE 0.0 END
           + CASE WHEN len(groups) = 0 THEN 0.0 WHEN shared > 0 THEN 10.0 * shared WHEN len(coalesce(own, [])) > 0 THEN -14.0 ELSE -5.0 END, 1)::DOUBLE AS alignment FROM n"""
)
def english_alignment(spark, sf_dir):
    """How three stated questions reach planted documents as chunks of the English manual."""
    asked = spark.createDataFrame([(0, ["install", "vacuum", "side"], ["side brush"], ["vacuum"]), (1, ["camera", "lens"], [], ["camera"]), (2, ["motherboard"], [], [])], "query_id int, words array<string>, phrases array<string>, groups array<string>")
    rows = planted.documents(spark, sf_dir).select("doc_id", T.compact(T.title("text")).alias("t"), T.compact("text").alias("x"), classify.domain_groups("text").alias("own"))
    fit = rank.english_alignment(F.col("t"), F.col("x"), F.col("words"), F.col("phrases"), F.col("own"), F.col("groups"))
    return rows.crossJoin(F.broadcast(asked)).select("query_id", "doc_id", F.round(fit, 1).alias("alignment"))


@query(f"WITH b AS (SELECT item_id, {strip('text')} AS t FROM benchmark) SELECT item_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM b JOIN documents ON contains(text, t) GROUP BY item_id")
def benchmark_recall(spark, sf_dir):
    """Documents that hold a question's text as it is, found by grams; a question's text may be that of several."""
    items = table(spark, sf_dir, "benchmark").select("item_id", T.strip("text").alias("needle"))
    rows = grams.holding(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], items).select("doc_id", "needle").join(items, "needle")
    return rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))
