"""Queries of dialogue, answers, pictures and evaluation over conversations, events, documents and benchmark."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T
from ..operators import answer, dialog, evaluate, generate, grams, images, orchestrate, tables
from ..operators import index as I
from . import planted
from .base import ORACLE_SQL, TERMS, TITLED, lit, query, squeeze, strip, table
from .planted import over_conversations
from .build_queries import _UNITS
from .search_queries import _BM25, _kept, _questions

OMNI = dialog.SMALLTALK
_FILLER = r"regexp_replace(x, '^(请问|我想咨询一下|我想了解一下|我想问一下|帮我看一下|想问一下|我想知道|麻烦问一下)[，,\s]*', '')"


@query(over_conversations("SELECT conv_id, turn, coalesce(" + ", ".join(rf"CASE WHEN regexp_full_match(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', '', 'g'), {lit(p)}) THEN {lit(k)} END" for k, p in OMNI.items()) + ", 'none') AS intent FROM conversations"))
def smalltalk(spark, sf_dir):
    return planted.conversations(spark, sf_dir).select("conv_id", "turn", F.coalesce(dialog.smalltalk("text"), F.lit("none")).alias("intent"))


_ALIASES = {"".join(a.split()): p for a, p in lexicon.PRODUCTS.items()}
_NAMED = "(" + " OR ".join(f"contains(c, {lit(a)})" for a in _ALIASES) + rf" OR regexp_matches(t, '{generate.MODEL}'))"


def _n(terms):
    return "len(list_distinct(regexp_extract_all(t, " + lit("|".join(sorted(terms, key=len, reverse=True))) + ")))"


@query(over_conversations(rf"""WITH a AS (SELECT conv_id, turn, {strip('text')} AS t, regexp_replace(lower(text), '\s+', '', 'g') AS c FROM conversations WHERE role = 'user'),
    b AS (SELECT *, 2 * {_n(lexicon.SERVICE_TERMS)} + CASE WHEN contains(t, '客服') AND NOT {_NAMED} THEN 2 ELSE 0 END AS s,
          2 * {_n(lexicon.MANUAL_TERMS)} + CASE WHEN {_NAMED} THEN 2 ELSE 0 END + CASE WHEN contains(t, '说明书') THEN 2 ELSE 0 END AS m FROM a)
    SELECT conv_id, turn, CASE WHEN s >= greatest(2, m + 1) THEN 'customer_service' ELSE 'manual_rag' END AS route, s AS service_score, m AS manual_score,
           round(CASE WHEN s >= greatest(2, m + 1) THEN least(0.65 + s * 0.06, 0.95) ELSE least(0.6 + m * 0.05, 0.95) END::DOUBLE, 2) AS confidence FROM b"""))
def route(spark, sf_dir):
    rows = planted.conversations(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", dialog.route("text").alias("r"))
    return rows.select("conv_id", "turn", "r.route", "r.service_score", "r.manual_score", "r.confidence")


@query(over_conversations(rf"""WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace({strip('text')}, '([？?])', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x, ' ,，')), lambda x: x <> '') AS p FROM conversations WHERE role = 'user'),
    e AS (SELECT conv_id, turn, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM l)
    SELECT conv_id, turn, 'q' || k AS sub_id, {strip(squeeze(_FILLER))} AS normalized, k > 1 AS depends FROM e WHERE {strip(squeeze(_FILLER))} <> ''"""))
def split_questions(spark, sf_dir):
    rows = planted.conversations(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", F.explode(generate.sub_questions("text")).alias("q"))
    return rows.select("conv_id", "turn", "q.sub_id", "q.normalized", "q.depends")


@query(ORACLE_SQL["split_questions"])
def split_questions_sql(spark, sf_dir):
    """The same by a table function in SQL."""
    tables.register(spark)
    turns = planted.conversations(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", "text")
    return spark.sql("SELECT t.conv_id, t.turn, q.sub_id, q.normalized, q.depends FROM {turns} t, LATERAL question_rows(t.text) q", turns=turns)


# D1, D3 as window functions: planted turns, of which every third answer names a source and every second a picture.
_FOLLOW = "(" + " OR ".join(f"contains(c, {lit(t)})" for t in lexicon.FOLLOW_UP) + ")"
_RESET, _SWITCH = ("(" + " OR ".join(f"contains(c, {lit(t)})" for t in terms) + ")" for terms in (lexicon.RESET, lexicon.SWITCH))
_SUBS = rf"""list_filter(list_transform(list_filter(list_transform(string_split(regexp_replace(t, '([？?])', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x, ' ,，')), lambda x: x <> ''),
    lambda x: {strip(squeeze(_FILLER))}), lambda x: x <> '')"""
_SESSION = rf"""WITH t0 AS (SELECT *, lead(role) OVER w AS r1, lead(text) OVER w AS x1 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    t1 AS (SELECT conv_id, turn, {strip('text')} AS t, regexp_replace(lower(text), '\s+', '', 'g') AS c, CASE WHEN r1 = 'assistant' THEN {strip('x1')} ELSE '' END AS answer,
           CASE WHEN turn % 3 = 2 THEN '冰箱' END AS source, CASE WHEN turn % 4 = 0 THEN ['p' || turn, 'p0'] ELSE [] END AS pics, CASE WHEN turn = 2 THEN 'a red light' ELSE '' END AS shown FROM t0 WHERE role = 'user'),
    t2 AS (SELECT *, list_filter([{", ".join(f"CASE WHEN contains(c, {lit(a)}) THEN {lit(p)} END" for a, p in _ALIASES.items())}], lambda x: x IS NOT NULL)[1] AS named,
           list_distinct(list_transform(regexp_extract_all(t, '{generate.MODEL}'), lambda m: upper(m))) AS mm, list_transform(regexp_extract_all(t, '{generate.MODEL}'), lambda m: upper(m)) AS ml, {_FOLLOW} AS refers, {_RESET} AS reset, {_SWITCH} AS sw, {_SUBS} AS subs FROM t1),
    t3 AS (SELECT *, list_filter(ml, lambda m, k: list_position(ml, m) = k)[1:3] AS models, refers OR regexp_matches(t, '^(那|这|它|继续|还有|另外)') AS fol, sum(reset::INT) OVER (PARTITION BY conv_id ORDER BY turn, t) AS life FROM t2),
    t4 AS (SELECT *, named IS NULL AND len(models) = 0 AS unnamed, sw AND named IS NULL AND len(models) = 0 AS lost FROM t3),
    t5 AS (SELECT *, (fol OR len(models) = 0) AND NOT lost AS takes FROM t4),
    t6 AS (SELECT *, CASE WHEN NOT reset THEN coalesce(named, CASE WHEN NOT takes THEN source END) END AS sets, CASE WHEN NOT reset AND named IS NULL AND takes THEN source END AS may,
           sum((NOT reset)::INT) OVER w AS n FROM t5 WINDOW w AS (PARTITION BY conv_id, life ORDER BY turn, t)),
    t7 AS (SELECT *, coalesce(last_value(sets IGNORE NULLS) OVER b, first_value(may IGNORE NULLS) OVER b, '') AS was, coalesce(last_value(sets IGNORE NULLS) OVER w, first_value(may IGNORE NULLS) OVER w, '') AS product, NOT reset AND n > 1 AS known
           FROM t6 WINDOW w AS (PARTITION BY conv_id, life ORDER BY turn, t ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY conv_id, life ORDER BY turn, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t8 AS (SELECT *, known AND named IS NOT NULL AND was <> '' AND named <> was AS other, known AND NOT lost AND (fol OR (unnamed AND was <> '')) AS follows FROM t7),
    t9 AS (SELECT *, CASE WHEN follows AND NOT other AND named IS NULL THEN was ELSE '' END AS took FROM t8),
    ta AS (SELECT *, follows AND NOT other AND len(models) = 0 AND (took <> '' OR refers) AS cuts FROM t9),
    tb AS (SELECT *, max(CASE WHEN NOT reset AND len(models) > 0 THEN n END) OVER b AS at_b, last_value(CASE WHEN NOT reset AND len(models) > 0 THEN models END IGNORE NULLS) OVER b AS m_b, max(CASE WHEN cuts THEN n END) OVER b AS c_b,
           max(CASE WHEN NOT reset AND len(models) > 0 THEN n END) OVER w AS at_w, last_value(CASE WHEN NOT reset AND len(models) > 0 THEN models END IGNORE NULLS) OVER w AS m_w, max(CASE WHEN cuts THEN n END) OVER w AS c_w,
           flatten(list(CASE WHEN reset THEN [] ELSE subs END) OVER r) AS said, flatten(list(CASE WHEN reset THEN [] ELSE pics END) OVER r) AS seen, coalesce(last_value(CASE WHEN NOT reset THEN nullif(shown, '') END IGNORE NULLS) OVER w, '') AS shown_last
           FROM ta WINDOW w AS (PARTITION BY conv_id, life ORDER BY turn, t ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY conv_id, life ORDER BY turn, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r AS (PARTITION BY conv_id, life ORDER BY turn, t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
    tc AS (SELECT *, CASE WHEN coalesce(c_w > at_w, false) THEN m_w[1:2] ELSE coalesce(m_w, []) END AS ms, list_filter(seen, lambda x, k: list_position(seen, x) = k) AS once,
           list_filter(string_split(concat_ws(' ', nullif(took, ''), CASE WHEN cuts THEN nullif(array_to_string(coalesce(m_b, [])[1:2], ' '), '') END, t), ' '), lambda x: x <> '') AS words FROM tb)
    SELECT conv_id, turn, CASE WHEN follows AND NOT other THEN array_to_string(list_filter(words, lambda x, k: list_position(words, x) = k), ' ') ELSE t END AS resolved, follows AS is_follow_up, reset, known AND lost AS needs_clarification, other AS topic_switched,
           product, array_to_string(ms, ',') AS models, CAST(least(2 * n, 10) AS INTEGER) AS n_history,
           CASE WHEN reset THEN '' ELSE concat_ws('；', CASE WHEN product <> '' THEN '当前讨论产品：' || product END, CASE WHEN len(ms) > 0 THEN '最近提到型号：' || array_to_string(ms[1:2], '、') END,
               CASE WHEN len(said) > 0 THEN '最近问题：' || array_to_string(said[greatest(len(said) - 2, 1):], '；') END, CASE WHEN len(once) > 0 THEN '最近相关图片：' || array_to_string(once[greatest(len(once) - 2, 1):], ', ') END,
               CASE WHEN shown_last <> '' THEN '最近上传图片：' || left(shown_last, 120) END, CASE WHEN answer <> '' THEN '上一轮回答摘要：' || left(answer, 120) END) END AS summary
    FROM tc"""


def _turns(spark, sf_dir):
    turn, none = F.col("turn"), F.array().cast("array<string>")
    return planted.conversations(spark, sf_dir).withColumns({
        "sources": F.when(turn % 3 == 2, F.array(F.lit("冰箱"))).otherwise(none), "image_ids": F.when(turn % 4 == 0, F.array(F.concat(F.lit("p"), turn.cast("string")), F.lit("p0"))).otherwise(none),
        "image_summary": F.when(turn == 2, "a red light").otherwise(""),
    })


@query(over_conversations(_SESSION))
def session_fold(spark, sf_dir):
    """D1, D3 over planted turns."""
    return dialog.fold_sessions(_turns(spark, sf_dir))


@query(over_conversations("SELECT conv_id, turn, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(text, {lit(t)})' for t in w)} THEN {lit(n)} END" for n, w in lexicon.DETAIL_INTENTS) + "], lambda x: x IS NOT NULL), ',') AS intents FROM conversations WHERE role = 'user'"))
def detail_intents(spark, sf_dir):
    rows = planted.conversations(spark, sf_dir).where("role = 'user'")
    return rows.select("conv_id", "turn", F.array_join(dialog.detail_intents("text"), ",").alias("intents"))


@query(
    """WITH w AS (SELECT conv_id, turn, list(turn || ':' || length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS h FROM conversations)
    SELECT conv_id, turn, len(h) AS n, array_to_string(h, ',') AS history FROM w"""
)
def history_window(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-(dialog.HISTORY - 1), 0)
    said = F.concat(F.col("turn").cast("string"), F.lit(":"), F.length("text").cast("string"))
    rows = table(spark, sf_dir, "conversations").withColumn("h", F.collect_list(said).over(w))
    return rows.select("conv_id", "turn", F.size("h").cast("long").alias("n"), F.array_join("h", ",").alias("history"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 3600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session_no FROM g)
    SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS n_events, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended FROM s GROUP BY 1, 2"""
)
def session_ttl(spark, sf_dir):
    return dialog.sessions_by_gap(table(spark, sf_dir, "events"))


@query(over_conversations("WITH s AS (SELECT conv_id, turn, role, text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) "
    "SELECT conv_id, turn, coalesce(before = 'assistant', false) AND (length(" + strip("text") + ") <= 14 OR " + "(" + " OR ".join(f"contains({strip('text')}, {lit(t)})" for t in lexicon.SERVICE_FOLLOW_UP) + ")) AS inherits FROM s WHERE role = 'user'"))
def route_inherit(spark, sf_dir):
    """A user turn after an answer counts as one whose session was with customer service."""
    rows = planted.conversations(spark, sf_dir)
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = rows.withColumn("was", F.when(before == "assistant", "customer_service").otherwise("manual_rag")).where("role = 'user'")
    return rows.select("conv_id", "turn", dialog.inherits_service("text", F.lit("manual_rag"), F.col("was"), F.lit(1), F.lit(False)).alias("inherits"))


# Policy rules: topics with their fields, and scenarios.
_TOPICS = [
    (0, "return", ["退货", "退换货"], "退货要先看商品和订单的状态。", "请准备订单号和商品照片。", "审核一般要一到三天。", "运费要看责任在谁。", "没有用过的商品可以退。", "请在订单页面申请。", "请找售后。"),
    (1, "invoice", ["发票", "发票抬头"], "发票可以在订单完成后申请。", "请准备抬头和税号。", "电子发票当天开出。", "开票不收费。", "", "请在发票页面申请。", "请找财务客服。"),
    (2, "delivery", ["物流", "包裹", "没有更新"], "物流状态以承运方为准。", "请准备运单号。", "更新可能晚一天。", "", "超时可以申请赔付。", "请先核对地址。", "请找物流客服。"),
    (3, "service", ["人工客服"], "人工客服在工作时间接听。", "", "", "", "", "请在页面下方进入。", ""),
]
_SCENARIOS = [
    ("return", 0, "freight", ["运费", "承担"], "运费由责任一方承担。", "", "", "质量问题由卖家承担。", "", "", ""),
    ("invoice", 0, "wrong", ["开错", "重开"], "开错的发票可以作废重开。", "请准备错误发票的截图。", "", "", "", "请先作废再申请。", ""),
    ("delivery", 0, "late", ["没有更新"], "没有更新时请先等一天。", "", "", "", "", "", ""),
    ("delivery", 1, "lost", ["丢了", "赔"], "包裹丢失可以申请赔付。", "", "赔付要七天。", "", "", "", ""),
]
_FIELDS = ("overview", *dialog.FIELDS)


def _rules_sql(rows, names):
    cell = lambda x: "[" + ", ".join(map(lit, x)) + "]" if isinstance(x, list) else lit(x) if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS v({', '.join(names)})"


@query(over_conversations(
    f"""WITH tp AS (SELECT * FROM {_rules_sql(_TOPICS, ("pos", "topic", "terms", *_FIELDS))}), sc AS (SELECT * FROM {_rules_sql(_SCENARIOS, ("topic", "pos", "name", "terms", *_FIELDS))}),
    q AS (SELECT conv_id || ':' || turn AS query_id, text AS t, {", ".join(f"({' OR '.join(f'contains(text, {lit(t)})' for t in w)}) AS i_{n}" for n, w in lexicon.DETAIL_INTENTS)} FROM conversations WHERE role = 'user'),
    h AS (SELECT q.*, tp.*, row_number() OVER (PARTITION BY query_id ORDER BY list_max(list_transform(list_filter(terms, lambda w: contains(t, w)), lambda w: length(w))) DESC, pos) AS k FROM q JOIN tp ON len(list_filter(terms, lambda w: contains(t, w))) > 0),
    b AS (SELECT * FROM h WHERE k = 1),
    s AS (SELECT * FROM (SELECT b.query_id, sc.*, row_number() OVER (PARTITION BY query_id ORDER BY len(list_filter(sc.terms, lambda w: contains(t, w))) DESC, sc.pos) AS j FROM b JOIN sc ON sc.topic = b.topic AND len(list_filter(sc.terms, lambda w: contains(t, w))) > 0) WHERE j = 1),
    f AS (SELECT b.query_id, b.topic, coalesce(s.pos, -1) AS scenario, {", ".join(f"nullif(coalesce(nullif(s.{n}, ''), b.{n}), '') AS {n}" for n in _FIELDS)}, {" + ".join(f"i_{n}::INT" for n in dialog.FIELDS)} AS n, {", ".join(f"i_{n}" for n in dialog.FIELDS)} FROM b LEFT JOIN s USING (query_id))
    SELECT query_id, topic, CAST(coalesce(scenario, -1) AS INTEGER) AS scenario, CASE WHEN topic IS NULL THEN {lit(dialog.NO_POLICY)} ELSE concat_ws(' ', overview, {", ".join(f"CASE WHEN i_{n} {'OR n = 0' if n in ('materials', 'process') else ''} THEN {n} END" for n in dialog.FIELDS)},
        CASE WHEN i_contact THEN {lit(dialog.CLOSINGS[0][1])} WHEN i_timeline THEN {lit(dialog.CLOSINGS[1][1])} END) END AS answer,
        CASE WHEN topic IS NULL THEN 0.58::DOUBLE ELSE round(least(0.73 + 0.02 * n + 0.01 * (scenario >= 0)::INT, 0.92)::DOUBLE, 2) END AS confidence FROM (SELECT query_id FROM q) LEFT JOIN f USING (query_id)"""
))
def policy_answer(spark, sf_dir):
    fields = ", ".join(f"{f} string" for f in _FIELDS)
    topics = spark.createDataFrame(_TOPICS, f"pos int, topic string, terms array<string>, {fields}")
    scenarios = spark.createDataFrame(_SCENARIOS, f"topic string, pos int, name string, terms array<string>, {fields}")
    rows = planted.conversations(spark, sf_dir).where("role = 'user'").select(F.concat("conv_id", F.lit(":"), "turn").alias("query_id"), "text")
    return dialog.policy_answers(rows, topics, scenarios)


def _policy(spark):
    fields = ", ".join(f"{f} string" for f in _FIELDS)
    return spark.createDataFrame(_TOPICS, f"pos int, topic string, terms array<string>, {fields}"), spark.createDataFrame(_SCENARIOS, f"topic string, pos int, name string, terms array<string>, {fields}")


_STATED = " ".join(f"WHEN branch = {lit(b)} THEN {lit(a)}" for b, (a, _) in orchestrate.STATED.items()) + " " + " ".join(f"WHEN branch = 'smalltalk' AND intent = {lit(i)} THEN {lit(a)}" for i, a in orchestrate.REPLIES.items())


@query(
    f"""WITH {planted._TURNS}, sf AS ({ORACLE_SQL["session_fold"]}), sm AS ({ORACLE_SQL["smalltalk"]}), ro AS ({ORACLE_SQL["route"]}), pa AS ({ORACLE_SQL["policy_answer"]}),
    de AS (
        SELECT sf.conv_id, sf.turn, sf.conv_id || ':' || sf.turn AS query_id, said.text AS question, sf.resolved, sm.intent, ro.confidence AS route_confidence,
               CASE WHEN {strip('said.text')} = '' THEN 'blank' WHEN sf.reset THEN 'clear' WHEN sf.needs_clarification THEN 'clarify' WHEN sm.intent <> 'none' THEN 'smalltalk' WHEN ro.route = 'customer_service' THEN 'service' ELSE 'manual' END AS branch
        FROM sf JOIN said USING (conv_id, turn) JOIN sm USING (conv_id, turn) JOIN ro USING (conv_id, turn)
    ),
    qt AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({TERMS.format('resolved')}) AS term FROM de WHERE branch = 'manual') WHERE length(term) >= 3),
    {_BM25[_BM25.index('dt AS'):]}, {TITLED}, qw AS (SELECT query_id, list_distinct(list_filter({TERMS.format('question')}, lambda w: length(w) >= 3)) AS terms FROM de),
    ev AS (SELECT query_id, doc_id, title, source, bm25 AS score, round(bm25 + least(1.1 * q, 5.0), 3) AS evidence_score, q FROM (
        SELECT bm.*, title, source, len(list_filter(terms, lambda w: contains(regexp_replace(lower(title || chr(10) || text), '\\s+', '', 'g'), w))) AS q FROM bm JOIN titled USING (doc_id) JOIN qw USING (query_id) WHERE rank <= 10)),
    eo AS (SELECT *, row_number() OVER w AS n, first_value(source) OVER w AS p, first_value(evidence_score) OVER w AS s FROM ev WINDOW w AS (PARTITION BY query_id ORDER BY evidence_score DESC, q DESC, doc_id)),
    ek AS (SELECT *, regexp_replace(lower(title), '\\s+', '', 'g') AS key FROM eo WHERE s >= 4 AND evidence_score >= 3 AND source = p),
    ef AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n) AS r FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY n) AS k FROM ek) WHERE k = 1 OR key = '') WHERE r <= 4),
    es AS (SELECT query_id, count(*) AS n_evidence, max(doc_id) FILTER (WHERE r = 1) AS first_chunk, max(score) FILTER (WHERE r = 1) AS a, coalesce(max(score) FILTER (WHERE r = 2), 0) AS b FROM ef GROUP BY 1),
    re AS (SELECT query_id, count(*) AS n_retrieved FROM bm WHERE rank <= 10 GROUP BY 1)
    SELECT conv_id, turn, CASE WHEN branch = 'manual' AND n_evidence IS NULL THEN 'no_evidence' ELSE branch END AS branch,
           round(CASE WHEN branch = 'service' THEN least(route_confidence, pa.confidence) WHEN branch = 'manual' AND n_evidence IS NULL THEN 0.15
                WHEN branch = 'manual' THEN round(least(0.35 + least(a / 50.0::DOUBLE, 0.45) + least(greatest(a - b, 0.0) / 40.0::DOUBLE, 0.15), 0.95), 2)
                {" ".join(f"WHEN branch = {lit(b)} THEN {c}" for b, (_, c) in orchestrate.STATED.items())} ELSE {orchestrate.REPLY_CONFIDENCE} END::DOUBLE, 2) AS confidence,
           coalesce(n_retrieved, 0) AS n_retrieved, coalesce(n_evidence, 0) AS n_evidence, CAST(first_chunk AS VARCHAR) AS first_chunk,
           md5(CASE {_STATED} WHEN branch = 'service' THEN pa.answer WHEN branch = 'manual' AND n_evidence IS NULL THEN {lit(orchestrate.submission.EMPTY_ANSWER)} END) AS answer_md5
    FROM de LEFT JOIN es USING (query_id) LEFT JOIN re USING (query_id) LEFT JOIN pa USING (query_id)"""
)
def answered_turns(spark, sf_dir):
    """All planted turns through every branch. Extractive answers are beyond SQL, so they have no digest."""
    docs = table(spark, sf_dir, "documents")

    def search(questions, k):
        asked = questions.select("query_id", F.explode(F.array_distinct(I.terms("text"))).alias("term")).where(F.length("term") >= 3)
        return I.best(I.hits(asked, docs), k).select("query_id", F.col("doc_id").alias("chunk_id"), F.col("bm25").alias("score"), "rank")

    own = lambda c: F.array_distinct(F.filter(I.terms(c), lambda w: F.length(w) >= 3))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), T.title("text").alias("title"), "text", F.col("source").alias("product_name"))
    rows = orchestrate.answer_turns(_turns(spark, sf_dir), search, *_policy(spark), terms=own, chunks=chunks)
    digest = F.when(F.col("branch") != "manual", F.md5(F.col("answer").cast("binary")))
    return rows.select("conv_id", "turn", "branch", "confidence", "n_retrieved", "n_evidence", "first_chunk", digest.alias("answer_md5"))


@query(
    rf"""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(text || ' ' || text, '([。！？.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '') AS p FROM conversations),
    e AS (SELECT conv_id, turn, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM s),
    f AS (SELECT conv_id, turn, regexp_replace(x, '\s+', '', 'g') AS key, arg_min(x, k) AS x, min(k) AS k FROM e GROUP BY 1, 2, 3 HAVING length(key) >= 4)
    SELECT conv_id, turn, md5({strip(rf"regexp_replace(string_agg(x, ' ' ORDER BY k), '\s{{2,}}', ' ', 'g')")}) AS answer_md5 FROM f GROUP BY 1, 2"""
)
def answer_dedupe(spark, sf_dir):
    """Every text said twice is said once."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" "), "text").alias("said")).where(answer.says_something("said"))
    return rows.select("conv_id", "turn", F.md5(answer.dedupe("said").cast("binary")).alias("answer_md5"))


@query("SELECT conv_id, CASE WHEN count(*) = 1 THEN max(text) ELSE string_agg('问题' || k || '：' || text, chr(10) ORDER BY turn) END AS answer FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant') GROUP BY conv_id")
def multi_answer_merge(spark, sf_dir):
    return answer.merge_answers(table(spark, sf_dir, "conversations").where("role = 'assistant'"), "conv_id", "turn", "text").withColumnRenamed("text", "answer")


@query()
def extractive_answer(spark, sf_dir):
    """Answers out of each question's evidence; held against small cases in the tests."""
    terms = _questions(spark, sf_dir).groupBy("query_id").agg(F.collect_list("term").alias("terms"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).join(terms, "query_id")
    return answer.extractive(_kept(spark, sf_dir).select("query_id", "evidence_rank", "title", "text").join(asked, "query_id"))


@query(
    rf"""WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS p FROM conversations)
    SELECT conv_id, turn, md5({squeeze("array_to_string(list_filter(p, lambda x, k: k = 1 OR p[k - 1] <> x OR x = ''), chr(10))")}) AS said_md5 FROM l"""
)
def cs_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.squeeze(answer.lines_once("text")).alias("s"))
    return rows.select("conv_id", "turn", F.md5(F.col("s").cast("binary")).alias("said_md5"))


@query(
    f"""WITH {TITLED}, {_UNITS}, p AS (SELECT doc_id, title, u[2:] AS d, coalesce(list_filter(u, lambda x: contains(x, '!'))[1], '') AS w FROM titled JOIN units USING (doc_id))
    SELECT doc_id, CASE WHEN title = '' THEN '根据现有资料无法准确回答此问题。' ELSE concat_ws(chr(10) || chr(10), title, nullif(array_to_string(list_transform(d[1:3], lambda x, k: k || '. ' || x), chr(10)), ''), nullif(w, ''),
                  CASE WHEN doc_id % 5 > 0 THEN '相关配图如下：' || repeat('<PIC>', least(doc_id % 5, 3)) END) END AS answer FROM p"""
)
def manual_format(spark, sf_dir):
    """The title as conclusion, all further sentences as details, the first with an exclamation mark as caution."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.title("text").alias("title"), generate.sentence_units("text").alias("u"))
    caution = F.coalesce(F.get(F.filter("u", lambda x: x.contains("!")), F.lit(0)), F.lit(""))
    return rows.select("doc_id", answer.manual_format(F.col("title"), F.slice("u", 2, 1 << 20), caution, (F.col("doc_id") % 5).cast("int")).alias("answer"))


@query(
    """WITH o AS (SELECT item_id AS doc_id, 'item ' || item_id AS o FROM benchmark), k AS (SELECT * FROM (VALUES (0, 'MIT License', 'mit'), (1, 'Apache License', 'apache'), (2, 'All rights reserved', 'closed')) AS v(pos, keyword, template)),
    t AS (SELECT doc_id, arg_min(template, pos) AS t FROM documents JOIN k ON contains(text, keyword) GROUP BY 1)
    SELECT doc_id, coalesce(o, CASE WHEN n_chars > 2000 THEN lang END, t, '根据现有资料无法准确回答此问题。') AS answer FROM documents LEFT JOIN o USING (doc_id) LEFT JOIN t USING (doc_id)"""
)
def override_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("n_chars") > 2000, F.col("lang")).otherwise("").alias("answer"))
    overrides = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("override"))
    templates = spark.createDataFrame([(0, "MIT License", "mit"), (1, "Apache License", "apache"), (2, "All rights reserved", "closed")], "pos int, keyword string, template string")
    return answer.override(rows, overrides, templates, "doc_id").select("doc_id", "answer")


# The first bytes of a picture of each kind, with a document's length and number as its sides.
def _picture(kind):
    big = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    little = lambda c: F.unhex(F.concat(F.lpad(F.hex(c % 256), 2, "0"), F.lpad(F.hex(F.floor(c / 256) % 256), 2, "0")))
    w, h = F.col("n_chars"), F.col("doc_id") % 60000
    head = lambda x: F.unhex(F.lit(x))
    png = F.concat(head("89504E470D0A1A0A0000000D49484452"), big(w), big(h))
    gif = F.concat(head("474946383961"), little(w % 65536), little(h))
    jpeg = F.concat(head("FFD8FFE000104A46494600010100000100010000FFC0001108"), F.substring(big(h), 3, 2), F.substring(big(w % 65536), 3, 2), head("0301"))
    return F.when(kind == 0, png).when(kind == 1, gif).when(kind == 2, jpeg).otherwise(F.encode(F.col("lang"), "UTF-8"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'PNG' WHEN 1 THEN 'GIF' WHEN 2 THEN 'JPEG' ELSE 'UNKNOWN' END AS kind FROM documents")
def image_type(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", images.image_type(_picture(F.col("doc_id") % 4)).alias("kind"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN n_chars WHEN doc_id % 4 < 3 THEN n_chars % 65536 END AS width, CASE WHEN doc_id % 4 < 3 THEN doc_id % 60000 END AS height FROM documents")
def image_size(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", images.image_size(_picture(F.col("doc_id") % 4)).alias("s"))
    return rows.select("doc_id", F.col("s.width").cast("long").alias("width"), F.col("s.height").cast("long").alias("height"))


def _strings(words) -> str:
    return "[" + ", ".join(map(lit, words)) + "]"


# The keywords of a text (G7) behind the words of its subject, in their order, as an array u; those that other lists have, noise and long ones are left out.
_runs = lambda n: f"list_transform(range(1, length(x) - {n} + 2), lambda j: substr(x, j, {n}))"
_LONG = f"""list_concat(list_filter({_strings(lexicon.DOMAIN_PHRASES)}, lambda p: contains(x, p)), flatten([{", ".join(f"CASE WHEN contains(x, {lit(k)}) THEN {_strings((k, *v))} ELSE [] END" for k, v in lexicon.SYNONYMS.items())}]),
    list_filter(string_split_regex(x, '{generate.CUTS}'), lambda p: length(p) BETWEEN 2 AND 8)[1:6],
    CASE WHEN len(list_filter({_strings(lexicon.DOMAIN_PHRASES)}, lambda p: contains(x, p))) + len(list_filter(string_split_regex(x, '{generate.CUTS}'), lambda p: length(p) BETWEEN 2 AND 8)) > 0 THEN [] ELSE list_concat({_runs(4)}[1:4], {_runs(3)}[1:4]) END)"""
_FURTHER = rf"""tk AS (SELECT row, t, regexp_extract_all(t, '{generate.TOKEN.replace(generate.CJK, '一-鿿')}') AS k FROM src),
    mt AS (SELECT row, t, flatten(list_transform(k, lambda x, i: CASE WHEN regexp_matches(x, '^[A-Za-z]') AND regexp_matches(coalesce(k[i + 1], ''), '^[一-鿿]') AND length(x) + length(k[i + 1]) <= 8 THEN [x || k[i + 1], x] ELSE [x] END)) AS m FROM tk),
    kw AS (SELECT row, list_concat(list_filter({_strings(lexicon.VISUAL_DOMAIN)}, lambda x: contains(t, x)), list_filter(flatten(list_transform(m, lambda x: CASE WHEN regexp_full_match(x, '[A-Za-z][A-Za-z0-9._-]*|[0-9]+([.][0-9]+)*')
        THEN CASE WHEN lower(x) IN {'(' + ', '.join(map(lit, lexicon.STOP_EN)) + ')'} THEN [] ELSE [upper(x)] END WHEN length(x) <= 6 THEN list_concat([x], {_runs(3)}, {_runs(2)}) ELSE {_LONG} END)), lambda x: NOT list_contains({_strings(lexicon.STOP_ZH)}, x))) AS u FROM mt),
    un AS (SELECT row, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM kw),
    ds AS (SELECT row, x, min(i) AS i FROM un WHERE length(x) BETWEEN 2 AND 12 AND NOT list_contains({_strings((*generate.VISUAL_LISTED, *lexicon.VISUAL_NOISE))}, x) GROUP BY 1, 2),
    fu AS (SELECT row, string_agg(x, ',' ORDER BY i) AS further_terms FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY i) AS n FROM ds) WHERE n <= 4 GROUP BY 1)"""


@query(
    "WITH src AS (SELECT row_number() OVER () AS row, doc_id, text || CASE doc_id % 3 WHEN 0 THEN '指示灯闪烁，屏幕破损' WHEN 1 THEN '按钮卡住' ELSE '' END AS t FROM documents),\n    " + _FURTHER + "\n    SELECT doc_id, "
    + ", ".join("array_to_string(list_filter(" + _strings(w) + ", lambda x: contains(t, x))[1:4], ',') AS " + n for n, w in (("component_terms", lexicon.VISUAL_COMPONENT), ("status_terms", lexicon.VISUAL_STATUS), ("issue_terms", lexicon.VISUAL_ISSUE)))
    + ", CASE WHEN t IS NOT NULL THEN coalesce(further_terms, '') END AS further_terms FROM src LEFT JOIN fu USING (row)"
)
def visual_terms(spark, sf_dir):
    """All four lists of each document. The fourth has a name of its own: the struct's other_terms, made of all keywords of a text, isn't made for it."""
    said = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "指示灯闪烁，屏幕破损").when(F.col("doc_id") % 3 == 1, "按钮卡住").otherwise(""))
    seen = generate.visual_terms(said)
    lists = {n: seen[n] for n in ("component_terms", "status_terms", "issue_terms")} | {"further_terms": generate.further_terms(said)}
    return table(spark, sf_dir, "documents").select("doc_id", *[F.array_join(v, ",").alias(n) for n, v in lists.items()])


_PAIRS = "qa AS (SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant')"


def _asked(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    q = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"])


@query(
    rf"""WITH {_PAIRS},
    w AS (SELECT *, list_filter(list_transform(string_split_regex(answer, '[。！？.!?]'), lambda x: {strip('x')}), lambda x: x <> '') AS said, list_distinct(regexp_extract_all(lower(question), '[一-鿿]{{2,}}|[A-Za-z]{{3,}}')) AS terms,
          regexp_replace(lower(question), '\s+', '', 'g') AS body FROM qa),
    g AS (SELECT *, len(list_filter(said, lambda s: len(regexp_extract_all(s, '[一-鿿]{{2,}}|[A-Za-z]{{3,}}')) > 0 AND
            len(list_filter(regexp_extract_all(s, '[一-鿿]{{2,}}|[A-Za-z]{{3,}}'), lambda x: contains(body, lower(x)))) * 10 >= len(regexp_extract_all(s, '[一-鿿]{{2,}}|[A-Za-z]{{3,}}')) * 3)) AS n FROM w)
    SELECT conv_id, turn, round(CASE WHEN len(said) = 0 THEN 0 ELSE n / len(said) END::DOUBLE, 4) AS faithfulness,
           round(CASE WHEN len(terms) = 0 THEN 0.5 ELSE len(list_filter(terms, lambda x: contains(lower(answer), x))) / len(terms) END::DOUBLE, 4) AS relevancy,
           (CASE WHEN length(answer) >= 50 THEN 30 ELSE 0 END + CASE WHEN length(answer) >= 150 THEN 20 ELSE 0 END + CASE WHEN regexp_matches(answer, '[0-9]+[.、]') THEN 20 ELSE 0 END + 15) / 100.0::DOUBLE AS completeness
    FROM g"""
)
def self_eval(spark, sf_dir):
    """The question stands for the context."""
    return _asked(spark, sf_dir).select("conv_id", "turn", F.round(evaluate.faithfulness("answer", "question"), 4).alias("faithfulness"), F.round(evaluate.relevancy("question", "answer"), 4).alias("relevancy"), evaluate.completeness("answer").alias("completeness"))


# Cases out of the tables: an answer must hold its question's first word, must not hold 'the', and needs pictures.
_CASES = f"""WITH {_PAIRS}, c AS (SELECT *, split_part({strip('question')}, ' ', 1) AS first FROM qa),
f AS (SELECT conv_id, turn, list_filter([CASE WHEN NOT contains(answer, first) THEN 'missing answer term: ' || first END, CASE WHEN contains(answer, 'the') THEN 'unexpected answer term: the' END,
      CASE WHEN turn % 3 < 1 THEN 'image_ids too few' END, CASE WHEN length(answer) > 2000 THEN 'unexpected response code' END], lambda x: x IS NOT NULL) AS failures FROM c)"""


def _checked(spark, sf_dir):
    none, text = F.array().cast("array<string>"), F.lit(None)
    first = F.split(T.strip("question"), " ")[0]
    rows = _asked(spark, sf_dir).withColumns({
        "sources": none, "detail": F.lit(""), "n_images": (F.col("turn") % 3).cast("int"), "http_status": text.cast("int"), "code": F.when(F.length("answer") > 2000, 1).otherwise(0), "confidence": text.cast("double"),
        "expect_contains": F.array(first), "expect_not_contains": F.array(F.lit("the")), "expect_sources_contains": none, "expect_error_contains": none, "expect_http_status": text.cast("int"),
        "min_image_ids": F.lit(1), "max_image_ids": text.cast("int"), "min_confidence": text.cast("double"), "max_confidence": text.cast("double"),
    })
    return evaluate.check_case(rows)


@query(f"{_CASES} SELECT conv_id, turn, len(failures) = 0 AS ok, array_to_string(failures, '|') AS failures FROM f")
def case_check(spark, sf_dir):
    return _checked(spark, sf_dir).select("conv_id", "turn", "ok", F.array_join("failures", "|").alias("failures"))


@query(f"{_CASES} SELECT turn AS category, count(*) AS total, count(*) FILTER (WHERE len(failures) = 0) AS passed FROM f GROUP BY 1")
def eval_summary(spark, sf_dir):
    return evaluate.summary(_checked(spark, sf_dir), "turn").withColumnRenamed("turn", "category")


@query(f"{_CASES} SELECT split_part(x, ':', 1) AS issue, count(*) AS n FROM (SELECT unnest(failures) AS x FROM f) GROUP BY 1")
def issue_histogram(spark, sf_dir):
    return evaluate.issue_histogram(_checked(spark, sf_dir))


@query("SELECT lang, source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY CUBE (lang, source)")
def corpus_cube(spark, sf_dir):
    return table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").cast("long").alias("chars"))


@query(
    f"""WITH {_BM25}, q AS (SELECT item_id AS query_id, {strip('text')} AS t FROM benchmark), r AS (SELECT query_id, doc_id FROM q JOIN documents ON contains(text, t)),
    h AS (SELECT r.query_id, r.doc_id, bm.rank FROM r LEFT JOIN bm ON bm.query_id = r.query_id AND bm.doc_id = r.doc_id AND bm.rank <= 10)
    SELECT query_id, count(*) AS n_relevant, count(rank) AS n_found FROM h GROUP BY 1"""
)
def retrieval_recall(spark, sf_dir):
    """Of the documents that hold a question's text, how many are among its first ten."""
    from .search_queries import _bm25

    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.strip("text").alias("needle"))
    relevant = grams.holding(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], items).select("doc_id", "needle").join(items, "needle").select("query_id", "doc_id")
    found = _bm25(spark, sf_dir, 10).select("query_id", "doc_id", "rank")
    return relevant.join(found, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"), F.count("rank").alias("n_found"))
