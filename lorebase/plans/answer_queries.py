"""Queries of answers made ready to hand in, over planted conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import submission
from . import planted
from .base import lit, query, squeeze, strip
from .planted import over_conversations

NO_STRINGS = "array<string>"


def _steps(x: str, *steps: tuple[str, str]) -> str:
    """Regular expressions of the library as SQL."""
    for pattern, to in steps:
        x = f"regexp_replace({x}, {lit(pattern.replace('(?U)', '').replace(chr(92) + '）', '）'))}, {lit(to.replace('$1', chr(92) + '1'))}, 'g')"
    return x


def _labels(x: str) -> str:
    for label in (*submission.LABELS, "**"):
        x = f"replace({x}, {lit(label)}, '')"
    return x


def _trim(x: str, marks: str = submission.ENDS) -> str:
    return f"trim({x}, {lit(marks)})"


_QA = "SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'"
_SAID = """'问题1：' || question || chr(10) || '回答：**' || CASE turn % 5 WHEN 1 THEN '根据现有资料无法回答此问题。' WHEN 2 THEN '根据现有资料无法准确回答此问题。' ELSE answer END
    || '**[参考1] Manual12_3 （参考 2）' || chr(10) || chr(10) || '- 无参考资料没有提到。' || chr(10) || '相关图片：' || chr(10) || '- Manual1_2'"""
_STEP1 = _steps(_labels("x"), (submission.PICTURES, ""), (submission.PICTURE_IDS, ""), ("- 无", ""), ("- ", ""), *((p, "") for p in submission.ABOUT_SOURCES))
_STEP2 = _trim(_steps("x1", *((p, "") for p in submission.INTERNAL), (r"\s{2,}", " "), (r"\s+([。！？.!?])", "$1")))
_STEP3 = _trim(_steps("x2", (r"\n{2,}", "\n"), (r"[ \t]{2,}", " "), (r"\s+\n", "\n"), (r"\n+", " ")), " |;；，,")
_STEP4 = _trim(_steps("t", *((p, "") for p in submission.REFUSALS), (r"\s{2,}", " "), ("[。]{2,}", "。")))
_STEP5 = _trim(_steps("s1", (r"\s{2,}", " "), (r"^[，,；;。:：\s]+", ""), (r"\s+[，,；;。:：]", "")))


@query(over_conversations(
    rf"""WITH qa AS ({_QA}), r AS (SELECT *, {strip(_SAID)} AS x, CASE WHEN turn % 3 = 0 THEN ['a' || turn, 'b'] ELSE [] END AS ids FROM qa),
    r1 AS (SELECT *, {_STEP1} AS x1 FROM r), r2 AS (SELECT *, {_STEP2} AS x2 FROM r1), c AS (SELECT *, {_STEP3} AS t FROM r2),
    d AS (SELECT *, {_STEP4} AS s0, {_trim(squeeze('question'), " ,，;；" + chr(34) + chr(39))} AS q FROM c),
    e AS (SELECT *, CASE WHEN length(q) >= 6 AND position(q IN s0) > 0 THEN left(s0, position(q IN s0) - 1) || substr(s0, position(q IN s0) + length(q)) ELSE s0 END AS s1 FROM d),
    f AS (SELECT *, {_STEP5} AS s FROM e),
    g AS (SELECT *, {strip('t')} = '' OR {strip('t')} = {lit(submission.EMPTY_ANSWER)} OR {strip('s')} = '' OR (length(regexp_replace(s, '\s+', '', 'g')) < 18 AND (contains(t, '根据现有资料无法准确回答此问题') OR contains(t, '根据现有资料无法回答此问题'))) AS pure FROM f),
    h AS (SELECT *, {_trim(_steps("CASE WHEN s <> '' THEN s ELSE t END", (chr(92) + "s{2,}", " ")), " ，,；;")} AS u FROM g),
    i AS (SELECT *, CASE WHEN regexp_matches(u, '[。！？]$') THEN u ELSE u || '。' END AS w FROM h)
    SELECT conv_id, turn, CASE WHEN pure THEN CASE WHEN {' OR '.join(f"contains(question, {lit(w)})" for w in submission.SERVICE_WORDS)} THEN {lit(submission.SERVICE_ANSWER)} ELSE {lit(submission.MANUAL_ANSWER)} END
        WHEN len(ids) > 0 THEN '"' || CASE WHEN contains(w, '<PIC>') THEN w ELSE rtrim(w, '。！？.!?') || repeat('<PIC>', len(ids)) || '。' END || '";["' || array_to_string(ids, '", "') || '"]' ELSE w END AS ret FROM i"""
))
def submission_clean(spark, sf_dir):
    """Raw answers with labels, ids, pictures, refusals and the question's echo, cleaned; answers out of references are tested on small cases."""
    said = F.expr("concat('问题1：', question, '\\n回答：**', CASE turn % 5 WHEN 1 THEN '根据现有资料无法回答此问题。' WHEN 2 THEN '根据现有资料无法准确回答此问题。' ELSE answer END, '**[参考1] Manual12_3 （参考 2）\\n\\n- 无参考资料没有提到。\\n相关图片：\\n- Manual1_2')")
    ids = F.when(F.col("turn") % 3 == 0, F.array(F.concat(F.lit("a"), F.col("turn").cast("string")), F.lit("b"))).otherwise(F.array().cast(NO_STRINGS))
    rows = answered(spark, sf_dir).select("conv_id", "turn", "question", said.alias("said"), ids.alias("ids"))
    refs = F.array().cast("array<struct<title:string,text_snippet:string>>")
    return rows.select("conv_id", "turn", submission.normalized("said", "question", F.array().cast(NO_STRINGS), "ids", refs).alias("ret"))


def answered(spark, sf_dir):
    rows = planted.conversations(spark, sf_dir)
    q = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"])


def _sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace({strip(x)}, '[；;]+', '。', 'g'), '([。！？])\s*', '\1' || chr(1), 'g'), chr(1)), lambda y: {strip('y')}), lambda y: y <> '')"


def _ended(lines: str) -> str:
    return f"list_transform(list_filter(list_transform({lines}, lambda y: {strip('y')}), lambda y: y <> ''), lambda y: CASE WHEN NOT regexp_matches(y, '[。！？]$') AND length(y) > 4 THEN y || '。' ELSE y END)"


def _once(lines: str) -> str:
    return f"list_filter({lines}, lambda y, k: list_position({lines}, y) = k)"


def _lines(x: str) -> str:
    own = rf"list_filter(list_transform(string_split_regex({x}, '[\n\r]+'), lambda l: {strip(f"regexp_replace({strip('l')}, '^[-*0-9.、 ]+', '')")}), lambda l: l <> '')"
    return _ended(f"flatten(list_transform({own}, lambda l: {_sentences('l')}))")


_PARTED = """CASE turn % 4 WHEN 0 THEN '结论：' || answer || chr(10) || '操作：1. 打开它' || chr(10) || '2. ' || question || '；再关上' || chr(10) || '注意：请勿碰水' || chr(10) || '相关图片：x'
    WHEN 1 THEN answer || '。请勿碰水。' || question WHEN 2 THEN '说明：' || question || chr(10) || '- ' || answer ELSE '根据现有资料无法回答此问题。' END"""
_WARNS = f"lambda x: regexp_matches(x, '{submission.CAUTIONS}')"
_CALM = f"lambda x: NOT regexp_matches(x, '{submission.CAUTIONS}')"


def _renamed(x: str) -> str:
    for a, b in submission.RENAMED:
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x


def _content(p: str) -> str:
    return strip(f"coalesce(split_part(list_filter(p, lambda x: {p})[-1], chr(2), 2), '')")


@query(over_conversations(
    rf"""WITH qa AS ({_QA}), a0 AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN ['p1', 'p2', 'p3', 'p4'] ELSE [] END AS ids, {_PARTED} AS x FROM qa),
    a AS (SELECT *, {strip(_steps(strip("replace(x, '**', '')"), (r"[ \t]+\n", chr(10)), (r"\n{3,}", chr(10) * 2)))} AS t FROM a0),
    b AS (SELECT *, string_split(regexp_replace({_renamed('t')}, {lit(submission.SECTIONS)}, chr(1) || '\1' || chr(2), 'g'), chr(1))[2:] AS p FROM a),
    c AS (SELECT *, len(list_filter(p, lambda x: NOT starts_with(x, '相关图片'))) > 0 AS found, {_content("starts_with(x, '结论')")} AS c0, {_content("regexp_matches(x, '^(操作|说明)')")} AS o0, {_content("starts_with(x, '注意')")} AS w0 FROM b),
    d0 AS (SELECT *, {_lines('c0')} AS ca, {_lines('o0')} AS oa, {_lines('w0')} AS wa, {_ended(_sentences('t'))} AS la FROM c),
    d AS (SELECT *, {_once('ca')} AS c1, {_once('oa')} AS o1, {_once('wa')} AS w1, CASE WHEN len(la) > 0 THEN {_once('la')} ELSE [{lit(submission.SEE_MANUAL)}] END AS l FROM d0),
    f AS (SELECT *, list_filter(l, {_WARNS}) AS lw, list_filter(l[2:4], {_CALM}) AS l3, list_filter(l[2:], {_CALM}) AS lr FROM d),
    g AS (SELECT *, CASE WHEN found THEN c1 ELSE l[1:1] END AS c2, CASE WHEN found THEN o1 WHEN len(l3) > 0 THEN l3 WHEN len(lr) > 0 THEN lr ELSE l[1:1] END AS o2, CASE WHEN found THEN w1 WHEN len(lw) > 0 THEN lw ELSE [{lit(submission.SEE_CAUTIONS)}] END AS w2 FROM f),
    h AS (SELECT *, CASE WHEN len(c2) > 0 THEN c2 WHEN len(o2) > 0 THEN o2[1:1] WHEN len(w2) > 0 THEN w2[1:1] ELSE [{lit(submission.SEE_MANUAL)}] END AS c3 FROM g),
    i AS (SELECT *, CASE WHEN len(o2) > 0 THEN o2 ELSE c3[1:1] END AS o3 FROM h),
    j AS (SELECT *, list_filter(list_concat(o3, c3), {_WARNS}) AS own FROM i),
    k0 AS (SELECT *, CASE WHEN len(w2) > 0 THEN w2 WHEN len(own) > 0 THEN own ELSE [{lit(submission.SEE_CAUTIONS)}] END AS w3 FROM j),
    k AS (SELECT *, {_ended('c3[1:2]')} AS c4, {_ended('o3[1:3]')} AS o4, {_ended(f"(CASE WHEN w3 = c3 THEN [{lit(submission.SEE_CAUTIONS)}] ELSE w3 END)[1:3]")} AS w4 FROM k0)
    SELECT conv_id, turn, CASE WHEN contains(t, '根据现有资料无法回答此问题') THEN {lit(submission.NOT_KNOWN).replace(chr(10), "' || chr(10) || '")} ELSE concat_ws(chr(10) || chr(10), '结论：' || chr(10) || '- ' || array_to_string({_once('c4')}, chr(10) || '- '),
        '操作/说明：' || chr(10) || '- ' || array_to_string({_once('o4')}, chr(10) || '- '), '注意事项：' || chr(10) || '- ' || array_to_string({_once('w4')}, chr(10) || '- '),
        '相关图片：' || chr(10) || '- ' || CASE WHEN len(ids) > 0 THEN array_to_string(ids[1:3], '、') ELSE '无' END) END AS answer FROM k"""
))
def manual_sections(spark, sf_dir):
    """Answers with labelled sections, without, with one section, and refusals."""
    said = F.expr("CASE turn % 4 WHEN 0 THEN concat('结论：', answer, '\\n操作：1. 打开它\\n2. ', question, '；再关上\\n注意：请勿碰水\\n相关图片：x') WHEN 1 THEN concat(answer, '。请勿碰水。', question) WHEN 2 THEN concat('说明：', question, '\\n- ', answer) ELSE '根据现有资料无法回答此问题。' END")
    ids = F.when(F.col("turn") % 3 == 0, F.array(*[F.lit(f"p{k}") for k in range(1, 5)])).otherwise(F.array().cast(NO_STRINGS))
    rows = answered(spark, sf_dir).select("conv_id", "turn", said.alias("said"), ids.alias("ids"))
    return rows.select("conv_id", "turn", submission.manual_answer("said", "ids").alias("answer"))


@query(over_conversations(
    rf"""WITH q AS (SELECT conv_id, turn, text, array_to_string(regexp_extract_all(text, '[一-鿿]+'), '') AS z FROM conversations WHERE role = 'user'),
    t AS (SELECT *, list_concat(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]+'), lambda w: length(w) >= 3), lambda w: lower(w)),
        list_filter(list_concat({", ".join(f"list_transform(range(1, length(z) - {n - 2}), lambda k: substr(z, k, {n}))" for n in (4, 3, 2))}), lambda w: w NOT IN ({", ".join(map(lit, submission.SMALL_TERMS))}))) AS w FROM q)
    SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, k: list_position(w, x) = k), '|') AS terms FROM t"""
))
def question_terms(spark, sf_dir):
    """G14."""
    rows = planted.conversations(spark, sf_dir).where("role = 'user'")
    return rows.select("conv_id", "turn", F.array_join(submission.question_terms("text"), "|").alias("terms"))
