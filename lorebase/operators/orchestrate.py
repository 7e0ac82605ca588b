"""From a whole table of turns to answers: control, route, retrieval, evidence, answer, in one plan.

Each turn carries what was decided about it: its resolved question, its branch, and what went wrong. Branches are disjoint
filters over one written table of decisions, each a plan of its own; their answers are put together again. Nothing that
one turn raises ends another: a turn whose client fails gets the extractive answer and keeps the error.

    blank        no question: status 400
    clear        the session was reset
    clarify      another product is meant and none is named
    smalltalk    a stated reply
    service      an answer of the policy's rules
    no_evidence  nothing that was retrieved holds up
    manual       an answer out of evidence, by the client or extractive

Cases: null and blank questions are blank; repeated turns are answered as often as they come, those that differ in
nothing alike; an empty table gives an empty result; extra columns of turns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact, strip
from . import answer as A
from . import dialog, evaluate, fuse, generate, submission
from .index import sent_blocks
from .shared import shared_dir, written

# Stated answers and what they are worth.
STATED = {
    "blank": ("", 0.0),
    "clear": ("已清空本次会话上下文。你可以重新告诉我产品名称、型号、问题现象，或上传图片继续查询。", 0.99),
    "clarify": ("我理解你可能想切换到另一个产品。请补充新的产品名称或型号后再问，我会避免沿用上一轮产品上下文。", 0.55),
}
REPLIES = {
    "greeting": "你好，我是工业产品客服智能体。你可以告诉我产品名称、型号、故障现象，或直接上传图片，我会尽量基于说明书资料帮你查询。",
    "thanks": "不客气。如果你愿意，可以继续告诉我具体的产品名称、型号、问题现象或上传图片，我来继续帮你查。",
    "farewell": "再见。如果之后还有产品使用、安装、故障或配件相关问题，随时可以再来问我。",
}
REPLY_CONFIDENCE, NO_EVIDENCE_CONFIDENCE, FETCHED = 0.99, 0.15, 10

#: What answers a table of questions (query_id, text) with rows of query_id, chunk_id, score and, where no table of chunks is given, title, text, product_name.
Search = Callable[[DataFrame, int], DataFrame]


def decisions(turns: DataFrame) -> DataFrame:
    """query_id, conv_id, turn, question, resolved, summary, branch, intent, route_confidence for each user turn.

    turns: as dialog.fold_sessions takes them; session_route and n_topics where a service keeps them.
    """
    given = lambda c, kind: F.col(c) if c in turns.columns else F.lit(None).cast(kind)
    asked = turns.where("role = 'user'").select("conv_id", "turn", strip(F.coalesce("text", F.lit(""))).alias("question"), given("session_route", "string").alias("before"), F.coalesce(given("n_topics", "int"), F.lit(0)).alias("n_topics")).distinct()
    rows = asked.join(dialog.fold_sessions(turns).select("conv_id", "turn", "resolved", "summary", "reset", "needs_clarification"), ["conv_id", "turn"])
    named = (F.size(generate.products("question")) > 0) | (F.size(generate.models("question")) > 0)
    rows = rows.withColumns({"r": dialog.route("question"), "intent": dialog.smalltalk("question"), "named": named})
    stays = F.coalesce(dialog.inherits_service("question", F.col("r.route"), F.col("before"), F.col("n_topics"), F.col("named"), strict=False), F.lit(False))
    branch = (
        F.when(F.col("question") == "", "blank").when(F.col("reset"), "clear").when(F.col("needs_clarification"), "clarify")
        .when(F.col("intent").isNotNull(), "smalltalk").when((F.col("r.route") == "customer_service") | stays, "service").otherwise("manual")
    )
    return rows.select(F.concat("conv_id", F.lit(":"), "turn").alias("query_id"), "conv_id", "turn", "question", "resolved", "summary", branch.alias("branch"), "intent", F.col("r.confidence").alias("route_confidence"))


def _row(branch, answer, confidence, sources=None, n_retrieved=0, n_evidence=0, first=None, error=None, faithful=None) -> list[Column]:
    """The columns of an answer, in the order of every branch."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [
        F.col("conv_id"), F.col("turn"), col(branch).alias("branch"), col(answer).alias("answer"), col(confidence).cast("double").alias("confidence"),
        (F.array().cast("array<string>") if sources is None else sources).alias("sources"), col(n_retrieved).cast("long").alias("n_retrieved"), col(n_evidence).cast("long").alias("n_evidence"),
        col(first).cast("string").alias("first_chunk"), col(faithful).cast("double").alias("faithfulness"), col(error).cast("string").alias("error"),
    ]


def stated_answers(rows: DataFrame) -> DataFrame:
    """Turns that need no search: control commands, blank questions, small talk."""
    pick = lambda part: F.coalesce(*[F.when(F.col("branch") == b, F.lit(v[part])) for b, v in STATED.items()])
    reply = F.coalesce(*[F.when(F.col("intent") == i, F.lit(t)) for i, t in REPLIES.items()])
    wrong = F.when(F.col("branch") == "blank", "400: the question is empty")
    own = rows.where(F.col("branch").isin(*STATED, "smalltalk"))
    return own.select(*_row(F.col("branch"), F.coalesce(pick(0), reply), F.coalesce(pick(1), F.lit(REPLY_CONFIDENCE)), error=wrong))


def service_answers(rows: DataFrame, topics: DataFrame, scenarios: DataFrame) -> DataFrame:
    own = rows.where("branch = 'service'")
    said = dialog.policy_answers(own.select("query_id", F.col("question").alias("text")).distinct(), topics, scenarios)
    return own.join(said, "query_id").select(*_row("service", A.service_format("answer"), F.least("route_confidence", "confidence"), F.array(F.lit("customer_service_policy"))))


def evidence(found: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """What holds up of the rows that were found, without their texts: these are read where they are, and what was found
    goes to them in blocks of bounded size, each a pass over the chunks. found: query_id, chunk_id, score. questions:
    query_id, query_terms (those of the turn itself). Adds title, product_name and n_text, the length of the trimmed text."""
    folder, none = shared_dir(found.sparkSession, "scored"), F.array().cast("array<string>")
    kind = None
    for pairs, asked in sent_blocks(found, questions, by="query_id"):
        # A chunk's text is made compact once for all questions that found it.
        rows = chunks.join(F.broadcast(pairs.groupBy("chunk_id").agg(F.collect_list(F.struct("query_id", "score")).alias("__of"))), "chunk_id")
        rows = rows.select("chunk_id", "title", "product_name", F.length(F.trim("text")).alias("n_text"), compact("title").alias("__t"), compact("text").alias("__x"), "__of")
        rows = rows.select("*", F.explode("__of").alias("__p")).select("*", "__p.*").drop("__of", "__p").join(asked, "query_id")
        rows = rows.withColumns({"n_images": F.lit(0), "variant_hits": F.lit(1), "image_terms": none, "component_terms": none, "status_terms": none, "issue_terms": none})
        scored = fuse.evidence_score(rows).drop("query_terms", "image_terms", "component_terms", "status_terms", "issue_terms")
        scored.write.mode("append").parquet(folder)
        kind = scored.schema
    return fuse.filter_evidence(found.sparkSession.read.schema(kind).parquet(folder), fuse.evidence_order())


def _said(kept: DataFrame, questions: DataFrame, asked: DataFrame, chunks: DataFrame, client) -> DataFrame:
    """key, answer, confidence, error, faithfulness of what has evidence. kept: as evidence gives it. asked: query_id, key, query,
    summary: what is answered out of a question's evidence. Texts go where answers are made, and no further."""
    spark, folder, kind, empty = kept.sparkSession, shared_dir(kept.sparkSession, "said"), None, F.lit("")
    part = lambda text: fuse.part_text(F.col("evidence_rank"), F.col("product_name"), F.col("title"), F.col("score"), text)
    sized = written(fuse.context_sizes(kept.select("query_id", "evidence_rank", "chunk_id", "product_name", "title", "score", "n_text"), F.length(part(empty)) + F.col("n_text")), "sized")
    sure = fuse.confidence(kept.select("query_id", "score", F.col("evidence_rank").alias("rank_")), "score", "rank_")
    texts, first = chunks.select("chunk_id", "text"), asked.groupBy("query_id").agg(F.min("query").alias("query"))
    best = kept.where(f"evidence_rank <= {A.CHUNKS}").select("query_id", "chunk_id", "evidence_rank", "title")
    for own, fit, terms, queries in sent_blocks(best, sized, questions.withColumnRenamed("query_terms", "terms"), first, by="query_id"):
        fallback = A.extractive(texts.join(own, "chunk_id").join(terms, "query_id").join(queries, "query_id")).withColumnRenamed("answer", "fallback")
        parts = texts.join(fit, "chunk_id").select("query_id", F.struct("evidence_rank", fuse.cut_part(part(F.col("text"))).alias("part")).alias("p"))
        context = parts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["part"]), "\n\n").alias("context"))
        prompts = asked.join(context, "query_id").join(fallback, "query_id").join(sure, "query_id").withColumn("prompt", A.prompt(empty, F.col("summary"), empty, F.array(F.col("context")), F.col("query")))
        said = A.answer_with(prompts, client).withColumn("answer", submission.manual_answer("answer", F.array().cast("array<string>")))
        said = said.select("key", "answer", "confidence", "error", evaluate.faithfulness("answer", "context").alias("faithfulness"))
        said.write.mode("append").parquet(folder)
        kind = said.schema
    return spark.read.schema(kind).parquet(folder)


def manual_answers(rows: DataFrame, search: Search, terms: Callable[[Column | str], Column], client=None, k: int = FETCHED, chunks: DataFrame | None = None) -> DataFrame:
    """Turns that say the same are searched for and, without a client, answered once. chunks: chunk_id, title, text, product_name of
    all chunks; without them the rows that search gives must have these columns."""
    own = rows.where("branch = 'manual'")
    said = F.array_sort(F.collect_set(F.struct("question", "resolved")))
    turns = written(own.groupBy("query_id").agg(said.alias("said"), F.min("summary").alias("summary")).select(F.col("query_id").alias("turn_id"), "said", "summary", F.sha2(F.to_json("said"), 256).alias("case")), "asked")
    cases = written(turns.groupBy("case").agg(F.first("said").alias("said")).withColumn("query_id", F.monotonically_increasing_id()), "cases")
    each = cases.select("query_id", F.explode("said").alias("s"))
    found = search(each.select("query_id", F.col("s.resolved").alias("text")).distinct(), k)
    if chunks is None:
        found = written(found, "texts")
        chunks = found.select("chunk_id", "title", "text", "product_name").dropDuplicates(["chunk_id"])
    found = written(found.select("query_id", "chunk_id", "score"), "found")
    questions = written(each.select("query_id", terms("s.question").alias("query_terms")).distinct(), "questions")
    kept = written(evidence(found, questions, chunks), "evidence")
    counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_retrieved"))
    best = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_evidence"), F.min_by("chunk_id", "evidence_rank").alias("first"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("evidence_rank", "product_name"))), lambda x: x["product_name"])).alias("sources"))
    of = turns.join(cases.select("case", "query_id"), "case").select("turn_id", "query_id", F.get("said", F.lit(0))["resolved"].alias("query"), "summary")
    # Only a client is told what was said before, so that only its answers differ for turns that say the same.
    key = F.col("query_id").cast("string") if client is None else F.col("turn_id")
    asked = of.select("query_id", key.alias("key"), "query", F.lit("").alias("summary") if client is None else F.col("summary")).distinct()
    answered = _said(kept, questions, asked, chunks, client)
    done = own.select("conv_id", "turn", F.col("query_id").alias("turn_id")).join(of.select("turn_id", "query_id", key.alias("key")), "turn_id")
    done = done.join(counts, "query_id", "left").join(best, "query_id", "left").join(answered, "key", "left")
    some = F.col("answer").isNotNull()
    return done.select(*_row(
        F.when(some, "manual").otherwise("no_evidence"), F.coalesce("answer", F.lit(submission.EMPTY_ANSWER)), F.coalesce("confidence", F.lit(NO_EVIDENCE_CONFIDENCE)), F.coalesce("sources", F.array().cast("array<string>")),
        F.coalesce("n_retrieved", F.lit(0)), F.coalesce("n_evidence", F.lit(0)), F.col("first"), F.col("error"), F.col("faithfulness"),
    ))


def answer_turns(turns: DataFrame, search: Search, topics: DataFrame, scenarios: DataFrame, client=None, terms: Callable[[Column | str], Column] | None = None, k: int = FETCHED, chunks: DataFrame | None = None) -> DataFrame:
    """conv_id, turn, branch, answer, confidence, sources, n_retrieved, n_evidence, first_chunk, faithfulness, error."""
    rows = written(decisions(turns), "decisions")
    own_terms = terms or (lambda c: F.transform(generate.keywords(c), lambda w: F.lower(w)))
    return stated_answers(rows).unionByName(service_answers(rows, topics, scenarios)).unionByName(manual_answers(rows, search, own_terms, client, k, chunks))
