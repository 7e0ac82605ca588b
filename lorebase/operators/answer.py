"""Answers: assembly, extraction, cleaning, files for submission. Language models are optional and given by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import bind, col, compact, overlap, overlap_keys, sentence_key, squeeze, strip, sub, term_keys, tidy_sentence
from ..functions.text import evidence as evidence_text
from . import classify, generate
from .submission import alike

# Fixed values of answer texts.
FALLBACK, NO_ANSWER, SAFETY = "根据现有资料无法", "根据现有资料无法准确回答此问题。", "涉及安全操作时请以原说明书为准。"
TEMPLATES, LEAST_KEY = 1000, 4
PICS, DISCLAIMER = 3, r"请以实际产品型号和说明书原文为准[。]?\s*"


def dedupe(c) -> Column:
    """Repeated and tiny sentences go, at most three pictures stay."""
    t = sub(sub(c, r'<IMG\s+src=""[^>]*/>'), DISCLAIMER)
    parts = F.split(t, "<PIC>")
    t = F.when(F.size(parts) > PICS + 1, F.concat(F.array_join(F.slice(parts, 1, PICS + 1), "<PIC>"), F.array_join(F.slice(parts, PICS + 2, 1 << 20), ""))).otherwise(t)
    key = lambda s: sub(compact_case(s), r"</?PIC>")
    keyed = F.filter(F.transform(sentences(t), lambda s: F.struct(key(s).alias("k"), s.alias("s"))), lambda x: F.length(x["k"]) >= LEAST_KEY)
    # The first sentence of each key: where a key stands first among all keys.
    whole = lambda rows: bind(F.transform(rows, lambda x: x["k"]), lambda keys: F.array_join(F.transform(F.filter(F.transform(rows, lambda x, k: F.struct(x["s"].alias("s"), (F.array_position(keys, x["k"]) == k + 1).alias("new"))), lambda x: x["new"]), lambda x: x["s"]), " "))
    joined = strip(sub(sub(bind(keyed, whole), r"（相关配图：[^）]*）"), r"(?U)\s{2,}", " "))
    return F.when(joined != "", joined).otherwise(strip(t))


def sentences(c) -> Column:
    """Sentences by their marks and white space, without empty ones."""
    return F.filter(F.transform(F.split(col(c), r"(?U)(?<=[。！？.!?])\s+"), lambda s: strip(s)), lambda s: s != "")


def says_something(c) -> Column:
    """Whether a sentence is long enough to be kept, white space aside."""
    return F.exists(sentences(c), lambda s: F.length(compact_case(s)) >= LEAST_KEY)


def compact_case(c) -> Column:
    return sub(c, r"(?U)\s+")


def lines_once(c) -> Column:
    """Of equal lines in a row the first stays."""
    kept = lambda lines: F.filter(F.transform(lines, lambda x, k: F.struct(x.alias("x"), F.get(lines, k - 1).alias("p"))), lambda s: s["p"].isNull() | (s["p"] != s["x"]) | (s["x"] == ""))
    return bind(F.split(col(c), "\n"), lambda lines: F.array_join(F.transform(kept(lines), lambda s: s["x"]), "\n"))


def manual_format(conclusion: Column, details: Column, caution: Column, n_images: Column) -> Column:
    """A conclusion, numbered details, a caution, and up to three pictures; without a conclusion the fallback."""
    numbered = F.array_join(F.transform(F.slice(details, 1, 3), lambda d, k: F.concat((k + 1).cast("string"), F.lit(". "), d)), "\n")
    pics = F.when(n_images > 0, F.concat(F.lit("相关配图如下："), F.repeat(F.lit("<PIC>"), F.least(n_images, F.lit(PICS)))))
    whole = F.concat_ws("\n\n", conclusion, F.nullif(numbered, F.lit("")), F.nullif(caution, F.lit("")), pics)
    return F.when(F.coalesce(conclusion, F.lit("")) == "", F.lit(NO_ANSWER)).otherwise(whole)


def service_format(c) -> Column:
    """One line of plain text."""
    return lines_once(squeeze(F.replace(F.replace(col(c), F.lit("**"), F.lit("")), F.lit("#"), F.lit(""))))


def merge_answers(rows: DataFrame, key: str = "query_id", order: str = "sub_no", answer: str = "answer") -> DataFrame:
    """Several answers under numbered heads; a single one stays as it is."""
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(answer).alias("a")))).alias("l"))
    many = F.array_join(F.transform("l", lambda x, k: F.concat(F.lit("问题"), (k + 1).cast("string"), F.lit("："), x["a"])), "\n")
    return lists.select(key, F.when(F.size("l") == 1, F.get("l", F.lit(0))["a"]).otherwise(many).alias(answer))


# Words of a question that asks what to do, and of sentences that tell it.
ASKS_HOW = r"(?i)\b(how|operate|operation|use|using|press|select|turn|open|close)\b"
TELLS_HOW = ("go to", "press", "select", "turn", "open", "close", "move", "enter", "install", "remove")
ASIDES = r"(?i)^(note:|note |and it |it also |this device support)"
POINTS_BACK = r"(?i)^(this |these |it |they |the device |the labels )"
BONUS, MOST_BONUS, PENALTY = 2.0, 6.0, 3.0
#: Chunks that an extractive answer reads.
CHUNKS = 3


def bonus(c) -> Column:
    """Two points for each word that tells what to do, six at most."""
    t = F.lower(col(c))
    return F.least(sum((F.when(t.rlike(rf"\b{w}\b"), BONUS).otherwise(0.0) for w in TELLS_HOW), F.lit(0.0)), F.lit(MOST_BONUS))


def extractive(evidence: DataFrame, query: str = "query", pictures: int = 0) -> DataFrame:
    """query_id, answer: the best sentences of a query's first three chunks, as conclusion and details.

    evidence: query_id, evidence_rank, title, text, terms, and the query's text. Sentences are scored where they are; what
    comes together for a query is three short lists. Titles count too: a sentence that only repeats the best title is
    left out, or takes its place if it says more.
    """
    how, clean = F.col("__q").rlike(ASKS_HOW), lambda t: tidy_sentence(t)
    first = evidence.where(f"evidence_rank <= {CHUNKS}").select("query_id", "evidence_rank", "terms", F.col(query).alias("__q"), evidence_text("title").alias("title"), "text")
    extra = lambda t: F.when(how, bonus(t)).otherwise(0.0)
    titled = F.when((F.col("title") != "") & ~classify.toc_noise("title"), F.struct((-(overlap(F.col("title"), F.col("terms")) + 2.0 + extra("title"))).alias("a"), (F.length("title") > 160).cast("int").alias("b"), "evidence_rank", F.col("title").alias("text")))

    def scored(s, k, keys):
        made = lambda points: F.struct(
            (-(points + extra(s) - F.when(how & s.rlike(ASIDES), PENALTY).otherwise(0.0))).alias("a"), (F.length(s) > 220).cast("int").alias("b"), F.col("evidence_rank").alias("r"), k.alias("k"), s.alias("text"), ((points > 0) | (F.length(s) >= 80)).alias("fit"),
        )
        return bind(overlap_keys(s, keys), made)

    # Sentences of a table of contents and those without a term are no candidates. The terms are made ready once for all sentences.
    kept = lambda keys: F.filter(F.transform(F.filter(generate.evidence_sentences("text"), lambda s: ~classify.toc_noise(s)), lambda s, k: scored(s, k, keys)), lambda x: x["fit"])
    said = bind(term_keys(F.col("terms")), kept)
    rows = first.select("query_id", "__q", titled.alias("t"), said.alias("s"), F.struct("evidence_rank", F.left(evidence_text(F.concat_ws(" ", "title", "text")), F.lit(320)).alias("text")).alias("f"))
    one = rows.groupBy("query_id").agg(F.first("__q").alias("__q"), F.min("t.a").isNotNull().alias("any"), F.min("t").alias("t"), F.array_sort(F.flatten(F.collect_list("s"))).alias("s"), F.min("f").alias("f"))
    usable = F.filter("s", lambda x: ~(how & x["text"].rlike(r":\s*$")))
    title = F.coalesce(F.col("t.text"), F.lit(""))

    # What is said and the title go with their keys, so that each is made once.
    state = lambda title, names, said, keys: F.struct(title.alias("title"), names.alias("names"), said.alias("said"), keys.alias("keys"))

    def step(held, x):
        own = lambda key: F.when(key == "", held).otherwise(bind((held["title"] != "") & alike(key, held["names"], 0), lambda repeats: placed(held, x, key, repeats)))
        aside = how & (F.size(held["said"]) > 0) & x["text"].rlike(ASIDES)
        return F.when((F.size(held["said"]) >= 3) | aside, held).otherwise(bind(sentence_key(x["text"]), own))

    def placed(held, x, key, repeats):
        longer = (F.length(x["text"]) > F.length(held["title"]) + 20) & key.contains(held["names"])
        better = repeats & (longer | (classify.truncated_heading(held["title"]) & (bonus(x["text"]) > 0)))
        again = F.exists(held["keys"], lambda h: alike(key, h, 0))
        text = clean(x["text"])
        named = lambda t: state(t, sentence_key(t), held["said"], held["keys"])
        more = lambda t: state(held["title"], held["names"], F.concat(held["said"], F.array(t)), F.concat(held["keys"], F.array(sentence_key(t))))
        return F.when(better, bind(text, named)).when(repeats | again, held).otherwise(bind(text, more))

    none = F.array().cast("array<string>")
    chosen = F.aggregate(usable, bind(title, lambda t: state(t, sentence_key(t), none, none)), step)
    out = one.withColumn("c", chosen).withColumn("said", F.when(F.size("c.said") > 0, F.col("c.said")).otherwise(F.array(clean(F.col("f.text")))))
    out = out.select("query_id", "__q", "said", F.when(F.col("c.title") == "", "").otherwise(clean(F.col("c.title"))).alias("title"), F.get("said", F.lit(0)).alias("top"))
    same = alike(sentence_key("title"), sentence_key("top"), 0)
    conclusion = (
        F.when(F.col("title") == "", F.col("top")).when(F.col("top") == "", F.col("title"))
        .when(same, F.when(F.length("top") >= F.length("title"), F.col("top")).otherwise(F.col("title")))
        .when(how & (bonus("title") > 0), F.col("title"))
        .when(classify.ascii_heavy("__q") & F.col("top").rlike(POINTS_BACK), F.concat("title", F.lit(": "), "top"))
        .otherwise(F.col("top"))
    )
    out = out.withColumn("conclusion", conclusion)
    differs = lambda s: ~alike(sentence_key(s), sentence_key("conclusion"), 0) & (sentence_key(s) != "")
    details = F.filter(F.slice("said", 2, 2), differs)
    details = F.when(F.size(details) > 0, details).otherwise(F.filter(F.slice("said", 1, 1), differs))
    caution = F.when(classify.ascii_heavy("__q"), "").otherwise(SAFETY)
    return out.select("query_id", manual_format(F.col("conclusion"), details, caution, F.lit(pictures)).alias("answer"))


def answer_with(prompts: DataFrame, client: Callable[[], Callable[[str], str]] | None = None, prompt: str = "prompt", default: str = "fallback") -> DataFrame:
    """Adds answer and error. client makes, once for each worker, a function from prompt to answer; an error, an
    empty answer or no client gives the default column's text, so that one failing call never ends the job."""
    if client is None:
        return prompts.withColumn("answer", F.col(default)).withColumn("error", F.lit(None).cast("string"))
    kind = StructType([*prompts.schema.fields]).add("answer", "string").add("error", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for batch in batches:
            said = []
            for p, d in zip(batch[prompt], batch[default]):
                try:
                    text = ask(p)
                    said.append((text or d, None))
                except Exception as e:  # noqa: BLE001  whatever the client raises is this row's error
                    said.append((d, str(e)))
            yield batch.assign(answer=[a for a, _ in said], error=[e for _, e in said])

    return prompts.mapInPandas(run, kind)


def prompt(system: Column, summary: Column, image: Column, history: Column, question: Column) -> Column:
    """What a model is given, empty parts left out."""
    return F.concat_ws("\n\n", *[F.nullif(strip(x), F.lit("")) for x in (system, summary, image, F.array_join(history, "\n"), question)])


def override(rows: DataFrame, overrides: DataFrame, templates: DataFrame, key: str = "id", text: str = "text", answer: str = "answer") -> DataFrame:
    """A stated answer for an id, else the template of the first keyword in the text (for empty answers), else what there is.

    overrides: key, override. templates: pos, keyword, template: a rule table written by hand, of bounded size.
    """
    known = templates.orderBy("pos").limit(TEMPLATES + 1).collect()
    if len(known) > TEMPLATES:
        raise ValueError(f"more than {TEMPLATES} templates")
    template = F.coalesce(F.lit(None).cast("string"), *[F.when(F.col(text).contains(r.keyword), F.lit(r.template)) for r in known])
    out = rows.withColumn("template", template).join(overrides, key, "left")
    return out.withColumn(answer, F.coalesce("override", F.nullif(F.col(answer), F.lit("")), "template", F.lit(NO_ANSWER))).drop("override", "template")


def answer_status(question) -> Column:
    """The status that a service would give."""
    return F.when(compact(F.coalesce(col(question), F.lit(""))) == "", 400).otherwise(200)
