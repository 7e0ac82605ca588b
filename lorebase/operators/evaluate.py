"""Evaluation: how well answers are grounded, whether cases hold, what fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, col, compact, strip
from .answer import FALLBACK

WORDS = "[一-鿿]{2,}|[A-Za-z]{3,}"


def faithfulness(answer, context) -> Column:
    """The share of sentences of which three in ten words are in the context."""
    said = F.filter(F.transform(F.split(col(answer), "[。！？.!?]"), lambda s: strip(s)), lambda s: s != "")

    def grounded(s, body):
        words = F.regexp_extract_all(s, F.lit(WORDS), F.lit(0))
        return (F.size(words) > 0) & (F.size(F.filter(words, lambda w: body.contains(F.lower(w)))) * 10 >= F.size(words) * 3)

    n = bind(compact(context), lambda body: F.size(F.filter(said, lambda s: grounded(s, body))))
    return F.when(F.size(said) == 0, 0.0).otherwise(n / F.size(said))


def relevancy(question, answer) -> Column:
    """The share of the question's different words that the answer holds."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower(col(question)), F.lit(WORDS), F.lit(0)))
    n = bind(F.lower(col(answer)), lambda said: F.size(F.filter(terms, lambda w: said.contains(w))))
    return F.when(F.size(terms) == 0, 0.5).otherwise(n / F.size(terms))


def completeness(answer) -> Column:
    """X9, in hundredths so that sums are exact."""
    a = col(answer)
    add = lambda test, n: F.when(test, n).otherwise(0)
    return (add(F.length(a) >= 50, 30) + add(F.length(a) >= 150, 20) + add(a.rlike("[0-9]+[.、]"), 20) + add(a.contains("<PIC>"), 15) + add(~a.contains(FALLBACK), 15)) / F.lit(100.0)


def self_evaluation(df: DataFrame, question: str = "question", answer: str = "answer", context: str = "context") -> DataFrame:
    """Adds faithfulness (null without context), relevancy, completeness and their mean."""
    f = F.when(F.coalesce(F.col(context), F.lit("")) != "", F.round(faithfulness(answer, context), 2))
    out = df.withColumns({"faithfulness": f, "relevancy": F.round(relevancy(question, answer), 2), "completeness": F.round(completeness(answer), 2)})
    n = F.when(F.col("faithfulness").isNull(), 2).otherwise(3)
    return out.withColumn("overall", F.round((F.coalesce("faithfulness", F.lit(0.0)) + F.col("relevancy") + F.col("completeness")) / n, 2))


def check_case(df: DataFrame) -> DataFrame:
    """Adds failures and ok. df: answer, sources, detail, n_images, http_status, code, confidence and the expectations
    expect_contains, expect_not_contains, expect_sources_contains, expect_error_contains (arrays), expect_http_status,
    min_image_ids, max_image_ids, min_confidence, max_confidence (null: not asked)."""
    wanted = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    each = lambda c, test, what: F.transform(F.filter(wanted(c), test), lambda x: F.concat(F.lit(f"{what}: "), x))
    when = lambda test, what: F.when(test, F.array(F.lit(what))).otherwise(F.array().cast("array<string>"))
    status = F.coalesce("http_status", F.lit(200))
    failures = F.concat(
        when(status != F.coalesce("expect_http_status", F.lit(200)), "unexpected http status"),
        each("expect_contains", lambda x: ~F.col("answer").contains(x), "missing answer term"),
        each("expect_not_contains", lambda x: F.col("answer").contains(x), "unexpected answer term"),
        each("expect_sources_contains", lambda x: ~F.array_contains("sources", x), "missing source"),
        each("expect_error_contains", lambda x: ~F.col("detail").contains(x), "missing error detail term"),
        when(F.coalesce(F.col("n_images") < F.col("min_image_ids"), F.lit(False)), "image_ids too few"),
        when(F.coalesce(F.col("n_images") > F.col("max_image_ids"), F.lit(False)), "image_ids too many"),
        when(F.col("expect_http_status").isNull() & (F.coalesce("code", F.lit(-1)) != 0), "unexpected response code"),
        when(F.coalesce(F.col("confidence") < F.col("min_confidence"), F.lit(False)), "confidence too low"),
        when(F.coalesce(F.col("confidence") > F.col("max_confidence"), F.lit(False)), "confidence too high"),
    )
    return df.withColumn("failures", failures).withColumn("ok", F.size("failures") == 0)


def summary(records: DataFrame, category: str = "category") -> DataFrame:
    """Total and passed of each category."""
    return records.groupBy(category).agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("passed"))


def issue_histogram(records: DataFrame, issues: str = "failures") -> DataFrame:
    """A10: how often each kind of issue occurs."""
    kind = F.substring_index("issue", ":", 1)
    return records.select(F.explode(issues).alias("issue")).groupBy(kind.alias("issue")).agg(F.count(F.lit(1)).alias("n"))
