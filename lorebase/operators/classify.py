"""Labels and filters of chunks as column expressions."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import lexicon
from ..functions.text import MISSING, PIC, bind, col, contains_any, squeeze, strip, sub
from . import words
from .scan import Running, numbered, scan
from .shared import written


# Fixed value: what is left of bad recognition.
NOISE = r"\\u[0-9a-fA-F]{4}|\\(?:mathsf|mathrm|pmb)|[a-z]{18,}"


def lines(c) -> Column:
    """Lines that aren't blank, trimmed."""
    return F.filter(F.transform(F.split(col(c), "\n"), lambda x: strip(x)), lambda x: x != "")


def toc_like(c) -> Column:
    """A table of contents, by dotted lines and page numbers."""
    page = r"[A-Za-z][A-Za-z /,'()-]{2,}\.?\s*[0-9]{1,3}(?=\s|$)"

    def judge(clean, rows):
        count = lambda test: F.size(F.filter(rows, test))
        dotted, paged = count(lambda x: x.rlike(r"\.{5,}|…{3,}")), count(lambda x: x.rlike(r"[0-9]{1,3}\s*$"))
        hits = F.aggregate(rows, F.lit(0), lambda n, x: n + F.regexp_count(x, F.lit(page)))
        by_lines = (dotted >= 2) | ((F.size(rows) >= 6) & (paged / F.greatest(F.size(rows), F.lit(1)) >= 0.65))
        return F.when(F.length(clean) < 80, hits >= 3).otherwise(by_lines)

    # Markers are looked for only in texts that have any.
    plain = F.when(col(c).contains("[[PIC"), sub(sub(c, PIC), MISSING)).otherwise(col(c))
    return bind(strip(plain), lambda clean: bind(lines(clean), lambda rows: judge(clean, rows)))


def low_value(c, image_ids: Column | None = None) -> Column:
    """Fragments that carry nothing."""
    t = squeeze(F.lower(strip(sub(c, "^[# ]+"))))
    short = (F.length(t) < 24) & ~t.rlike("[0-9]|[。！？!?；;]")
    words = F.size(F.filter(F.split(t, " "), lambda x: x != ""))
    poor = (t == "") | t.isin("warranty", "note", "notes", "notice") | short | ((words <= 4) & t.rlike("(warranty|notice)$"))
    return poor if image_ids is None else poor & (F.size(image_ids) == 0)


def step_count(c) -> Column:
    """Numbered lines, and numbers within lines before a capital or an ideograph (counted twice by design)."""
    marked = F.size(F.filter(F.split(col(c), "\n"), lambda x: x.rlike(r"^\s*(?:[0-9]+[).、]|[A-Z][).]|[a-z][).]|[①-⑳])\s+")))
    return marked + F.regexp_count(col(c), F.lit(r"(?:^|\s)(?:[0-9]+[).、])\s+[A-Z\u4e00-\u9fff]"))


def semantic_type(title, text, toc: Column | None = None) -> Column:
    """The first rule that holds. Title and text are prepared once, and rules are tried only as far as needed."""
    title, text = col(title), col(text)

    def judge(x):
        body, head, steps = x["body"], x["head"], x["steps"]
        procedure = (steps >= 2) | contains_any(body, lexicon.PROCEDURE)
        warned = contains_any(head, lexicon.SAFETY)
        return (
            F.when(x["toc"], "toc")
            # With two steps a text is a procedure in any case.
            .when((steps < 2) & warned, "safety_warning")
            .when(contains_any(body, lexicon.TROUBLE), "troubleshooting")
            .when(contains_any(body, lexicon.PARTS), "parts_list")
            .when(contains_any(body, lexicon.SPECIFICATION), "specification")
            .when(procedure, "procedure")
            .when(warned | contains_any(body, lexicon.SAFETY), "safety_warning")
            .otherwise("general")
        )

    whole = F.struct(squeeze(F.lower(F.concat(title, F.lit("\n"), text))).alias("body"), squeeze(F.lower(title)).alias("head"), step_count(text).alias("steps"), (toc_like(text) if toc is None else toc).alias("toc"))
    return bind(whole, judge)


def ocr_noise(c) -> Column:
    """P5, the flag: escapes and commands that were left over, or long glued words."""
    return col(c).rlike(NOISE)


def clean_score(toc: Column, noise: Column, unlabelled: Column) -> Column:
    """P5: tenths lost for each flaw, counted in whole tenths so that no rounding differs."""
    lost = F.when(toc, 4).otherwise(0) + F.when(noise, 2).otherwise(0) + F.when(unlabelled, 1).otherwise(0)
    return F.greatest(F.lit(1), 10 - lost) / F.lit(10.0)


@lru_cache(8)
def _hints(hints: tuple[str, ...]):
    own = words.Hints(hints)

    @F.arrow_udf(ArrayType(StringType()))
    def found(texts: pa.Array) -> pa.Array:
        return own.among(texts)

    return found


def found_hints(c, domains: dict[str, tuple[str, ...]]) -> Column:
    """The different hints in a text: single words as words, others as substrings. All are looked for at once, in one pass
    over the bytes of a batch; a plain search for each of them took most of the time."""
    return _hints(tuple(dict.fromkeys(h for own in domains.values() for h in own)))(squeeze(F.lower(col(c))))


def domain_scores(c, domains: dict[str, tuple[str, ...]] = lexicon.CHUNK_DOMAINS) -> Column:
    """For each domain, in the table's order, two points for a hint of several words found and one for others."""
    points = lambda found: F.aggregate(found, F.lit(0), lambda n, h: n + F.when(h.contains(" "), 2).otherwise(1))
    table = F.array(*[F.struct(F.lit(-k).alias("order"), F.lit(n).alias("domain"), F.array(*map(F.lit, h)).alias("hints")) for k, (n, h) in enumerate(domains.items())])
    score = lambda found: F.transform(table, lambda d: F.struct(points(F.array_intersect(d["hints"], found)).alias("score"), d["order"].alias("order"), d["domain"].alias("domain")))
    return bind(found_hints(c, domains), score)


def domain(c) -> Column:
    """The domain with most points, the first of the table on ties, empty without any."""
    return bind(F.array_max(domain_scores(c)), lambda best: F.when(best["score"] > 0, best["domain"]).otherwise(""))


def domain_groups(c, domains: dict[str, tuple[str, ...]] = lexicon.QUERY_DOMAINS) -> Column:
    """All domains with a hint."""
    return F.transform(F.filter(domain_scores(c, domains), lambda d: d["score"] > 0), lambda d: d["domain"])


def query_intents(c) -> Column:
    """Intents whose hint is a substring of the query (short hints match inside words, as they always have)."""
    t = F.lower(col(c))
    return F.filter(F.array(*[F.when(contains_any(t, h), F.lit(n)) for n, h in lexicon.INTENT_HINTS.items()]), lambda x: x.isNotNull())


def backfill_domain(chunks: DataFrame, manual: str, order: str, label: str = "domain_label") -> DataFrame:
    """An unlabelled chunk takes the label of a near labelled one. Only given labels count, so it isn't recursive.

    Numbers and nearest labels come from segmented scans: a manual of any size is many tasks' work.
    """
    # Written first: dealing rows out by ranges runs whatever makes them twice, once for a sample.
    rows = numbered(written(chunks, "labelled"), [manual], [order], "__n")
    given = F.when(F.col(label) != "", F.struct(F.col("__n").alias("n"), F.col(label).alias("d")))
    rows = scan(rows, [manual], ["__n"], {"__p": Running("previous", given), "__f": Running("next", given)})
    back, ahead = F.col("__n") - F.col("__p.n"), F.col("__f.n") - F.col("__n")
    found = (
        F.when((F.col("__p.d") == F.col("__f.d")) & (back <= 12) & (ahead <= 12), F.col("__p.d"))
        .when(back <= 5, F.col("__p.d"))
        .when(ahead <= 5, F.col("__f.d"))
    )
    inferred = (F.col(label) == "") & found.isNotNull()
    return rows.withColumn("domain_inferred", inferred).withColumn(label, F.when(inferred, found).otherwise(F.col(label))).drop("__n", "__p", "__f")


def ascii_heavy(c) -> Column:
    """P16."""
    letters = F.regexp_count(col(c), F.lit("[A-Za-z]"))
    return (letters >= 8) & (letters > F.regexp_count(col(c), F.lit("[\u4e00-\u9fff]")))


def toc_noise(c) -> Column:
    """A sentence out of a table of contents."""
    t = col(c)
    pages = F.regexp_count(t, F.lit(r"(?iU)\bpage\b"))
    return t.contains("...") | (pages >= 2) | ((F.regexp_count(t, F.lit(r"(?U)\b\d+\b")) >= 5) & (F.length(t) < 180))


def truncated_heading(c) -> Column:
    """A heading that stops at a small word."""
    t = strip(c)
    return (t != "") & ~t.rlike(r"[.。!?:;]$") & F.lower(F.element_at(F.split(t, " "), -1)).isin("support", "with", "to", "and", "or", "of", "for", "in", "the", "a")
