"""Text normalisation as column expressions: all of it stays in the JVM and inside code generation, but for glued words.

`(?U)` makes Java's \\s, \\w and \\b those of Unicode. Lengths and cuts count code points.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicon

# Markers, default title and patterns.
PIC, MISSING = r"\[\[PIC:([^\]]+)\]\]", r"\[\[PIC_MISSING\]\]"
NO_TITLE = "未命名章节"
SENTENCE_MARKS = "。！？!?；;"
#: Code points that a title is looked for in first, and after these.
NEAR, HEAD = 300, 1000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value, f) -> Column:
    """f of a value that is worked out once. Inside a lambda an expression is worked out anew for each element."""
    return F.get(F.transform(F.array(col(value)), f), F.lit(0))


def sub(c, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(col(c), F.lit(pattern), F.lit(to))


def strip(c) -> Column:
    """Without white space at either end."""
    return sub(c, r"(?U)^\s+|\s+$")


def squeeze(c) -> Column:
    return sub(c, r"(?U)\s+", " ")


def compact(c) -> Column:
    """Lower case, no white space."""
    return sub(F.lower(col(c)), r"(?U)\s+")


def query_text(c) -> Column:
    """Punctuation becomes space."""
    return squeeze(sub(strip(c), r"[，,。；;：:！!？?()\[\]\"“”‘’]", " "))


def search_term(c) -> Column:
    """A term that a full-text query may hold; too short ones become empty."""
    t = squeeze(strip(sub(c, r"[\"'():*]+", " ")))
    return F.when(F.length(t) >= 2, t).otherwise("")


def without_markers(c) -> Column:
    """Picture markers go, blanks and empty lines are squeezed."""
    t = sub(sub(sub(sub(c, PIC), MISSING), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(t)


def title(c) -> Column:
    """The first sentence of the first line, without heading marks, at most 80 code points.

    It's taken from the first NEAR code points alone, else from the first HEAD, where these surely hold it: 200 code points with
    content of which at most 50 are marks in front, or the whole text, and no marker that goes on behind them.
    """
    open_ = lambda head, n: F.right(head, F.lit(n)).rlike(r"\[\[?$|\[\[PIC[^\]]*\]?$")
    sure = lambda head: (F.length(without_markers(head)) >= 200) & ~open_(head, HEAD)
    far = lambda t: bind(F.left(t, F.lit(HEAD)), lambda head: F.when((F.length(t) <= HEAD) | sure(head), _title(without_markers(head))).otherwise(_title(without_markers(t))))
    near = lambda head, clean: (F.length(clean) >= 200) & ~clean.rlike(r"^(?U:[#\s]{50})") & ~open_(head, NEAR)
    own = lambda t, head: bind(without_markers(head), lambda clean: F.when(near(head, clean), _title(clean)).otherwise(far(t)))
    return bind(col(c), lambda t: bind(F.left(t, F.lit(NEAR)), lambda head: own(t, head)))


def _title(clean: Column) -> Column:
    line = strip(F.element_at(F.split(F.ltrim(strip(F.regexp_replace(clean, F.lit("^[# ]+"), F.lit("")))), "\n"), 1))
    return bind(line, lambda own: bind(strip(F.element_at(F.split(own, f"[{SENTENCE_MARKS}]"), 1)), lambda first: F.left(F.coalesce(F.nullif(first, F.lit("")), F.nullif(own, F.lit("")), F.lit(NO_TITLE)), F.lit(80))))


def evidence(c) -> Column:
    """Markers, heading marks and escapes go; ends are trimmed of separators."""
    t = sub(col(c), r"\[\[PIC[^\]]*\]\]", " ")
    return F.btrim(squeeze(sub(F.replace(t, F.lit("#"), F.lit(" ")), r"\\u[0-9a-fA-F]{4}", " ")), F.lit(" -|"))


def tidy_sentence(c) -> Column:
    """T10, for answers: spacing around punctuation too."""
    t = sub(sub(evidence(c), r"(?U)\s+([,.;:!?])", "$1"), r"([,.;:!?])(?=[A-Za-z])", "$1 ")
    return F.btrim(sub(t, r"(?U)\s{2,}", " "), F.lit(" -|"))


def sentence_key(c, most: int | None = 240) -> Column:
    """What makes two sentences the same: letters, digits and ideographs alone."""
    key = sub(F.lower(col(c)), r"[^a-zA-Z0-9\u4e00-\u9fff]+")
    return key if most is None else F.left(key, F.lit(most))


def without_thinking(c, preamble: bool = False) -> Column:
    """What a model thought aloud goes. preamble: a beginning that says it is thinking too, up to the first blank line."""
    t = strip(sub(c, r"(?s)<think>.*?</think>"))
    if not preamble:
        return t
    rest = strip(F.regexp_extract(t, r"(?s)^(?i:thinking).*?\n\s*\n(.*)$", 1))
    return F.when((F.length(t) > 100) & t.rlike("^(?i)thinking") & (rest != ""), rest).otherwise(t)


def without_markdown(c) -> Column:
    """T14."""
    return strip(sub(F.replace(F.replace(col(c), F.lit("**"), F.lit("")), F.lit("`"), F.lit("")), r"[ \t]+", " "))


def caption(c) -> Column:
    """One line, list numbers as separators, at most 200 code points."""
    return F.left(strip(squeeze(sub(c, r"(?m)\s*^\s*\d+[.、)]\s*", "；"))), F.lit(200))


def smalltalk_key(c) -> Column:
    """Lower case, word characters alone."""
    return sub(F.lower(col(c)), r"(?U)[\W_]+")


def unescape(c) -> Column:
    """Each backslash-u with four hex digits becomes its character."""
    parts = F.split(col(c), r"(?=\\u[0-9a-fA-F]{4})")
    one = lambda p: F.when(
        p.rlike(r"^\\u[0-9a-fA-F]{4}"), F.concat(F.decode(F.unhex(F.substring(p, 3, 4)), "UTF-16BE"), F.substring(p, 7, 1 << 30))
    ).otherwise(p)
    return F.array_join(F.transform(parts, one), "")


def common_escapes(c) -> Column:
    """Escapes of white space, quotes and slashes, in this order."""
    pairs = (("\\r\\n", "\n"), ("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\/", "/"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, col(c))


def without_latex(c) -> Column:
    """Commands, spacing marks, braces and scripts go; no space (nor line end) stays before punctuation."""
    t = sub(sub(c, r"\\[A-Za-z]+\*?", " "), r"\\[,;:!~% ]+", " ")
    t = sub(sub(t, r"[{}$]+", " "), r"(?U)[_^]\s*[A-Za-z0-9+\-*/=().]+", " ")
    return sub(t, r"(?U)\s+([,.;:!?])", "$1")


@F.pandas_udf(StringType())
def _unglued(texts: pd.Series) -> pd.Series:
    def fold(t: str) -> str:
        for glued, apart in lexicon.OCR_PAIRS:
            if glued in t:
                t = t.replace(glued, apart)
        return t

    return texts.map(fold, na_action="ignore")


def unglue(c) -> Column:
    """T4, first part: glued words, as an ordered fold over the table. In Python, whose search for a rare string is many
    times that of a column expression in a lambda."""
    return _unglued(col(c))


def respace(c) -> Column:
    """T4, second part: spaces after punctuation and between letters and digits.

    One pass for all places: each is between two characters of classes of its own, so that none makes or takes another.
    """
    given = col(c)
    t = F.when(given.contains("lf"), sub(given, r"(?U)\blf\b", "If")).otherwise(given)
    return sub(t, r"[,.;:!?](?=[A-Za-z])|[a-z](?=[0-9]|[A-Z][a-z])|[0-9](?=[A-Za-z])", "$0 ")


def ocr_repair(c) -> Column:
    return respace(unglue(c))


def manual_text(c) -> Column:
    """The whole normalisation of a manual's text."""
    t = unescape(common_escapes(c))
    t = sub(sub(F.translate(t, "\ufeff", ""), "\r\n?", "\n"), "[\u00a0\u3000]", " ")
    t = sub(ocr_repair(without_latex(t)), r"[ \t]+", " ")
    t = sub(sub(t, r"(?iU)\s*<PIC>\s*", "\n<PIC>\n"), r"(?U)(?<!\n)#\s+", "\n# ")
    return strip(sub(t, r"\n{3,}", "\n\n"))


def chunk_id(manual, index, text) -> Column:
    """T21."""
    key = F.concat_ws(":", col(manual).cast("string"), col(index).cast("string"), F.left(col(text), F.lit(120)))
    return F.concat(F.lit("chunk_"), F.left(F.sha1(key.cast("binary")), F.lit(12)))


def string_list(c) -> Column:
    """A JSON list of strings; anything else is empty."""
    return F.coalesce(F.from_json(col(c), "array<string>"), F.array().cast("array<string>"))


def picture_suffix(text, ids) -> Column:
    """The text in quotes with a placeholder for each picture, and the list of ids."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(col(ids), lambda i: F.concat(F.lit('"'), i, F.lit('"'))), ", "), F.lit("]"))
    return F.when(F.size(col(ids)) > 0, F.concat(F.lit('"'), col(text), F.repeat(F.lit("<PIC>"), F.size(col(ids))), F.lit('";'), listed)).otherwise(col(text))


def file_summary(kind, size, width, height) -> Column:
    """A line about an uploaded picture; halves go to the even digit."""
    sides = F.when(col(width).isNull() | col(height).isNull(), F.lit("未知尺寸")).otherwise(F.format_string("%dx%d", col(width), col(height)))
    return F.concat(col(kind), F.lit("，"), sides, F.lit("，"), F.format_string("%.1fKB", F.bround(col(size) / F.lit(1024.0), 1)))


def distinct_terms(c) -> Column:
    """Terms in their order, each once, without empty ones."""
    return F.array_distinct(F.filter(col(c), lambda x: x.isNotNull() & (x != "")))


def contains_any(text: Column, terms) -> Column:
    """Whether one of some fixed terms is in the text. Terms that hold another one are left out; plain searches beat one pattern."""
    needed = [t for t in dict.fromkeys(terms) if not any(o != t and o in t for o in terms)]
    return reduce(lambda a, b: a | b, [text.contains(t) for t in needed], F.lit(False))


def overlap(text: Column, terms: Column) -> Column:
    """How many of the terms of two or more characters are in the text, without regard to case and white space."""
    return bind(compact(text), lambda t: overlap_in(t, terms))


def term_keys(terms: Column) -> Column:
    """Terms of two or more characters, as they are looked for in a compact text."""
    return F.transform(F.filter(terms, lambda x: F.length(F.trim(x)) >= 2), lambda x: compact(x))


def overlap_keys(text: Column, keys: Column) -> Column:
    """X6 for terms that are ready, where many texts are held against the same ones."""
    return bind(compact(text), lambda t: F.size(F.filter(keys, lambda x: t.contains(x))))


def overlap_in(compacted: Column, terms: Column) -> Column:
    """X6 for a text that is compact already; nothing is done for no terms. The text is bound: the optimizer puts what makes
    it into the lambda otherwise, where it's made for each term."""
    return F.when(F.size(terms) == 0, 0).otherwise(bind(compacted, lambda t: F.size(F.filter(terms, lambda x: (F.length(F.trim(x)) >= 2) & t.contains(compact(x))))))
