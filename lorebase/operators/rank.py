"""Candidates and their scores: the ranking of chunks for queries.

queries: query_id, text and what generate.analyze adds. chunks: chunk_id, title, text, product_name, image_ids and
metadata. Everything is a projection over pairs that an index or a substring search proposed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import compact, distinct_terms
from . import classify, generate, grams
from .index import rank_bonus, top
from .ingest import OMNIBUS
from .shared import written

# Terms of a query, and rows for each term and in all.
LIKE_TERMS, TERM_LEAST, TERM_MOST, LEAST_FETCH = 14, 16, 80, 180
FALLBACK_TERMS, LEAST_MERGED = 10, 40


def fetch_size(k: int) -> int:
    return max(20 * k, LEAST_FETCH)


def like_candidates(queries: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """query_id, term, chunk_id, like_score, n: rows that hold a term, the best few of each term.

    Rows that hold a term are found by its grams; the queries' terms meet only these.
    """
    # Written, as the query set is small and read more than once.
    terms = written(like_terms(queries, k), "terms")
    found = firsts(held(chunks, terms), [], "like_score", TERM_MOST)
    pairs = found.join(terms, "needle").where((F.size("products") == 0) | F.array_contains("products", F.col("product_name")))
    w = Window.partitionBy("query_id", "term").orderBy(F.desc("like_score"), "nt", "nx", "chunk_id")
    return pairs.withColumn("n", F.row_number().over(w)).where("n <= most").select("query_id", "term", "chunk_id", "like_score", "n")


def held(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """chunk_id, product_name, nt, nx, needle, like_score: the rows that hold a needle."""
    low = chunks.select("chunk_id", "product_name", F.lower("title").alias("lt"), F.lower("text").alias("lx"), F.lower("product_name").alias("lp"), F.length("title").alias("nt"), F.length("text").alias("nx"))
    return grams.holding(low, ["lt", "lx", "lp"], terms).select("chunk_id", "product_name", "nt", "nx", "needle", points().alias("like_score"))


def firsts(found: DataFrame, by: list[str], score: str, most: int) -> DataFrame:
    """The first rows of each needle and product: no query needs more of them, whatever products it names. The plan leaves
    out the others before it shuffles."""
    w = Window.partitionBy("needle", "product_name", *by).orderBy(F.desc(score), "nt", "nx", "chunk_id")
    return found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def like_terms(queries: DataFrame, k: int, most: int = LIKE_TERMS) -> DataFrame:
    """query_id, products, term, place, needle, most: the first terms of each query, and how many rows each may bring."""
    ordered = generate.prioritized(F.col("phrases"), F.col("keywords"), F.col("products"))
    terms = queries.select("query_id", "products", F.slice(ordered, 1, most).alias("t"))
    terms = terms.withColumn("most", F.least(F.greatest(F.floor(F.lit(fetch_size(k)) / F.least(F.greatest(F.size("t"), F.lit(1)), F.lit(6))), F.lit(TERM_LEAST)), F.lit(TERM_MOST)))
    return terms.select("query_id", "products", "most", F.posexplode("t").alias("place", "term")).withColumn("needle", F.lower("term"))


def points() -> Column:
    """What a term counts by the fields that hold it."""
    return 3 * F.col("in_lt").cast("int") + 2 * F.col("in_lp").cast("int") + F.col("in_lx").cast("int")


def fetched(queries: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """L2, L4: query_id, chunk_id, like_score, is_fallback: each term's best rows; a query that these give too few chunks
    gets the shortest rows that hold any of its first terms besides.

    Both lists of a query are cut in one window, before rows are shuffled: the second by as many rows as hold enough
    chunks, as a chunk comes once for each of these terms at most. Queries are told apart by a count over what is left.
    """
    fetch = fetch_size(k)
    # Written, as the query set is small and read more than once.
    terms = written(like_terms(queries, k), "terms")
    # Every row stands in its needle's list, and in the list of the shortest rows too.
    both = F.array(F.struct(F.lit(False).alias("short"), F.col("like_score").alias("points")), F.struct(F.lit(True).alias("short"), F.lit(0).alias("points")))
    found = held(chunks, terms).select("*", F.explode(both).alias("l")).select("chunk_id", "product_name", "nt", "nx", "needle", "like_score", "l.*")
    pairs = firsts(found, ["short"], "points", max(TERM_MOST, fetch)).join(terms, "needle").where((F.size("products") == 0) | F.array_contains("products", F.col("product_name")))
    # Only the first terms bring rows to the query's second list.
    lists = pairs.where(~F.col("short") | (F.col("place") < FALLBACK_TERMS)).withColumns({"list": F.when(F.col("short"), -1).otherwise(F.col("place")), "most": F.when(F.col("short"), fetch * FALLBACK_TERMS).otherwise(F.col("most"))})
    w = Window.partitionBy("query_id", "list").orderBy(F.desc("points"), "nt", "nx", "chunk_id")
    cut = lists.withColumn("n", F.row_number().over(w)).where((F.col("n") <= fetch * FALLBACK_TERMS) & (F.col("n") <= F.col("most")))
    named = cut.groupBy("query_id", "chunk_id").agg(F.max(F.when(F.col("list") >= 0, F.col("like_score"))).alias("like_score"), F.max(F.when(F.col("list") < 0, F.lit(1))).alias("any"), F.min("nt").alias("nt"), F.min("nx").alias("nx"))
    own = Window.partitionBy("query_id")
    counted = named.withColumn("n_like", F.count("like_score").over(own)).withColumn("n", F.row_number().over(own.orderBy(F.col("any").isNull(), "nt", "nx", "chunk_id")))
    falls = (F.col("n_like") < max(fetch, LEAST_MERGED)) & F.col("any").isNotNull() & (F.col("n") <= fetch)
    return counted.where(F.col("like_score").isNotNull() | falls).select("query_id", "chunk_id", "like_score", F.col("like_score").isNull().alias("is_fallback"))


def merge(like: DataFrame, fts: DataFrame) -> DataFrame:
    """Each pair once, with the full-text rank where there is one."""
    a = like.groupBy("query_id", "chunk_id").agg(F.max("like_score").alias("like_score"))
    b = fts.select("query_id", "chunk_id", "fts_rank").withColumn("fts_hit", F.lit(1))
    return a.join(b, ["query_id", "chunk_id"], "full_outer").withColumn("fts_hit", F.coalesce("fts_hit", F.lit(0)))


def semantic_alignment(kind: Column, intents: Column, warning_only: Column) -> Column:
    """How a chunk's type fits what a query is after."""
    has = lambda i: F.array_contains(intents, i)
    add = lambda i, points: F.when(has(i), F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in points.items()], F.lit(0.0))).otherwise(0.0)
    total = (
        add("procedure", {"procedure": 5.5, "safety_warning": -3.5})
        + add("safety_warning", {"safety_warning": 5.0, "procedure": 0.8})
        + add("troubleshooting", {"troubleshooting": 6.0, "procedure": 1.2, "safety_warning": -2.0})
        + add("parts_list", {"parts_list": 5.0, "specification": 1.5})
        + add("specification", {"specification": 5.0, "parts_list": 1.0})
        - F.when(warning_only & ~has("safety_warning"), 1.5).otherwise(0.0)
    )
    none = F.when(warning_only, -1.5).otherwise(0.0)
    return F.when(kind == "general", 0.0).when(F.size(intents) == 0, none).otherwise(total)


def english_alignment(title: Column, text: Column, words: Column, phrases: Column, row_groups: Column, query_groups: Column) -> Column:
    """For the English manual, how far words and phrases reach, and whether the domains agree."""
    latin = F.filter(words, lambda w: w.rlike("^[A-Za-z]") & (F.length(w) >= 3))
    count = lambda arr, where: F.size(F.filter(arr, lambda w: where.contains(compact(w))))
    k, kt = count(latin, F.concat(title, text)), count(latin, title)
    p, pt = count(phrases, F.concat(title, text)), count(phrases, title)
    long = F.exists(latin, lambda w: (F.length(w) >= 6) & F.concat(title, text).contains(compact(w)))
    base = F.least(1.6 * k, F.lit(9.0)) + F.least(1.8 * kt, F.lit(6.0)) + F.least(4.0 * p, F.lit(12.0)) + F.least(3.0 * pt, F.lit(9.0))
    reach = F.when((k <= 1) & (p == 0), F.when(long, 4.0).otherwise(-12.0)).when((k >= 3) | (p >= 1), 4.0).otherwise(0.0)
    shared = F.size(F.array_intersect(query_groups, row_groups))
    domains = F.when(F.size(query_groups) == 0, 0.0).when(shared > 0, 10.0 * shared).when(F.size(row_groups) > 0, -14.0).otherwise(-5.0)
    return base + reach + domains


def with_norms(chunks: DataFrame, text: str = "chunk_text", strict: bool = False) -> DataFrame:
    """What score() needs of a chunk, worked out once for each chunk: compact texts and domain groups.

    strict: domain groups are found in the text without white space, where hints of several words can't be.
    """
    groups = classify.domain_groups(compact(F.concat("title", F.col(text))) if strict else F.concat_ws("\n", "title", text))
    english = F.when(F.col("product_name") == OMNIBUS, groups).otherwise(F.array().cast("array<string>"))
    return chunks.withColumns({"title_norm": compact("title"), "text_norm": compact(text), "product_norm": compact("product_name"), "row_groups": english})


def with_intents(queries: DataFrame) -> DataFrame:
    """What score() needs of a query beyond its analysis."""
    terms = F.concat_ws(" ", F.array_join("keywords", " "), F.array_join("phrases", " "))
    return queries.withColumns({"intents": classify.query_intents(F.concat_ws(" ", F.col("query_text"), terms)), "query_groups": classify.domain_groups(terms)})


def score(pairs: DataFrame) -> DataFrame:
    """Adds score, title_hits, text_hits, product_match to pairs of a query (with_intents) and a chunk (with_norms)."""
    out, t, x, p = pairs, F.col("title_norm"), F.col("text_norm"), F.col("product_norm")
    phrases_known = F.array(*map(F.lit, lexicon.DOMAIN_PHRASES))
    in_scope = F.array_contains("products", F.col("product_name"))
    scope = F.when(F.size("products") > 0, F.when(in_scope, 20.0).otherwise(-12.0)).when(F.col("product_name") == OMNIBUS, -8.0).otherwise(0.0)

    def word(w):
        n = compact(w)
        extra = F.array_contains("expanded", w)
        pick = lambda a, b: F.when(extra, F.lit(a)).otherwise(F.lit(b))
        known = F.array_contains(phrases_known, w)
        head = pick(2.0, 3.5) + F.when(t.startswith(n), pick(0.5, 2.0) + F.when(known, pick(3.0, 8.0)).otherwise(0.0)).otherwise(0.0) + F.when(known, pick(2.0, 4.0)).otherwise(0.0)
        body = pick(0.8, 1.2) + F.when(known, pick(0.8, 1.5)).otherwise(0.0)
        at_title, at_text = t.contains(n), x.contains(n)
        return F.struct(
            w.alias("term"),
            (F.when(p.contains(n), pick(0.6, 1.0)).otherwise(0.0) + F.when(at_title, head).when(at_text, body).otherwise(0.0)).alias("points"),
            at_title.cast("int").alias("title"), (~at_title & at_text).cast("int").alias("text"), p.contains(n).cast("int").alias("product"),
        )

    def model(m):
        n = compact(m)
        at_title, at_text = t.contains(n), x.contains(n)
        return F.struct(m.alias("term"), F.when(at_title, 12.0).when(at_text, 7.0).otherwise(0.0).alias("points"), at_title.cast("int").alias("title"), (~at_title & at_text).cast("int").alias("text"), F.lit(0).alias("product"))

    def phrase(w):
        n = compact(w)
        at_title, at_text = t.contains(n), x.contains(n)
        return F.struct(w.alias("term"), F.when(at_title, 10.0 + F.when(w.contains(" "), 2.0).otherwise(0.0)).when(at_text, 2.0).otherwise(0.0).alias("points"), F.lit(0).alias("title"), F.lit(0).alias("text"), F.lit(0).alias("product"))

    words = F.filter("keywords", lambda w: ~F.array_contains("products", w) & (compact(w) != ""))
    hits = F.concat(F.transform("models", model), F.transform(words, word), F.transform(F.filter("phrases", lambda w: F.length(compact(w)) >= 4), phrase))
    out = out.withColumn("__h", F.filter(hits, lambda h: h["points"] > 0))
    total = lambda f: F.aggregate("__h", F.lit(0), lambda a, h: a + h[f])
    points = F.aggregate("__h", F.lit(0.0), lambda a, h: a + h["points"])
    has_scope = (F.size("products") > 0) & in_scope
    matched = F.array_distinct(F.concat(F.transform("__h", lambda h: h["term"]), F.when(has_scope, F.array("product_name")).otherwise(F.array().cast("array<string>"))))
    asked = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda w: F.array_contains("keywords", w) | F.array_contains("expanded", w))
    rules = F.lit(0.0)
    for query_terms, title_terms, boost in lexicon.TITLE_BOOSTS:
        rules = rules + F.when(asked(query_terms) & F.exists(F.array(*map(F.lit, title_terms)), lambda w: t.contains(compact(w))), boost).otherwise(0.0)
    shown = F.when((F.size("image_ids") > 0) & F.exists(F.array(*map(F.lit, ("指示灯", "表带", "尺寸", "安装", "更换"))), lambda w: F.array_contains("keywords", w)), 1.2).otherwise(0.0)
    meta = (F.col("clean_score") - 0.5) * 2 - F.when(F.col("is_toc"), 8.0).otherwise(0.0) - F.when(F.col("has_ocr_noise"), 1.5).otherwise(0.0)
    fit = semantic_alignment(F.col("semantic_type"), F.col("intents"), F.col("is_warning_only"))
    fts = F.when(F.col("fts_hit") == 1, 5.0 + rank_bonus(F.col("fts_rank"))).otherwise(0.0)
    query_groups, row_groups = F.col("query_groups"), F.col("row_groups")
    label = F.when((F.col("domain_label") != "") & (F.size(query_groups) > 0), F.when(F.array_contains(query_groups, F.col("domain_label")), 12.0).otherwise(-10.0)).otherwise(0.0)
    english = F.when(F.col("product_name") == OMNIBUS, english_alignment(t, x, F.col("keywords"), F.col("phrases"), row_groups, query_groups) + label).otherwise(0.0)
    out = out.withColumns({"title_hits": total("title"), "text_hits": total("text"), "product_match": F.greatest(has_scope.cast("int"), F.aggregate("__h", F.lit(0), lambda a, h: F.greatest(a, h["product"]))), "__m": matched})
    hits_bonus = F.when(F.col("title_hits") >= 2, 3.0).otherwise(0.0) + F.when(F.col("title_hits") + F.col("text_hits") >= 4, 2.0).otherwise(0.0)
    exact = F.concat(F.col("models"), F.slice("phrases", 1, 4), F.array_except(F.array_except("keywords", "products"), "expanded"))
    only_extra = (F.size(exact) > 0) & F.arrays_overlap("expanded", "__m") & ~F.arrays_overlap(exact, F.col("__m"))
    signal = distinct_terms(F.concat(F.col("products"), F.col("models"), F.col("expanded"), F.slice("phrases", 1, 4)))
    coverage = F.when(F.size(signal) > 0, F.least(F.size("__m") / F.greatest(F.lit(1), F.least(F.size(signal), F.lit(6))) * 4.0, F.lit(4.0))).otherwise(0.0)
    whole = scope + points + rules + shown + meta + fit + fts + english + hits_bonus - F.when(only_extra, 4.0).otherwise(0.0) + coverage
    return out.withColumn("score", F.round(whole, 3)).drop("__h", "__m")


def final(scored: DataFrame, k: int = 10) -> DataFrame:
    """The k best of each query with a positive score."""
    order = [F.col("score").desc(), F.col("product_match").desc(), F.col("title_hits").desc(), F.size("image_ids").desc(), F.col("chunk_id")]
    return top(scored.where("score > 0"), "query_id", order, k)
