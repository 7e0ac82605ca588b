"""Substring search by grams against plain containment of all pairs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorebase.operators import grams, rank


def plain(rows, needles):
    return sorted((k, n, n in (a or ""), n in (b or "")) for k, a, b in rows for n in {x for x in needles if x} if n in (a or "") or n in (b or ""))


def run(spark, rows, needles, **more):
    df = spark.createDataFrame(rows, "key int, a string, b string")
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    return sorted((r.key, r.needle, r.in_a, r.in_b) for r in grams.holding(df, ["a", "b"], asked, **more).collect())


ROWS = [(1, "the brake lever", "x"), (2, None, "brake"), (3, "", None), (4, "电钻的电池怎么充电", "the"), (5, "the the the " * 50, "lever"), (6, "a🎉b🎉🎉c", "é̀"), (7, "line\nend", "tab\tx"), (8, "brake", "lever")]
NEEDLES = ["the", "brake lever", "brake", "电", "电池", "的电池怎", "🎉", "🎉🎉", "b🎉🎉c", "e\nen", "", None, "zzz", "the", "h", "kelever", "ake\x01lev"]


@pytest.mark.parametrize("most", [grams.BLOCK, 200])
def test_cases(spark, most):
    assert run(spark, ROWS, NEEDLES, most=most) == plain(ROWS, NEEDLES)
    assert run(spark, ROWS, []) == run(spark, [], NEEDLES) == []


def test_random(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    rows = [(k, word(rng.randint(0, 40)), word(rng.randint(0, 10))) for k in range(150)]
    needles = [word(rng.randint(1, 8)) for _ in range(60)]
    assert run(spark, rows, needles) == plain(rows, needles)


def test_plan_has_no_nested_loop(spark):
    df = spark.createDataFrame(ROWS, "key int, a string, b string")
    asked = spark.createDataFrame([(n,) for n in NEEDLES], "needle string")
    plan = grams.holding(df, ["a", "b"], asked)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@settings(max_examples=15, deadline=None)
@given(st.text(min_size=0, max_size=12), st.integers(1, 3))
def test_grams_overlap(spark, text, size):
    text = "".join(c for c in text if c <= "￿" and not "\ud800" <= c <= "\udfff")
    got = spark.createDataFrame([(text,)], "t string").select(grams.grams(F.col("t"), size)).first()[0]
    assert got == [text[k : k + size] for k in range(len(text) - size + 1)]


def asked(spark, queries):
    return spark.createDataFrame(queries, "query_id int, phrases array<string>, keywords array<string>, products array<string>")


def test_candidates_are_cut_where_they_are(spark):
    """The best rows of a term are found for any products, without a row for each gram and with tasks' own limits."""
    rng = random.Random(7)
    rows = [(k, rng.choice(["lever", "other"]), "lever " * rng.randint(0, 3) + "x" * rng.randint(0, 5), rng.choice(["p lever", "q", None])) for k in range(600)]
    chunks = spark.createDataFrame(rows, "chunk_id int, title string, text string, product_name string").repartition(3)
    queries = asked(spark, [(1, [], ["LEVER"], []), (2, [], ["LEVER"], ["q"]), (3, [], ["none"], [])])
    df = rank.like_candidates(queries, chunks, 1)
    plan = df._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Generate explode(__grams" not in plan
    want = set()
    for query, products in ((1, None), (2, {"q"})):
        own = [(-(3 * ("lever" in t) + 2 * ("lever" in (p or "")) + ("lever" in x)), len(t), len(x), k) for k, t, x, p in rows if products is None or p in products]
        want |= {(query, r[3], -r[0]) for r in sorted(r for r in own if r[0])[:80]}
    got = df.where("term = 'LEVER'").collect()
    assert {(r.query_id, r.chunk_id, r.like_score) for r in got} == want and len(got) == len(want) == 160


def test_fallback_of_few_rows(spark):
    """A query with fewer chunks than it asks for gets the shortest rows that hold a first term."""
    rows = [(k, "t", "lever" + "x" * (400 - k), "q") for k in range(400)]
    chunks = spark.createDataFrame(rows, "chunk_id int, title string, text string, product_name string").repartition(3)
    df = rank.fetched(asked(spark, [(1, [], ["LEVER"], [])]), chunks, 1)
    assert "WindowGroupLimit" in df._jdf.queryExecution().toString()
    got = {(r.chunk_id, r.is_fallback) for r in df.collect()}
    assert got == {(k, k < 320) for k in range(220, 400)}
