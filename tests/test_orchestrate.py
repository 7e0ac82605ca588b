"""Turns to answers: every branch by hand, a client that fails for one turn, odd rows."""

import pytest
from pyspark.sql import functions as F

from lorebase.operators import index, orchestrate

FIELDS = "overview string, materials string, timeline string, fees string, eligibility string, process string, contact string"
TEXTS = [(1, "Press the brake lever with your right hand until the wheel stops. The brake lever is made of steel and of rubber.", "Brake lever", "scooter"), (2, "Charge the battery before you use the drill for the first time in a year.", "Battery", "drill")]


@pytest.fixture()
def parts(spark):
    chunks = spark.createDataFrame(TEXTS, "chunk_id long, text string, title string, product_name string")
    topics = spark.createDataFrame([(0, "returns", ["退货", "运费"], "可以退货。", "", "", "运费由卖家承担。", "", "", "")], f"pos int, topic string, terms array<string>, {FIELDS}")
    scenarios = spark.createDataFrame([], f"topic string, pos int, name string, terms array<string>, {FIELDS}")

    def search(questions, k):
        asked = questions.select("query_id", F.explode(F.array_distinct(index.terms("text"))).alias("term"))
        hits = asked.join(chunks.select("*", F.explode(F.array_distinct(index.terms("text"))).alias("term")), "term").where(F.length("term") > 3)
        rows = hits.groupBy("query_id", "chunk_id", "title", "text", "product_name").agg((4.0 * F.count(F.lit(1))).alias("score"))
        return index.top(rows, "query_id", [F.col("score").desc(), F.col("chunk_id")], k)

    return search, topics, scenarios


def run(spark, parts, said, **more):
    kind = "conv_id long, turn long, role string, text string, session_route string, n_topics int"
    rows = spark.createDataFrame([(c, t, "user", x, *rest) if rest else (c, t, "user", x, None, None) for c, t, x, *rest in said], kind)
    return {(r.conv_id, r.turn): r for r in orchestrate.answer_turns(rows, *parts, **more).collect()}


def test_every_branch(spark, parts):
    said = [(1, 0, "Hello!"), (1, 1, "我要退货，运费谁出"), (1, 2, "How to press the brake lever"), (1, 3, "换个产品"), (1, 4, "重新开始"), (1, 5, "zebra crossing"), (2, 0, None), (2, 1, "  "), (3, 0, "那多久", "customer_service", 1), (4, 0, "那多久", None, None)]
    got = run(spark, parts, said)
    assert len(got) == len(said)
    assert {k: r.branch for k, r in got.items()} == {(1, 0): "smalltalk", (1, 1): "service", (1, 2): "manual", (1, 3): "clarify", (1, 4): "clear", (1, 5): "no_evidence", (2, 0): "blank", (2, 1): "blank", (3, 0): "service", (4, 0): "no_evidence"}
    assert got[1, 0].answer == orchestrate.REPLIES["greeting"] and got[1, 0].confidence == 0.99
    assert "运费由卖家承担。" in got[1, 1].answer and got[1, 1].sources == ["customer_service_policy"]
    manual = got[1, 2]
    assert (manual.first_chunk, manual.sources, manual.error) == ("1", ["scooter"], None) and "brake lever" in manual.answer and manual.n_evidence >= 1
    assert got[1, 5].confidence == 0.15 and got[2, 0].error.startswith("400") and got[2, 0].answer == ""


def test_one_failing_turn(spark, parts):
    def client():
        def ask(prompt):
            if "battery" in prompt.rsplit("\n", 1)[-1]:
                raise TimeoutError("too late")
            return "Use the brake lever and wait until the wheel stands still."

        return ask

    got = run(spark, parts, [(1, 0, "brake lever"), (2, 0, "Charge the battery")], client=client)
    assert got[1, 0].error is None and "stands still" in got[1, 0].answer
    assert got[2, 0].error == "too late" and "battery" in got[2, 0].answer and got[2, 0].branch == "manual"


def test_empty(spark, parts):
    assert run(spark, parts, []) == {}
