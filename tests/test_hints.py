"""Hints and labels: against column expressions, and made once."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from lorebase.functions import lexicon
from lorebase.functions import text as T
from lorebase.operators import classify, scan, words


def test_hints_of_odd_texts(spark):
    hints = [h for own in lexicon.CHUNK_DOMAINS.values() for h in own]
    rng = random.Random(7)
    said = ["".join(rng.choice([h, h.upper(), h.replace(" ", " \n "), "x", "_", "灯", "½", "é", "-", " ", "\x1c"]) for h in rng.choices(hints, k=4)) for _ in range(300)] + ["", None, "ski-ski ski_ ski"]
    rows = spark.createDataFrame(list(enumerate(said)), "k int, text string")
    low = T.squeeze(F.lower("text"))
    single = F.array(*[F.lit(h) for h in dict.fromkeys(hints) if " " not in h and "-" not in h])
    parts = F.array(*[F.lit(h) for h in dict.fromkeys(hints) if " " in h or "-" in h])
    want = F.concat(F.array_intersect(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), single), T.bind(low, lambda t: F.filter(parts, lambda h: t.contains(h))))
    got = rows.select(F.array_sort(classify.found_hints("text", lexicon.CHUNK_DOMAINS)).alias("a"), F.array_sort(want).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and sum(len(r.a or ()) for r in got) > 200


def test_labels_are_made_once(spark, monkeypatch):
    """Dealing rows out by ranges reads them twice: what it reads must be written."""
    seen, write = [], scan.written
    monkeypatch.setattr(scan, "written", lambda df, what: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, what))
    docs = spark.createDataFrame([(k, f"s{k % 2}", "the lens of the camera" if k % 9 == 0 else "a b") for k in range(60)], "doc_id int, source string, text string")
    out = classify.backfill_domain(docs.select("doc_id", "source", classify.domain("text").alias("domain_label")), "source", "doc_id")
    assert out.where("domain_inferred").count() > 0 and seen and not any("found(" in plan or "lower(" in plan for plan in seen)


def test_hints_at_ends_and_between_texts():
    own = words.Hints(("tv", "ski", "v-belt", "side brush", "noise canceling", "e-reader"))
    said = ["tv", "atv", "tv tv", "étv", "tv灯", "½tv", "tv–", "v-bel", "t side brus", "h", "inside brushes", "noise cancelin", "noise canceling", "x ski", "ski_", "e-readers", "", None, "ta tb"]
    want = [["tv"], [], ["tv"], [], [], [], ["tv"], [], [], [], ["side brush"], [], ["noise canceling"], ["ski"], [], ["e-reader"], [], None, []]
    for column in (pa.array(said), pa.array(["tv", *said]).slice(1), pa.array(said, pa.large_string())):
        assert own.among(column).to_pylist() == want
    assert own.among(pa.array([], pa.string())).to_pylist() == [] and own.among(pa.array([None, ""], pa.string())).to_pylist() == [None, []]
