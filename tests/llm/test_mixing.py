"""Mixing: targets and words against plain loops, the optimum of the dual, ties, odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from lorebase.llm import mixing, queries

KIND = "doc_id long, text string, source string, target double"


def levels(sizes):
    """Targets by the stated rule, one source at a time."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, out = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in out]
        share = (total - sum(out.values())) / sum(weight[s] for s in left) if left else 0
        over = [s for s in left if share * weight[s] > 3 * sizes[s]]
        if not over:
            return out | {s: share * weight[s] for s in left}
        out |= {s: 3.0 * sizes[s] for s in over}


def held(rows, found):
    """Checks what holds for every mix; gives words taken by source."""
    assert len(found) == len(rows)
    sizes, most = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        most[source] = max(most[source], n)
    assert Counter((r.doc_id, r.size, r.source) for r in found) == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows)
    want, taken = levels(sizes), defaultdict(int)
    for r in found:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size and r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-12, abs_tol=1e-9)
        taken[r.source] += r.taken
    return want, taken, most


def run(spark, rows):
    return mixing.mix(spark.createDataFrame([(*r, 1.0) for r in rows], KIND)).collect()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random(spark, seed):
    rng = random.Random(seed)
    names = ["hot"] * 8 + ["a", "b", "c", "", None, "é", "z"]
    rows = [(k, " ".join(["w"] * rng.choice([1, 2, 5, 30, rng.randint(1, 400)])), rng.choice(names)) for k in range(400)]
    want, taken, most = held(rows, run(spark, rows))
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(2, 0.01 * t), s


def test_rates_are_tilted(spark):
    rows = [(k, "w " * n, s) for k, (n, s) in enumerate([(n, s) for s, m in (("a", 1), ("b", 9), ("c", 3)) for n in (10, 20, 40, 80) for _ in range(m)])]
    found = run(spark, rows)
    by = defaultdict(dict)
    for r in found:
        by[r.source][r.size] = r.rate
    want, _, _ = held(rows, found)
    for s, rates in by.items():
        # One slope for each source; its equation holds within the stated share.
        slope = [math.log(q) / n for n, q in rates.items() if q < 3 - 1e-6]
        assert max(slope) - min(slope) < 1e-6 if len(slope) > 1 else True
        words = sum(r.rate * r.size for r in found if r.source == s)
        assert abs(words - want[s]) <= 1 + 1e-4 * want[s]


def test_odd(spark):
    assert run(spark, []) == []
    rows = [(1, None, None), (2, "", "a"), (None, "a b", "a"), (3, "a b", "a"), (3, "a b", "a"), (4, "x", ""), (5, " \t\n", None)]
    held(rows, run(spark, rows))
    rows = [(1, None, "a"), (2, "", None)]
    assert all((r.target, r.taken) == (0.0, 0) for r in run(spark, rows))
    # A single source keeps its size; one that is too small for its weight is taken three times.
    assert all(r.copies == 1 for r in run(spark, [(k, "a b c", "a") for k in range(20)]))
    found = run(spark, [(k, "a b c", "a") for k in range(50)] + [(99, "one two", "b")])
    assert {(r.source, r.copies) for r in found if r.source == "b"} == {("b", 3)} and sum(r.taken for r in found) in range(145, 160)


def test_hot_size_and_reruns(spark):
    rows = [(k, "a b", "hot" if k % 3 else "cold") for k in range(900)] + [(1000 + k, "x " * 7, "cold") for k in range(10)]
    a, b = run(spark, rows), run(spark, rows[::-1])
    want, taken, _ = held(rows, a)
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert all(abs(taken[s] - t) <= 2 for s, t in want.items())


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()
    want, taken, most = held([tuple(r) for r in docs], mixing.mix(spark.read.parquet(f"{folder}/documents.parquet")).collect())
    # Ten texts a source: what is near is bounded by whole texts.
    assert all(abs(taken[s] - t) <= most[s] / 2 for s, t in want.items())
    assert queries.op11_source_mixing(spark, folder).columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
