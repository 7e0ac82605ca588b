"""Terms among words as array operations, and titles: against plain Python and the whole texts."""

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lorebase.functions import text as T
from lorebase.operators import words
from lorebase.operators.index import TERM

SPLIT = re.compile(TERM).findall
PIECES = ["red", "über", "straße", "灯", "电钻", "a÷b", "x1", " ", ".", "ÿ", "ö", "Ö", "龥", "鿿", "ꀀ", "㐀", "é", "🙂", "\n", "–", "½", "a" * 9, "ab" * 8, "abcdefgh" + "x" * 9 + "stuvwxyz", "abcdefgh" + "y" * 9 + "stuvwxyz"]


def texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(n)] + [None, "", "灯", "ß", "\x00a"]


@pytest.mark.parametrize("size", [1, 50, 1 << 20])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_terms_among_words(monkeypatch, size, kind):
    monkeypatch.setattr(words, "BYTES", size)
    column = pa.array(texts(400), kind).slice(3)
    terms = {t: 100 + k for k, t in enumerate(sorted({w for t in texts(400) if t for w in SPLIT(t)})[::2])}
    own = words.Terms(terms)
    got = []
    for part in words.parts(pa.RecordBatch.from_arrays([column], names=["t"]), 0):
        n, keys, times = own.found(part.column(0))
        held = [(int(x), {}) for x in n]
        for k, c in zip(keys.tolist(), times.tolist()):
            held[k // len(own.ids)][1][int(own.ids[k % len(own.ids)])] = c
        got += held
    assert got == [(len(SPLIT(t or "")), {terms[w]: n for w, n in Counter(SPLIT(t or "")).items() if w in terms}) for t in column.to_pylist()]


def test_no_terms_and_terms_of_one_hash(monkeypatch):
    n, keys, _ = words.Terms({}).found(pa.array(["red lamp", None]))
    assert n.tolist() == [2, 0] and not len(keys)
    marks = words.marks
    monkeypatch.setattr(words, "marks", lambda *given: (*marks(*given)[:2], np.zeros(len(given[1]), np.uint64)))
    own = words.Terms({"red": 1, "lamp": 2, "boat": 3})
    _, keys, times = own.found(pa.array(["red lamp lamp door"]))
    assert {int(own.ids[k]): int(t) for k, t in zip(keys, times)} == {1: 1, 2: 2}


def test_words_are_found_faster_than_one_by_one():
    column = pa.array([" ".join(random.Random(k).choices(["lamp", "boat", "green", "is", "the", "window", "of"], k=2000)) for k in range(200)])
    own = words.Terms({"lamp": 0, "window": 1})

    def plain():
        return [Counter(filter(None.__ne__, map({"lamp": 0, "window": 1}.get, SPLIT(t)))) for t in column.to_pylist()]

    def least(f):
        took = []
        for _ in range(3):
            begin = time.process_time()
            f()
            took.append(time.process_time() - begin)
        return min(took)

    assert least(lambda: own.found(column)) < least(plain)


def test_titles_from_near_or_whole_texts(spark, monkeypatch):
    rng = random.Random(1)
    pieces = ["# ", "#", "\n", " ", "word", "。", "!", "[[PIC:x]]", "[[PIC_MISSING]]", "[[", "　", "\t", "line of words ", "\n\n\n\n"]
    said = ["".join(rng.choices(pieces, k=rng.choice([3, 30, 80, 150]))) for _ in range(300)] + ["".join(rng.choices(["# ", "#", " ", "\t", "\n"], k=rng.randint(30, 400))) + "".join(rng.choices(pieces, k=60)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in said] + [(None,), ("",)], "text string")
    got = rows.select("text", T.title("text").alias("a")).collect()
    monkeypatch.setattr(T, "NEAR", 1 << 20)
    monkeypatch.setattr(T, "HEAD", 1 << 20)
    want = rows.select("text", T.title("text").alias("a")).collect()
    differ = [(g.text, g.a, w.a) for g, w in zip(got, want) if g.a != w.a]
    assert not [d for d in differ if not re.match(r"[#\s]{50}", d[0] or "")]
