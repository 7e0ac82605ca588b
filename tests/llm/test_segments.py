"""Texts by their distinct segments against the libraries on whole texts."""

import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from lorebase.llm import idstore, segments

SPACES = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", " ", " ", " ", "　", "​"]
WORDS = ["a", "word", "ünder", "it's", "don't!", "12,5", "日本", "🙂", "<s>", "'ll", "x" * 70, "naïveté,", "�"]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(rng.choice((SPACES, WORDS, WORDS))) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("joined, most", [(1 << 18, 1_000_000), (40, 50)])
def test_joined_words_equal_library(monkeypatch, joined, most):
    monkeypatch.setattr(idstore, "JOINED", joined)
    monkeypatch.setattr(segments, "MOST_ROWS", most)
    codec = idstore.Texts(P.path("byte_bpe_50k.json"))
    for seed in range(6):
        rows = [*texts(seed, 80), None, "", "<|endoftext|> x", "no special<|endoftext|>"]
        ids, at = codec.encode(pa.array(rows))
        assert [ids[s:e].tolist() for s, e in zip(at, at[1:])] == [codec._one(t or "") for t in rows]


def test_slices_and_empty_columns():
    memo = segments.Memo(lambda new: (np.fromiter(map(len, new), np.uint32, len(new)), np.ones(len(new), np.int64)))
    column = pa.array(["skipped", "a bc", None, "", "  d", "bc a\xa0 b"]).slice(1)
    ids, at = memo.encode(column)
    assert at.tolist() == [0, 2, 2, 2, 3, 5] and ids.tolist() == [1, 3, 3, 2, 6]
    assert memo.encode(pa.array([], pa.string()))[1].tolist() == [0]
    assert memo.encode(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0, 0]


def test_words_met_once_are_remembered_whatever_mark_follows():
    codec = idstore.Texts(P.path("byte_bpe_50k.json"))
    given, encode = [], codec.memo.encode_new
    codec.memo.encode_new = lambda new: (given.append(len(new)), encode(new))[1]
    rows = [" ".join(f"{a}{b}{a}é" for a in "abcdefgh" for b in "ijklmnop")]
    for mark in ["", ",", "***", "?", "12", "'s", "×"]:
        text = rows[0].replace("é", f"é{mark}")
        ids, _ = codec.encode(pa.array([text]))
        assert ids.tolist() == codec._one(text)
    # The words; then each mark alone, but for the sign beyond ASCII, before which no word ends.
    assert given == [64, 1, 1, 1, 1, 1, 64]


def test_cuts_behind_letters_equal_library():
    codec = idstore.Texts(P.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    few = [*map(chr, range(1, 0x180)), "é", "ß", "…", "’", "１", "Ⅷ", "ª", "'s", "'ll", "'LL", "日", "🙂", *SPACES]
    for k in range(4):
        rows = ["".join(rng.choice(few) if rng.random() < 0.5 else rng.choice("aeé.'1 ") for _ in range(rng.randint(0, 40))) for _ in range(400)]
        rows += [a + b for a in few[:: k + 1] for b in ".'1_é"]
        ids, at = codec.encode(pa.array(rows))
        assert [ids[s:e].tolist() for s, e in zip(at, at[1:])] == [codec._one(t) for t in rows]


def test_forgotten_segments_come_back_right(monkeypatch):
    monkeypatch.setattr(segments, "MOST_ROWS", 10)
    calls = []

    def encode(new):
        calls.append(new.to_pylist())
        sizes = np.array([len(s) % 3 for s in calls[-1]])
        return np.repeat(np.array([sum(s) for s in calls[-1]], np.uint32), sizes), sizes

    memo = segments.ColumnMemo(encode)
    rng = random.Random(1)
    for k in range(30):
        text = " ".join(["often", *(f"w{rng.randint(0, 400)}{'x' * rng.randint(0, 60)}" for _ in range(20))])
        ids, at = memo.encode(pa.array([text, ""]))
        parts = [s if n == 0 else b" " + s for n, s in enumerate(text.encode().split(b" "))]
        assert ids.tolist() == [v for s in parts for v in [sum(s)] * (len(s) % 3)] and at.tolist() == [0, len(ids), len(ids)]
        assert len(memo.known) == len(memo.met) == memo.rows <= segments.ROOM * 10 + 21
    # What every batch holds is never forgotten; other words were, and came again.
    assert sum(b"often" in c for c in calls) == 1 and len(set(sum(calls, []))) < len(sum(calls, []))
