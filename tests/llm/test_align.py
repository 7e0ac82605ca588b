"""Alignment of two tokenizers: against plain Python with both libraries, and cuts against a set's intersection."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorebase.llm import align, queries

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "  ", "a ", "a  b\n\t c  ", "a\n  b", "▁x", "a▁ ▁", "<|endoftext|> <s> </s><unk>", "x　y \xa0 z", "中文字符没有空格的长句子" * 50, "\0b", "é̀ ẞ 🎉🎉👨‍👩‍👧",
    "\r\n a\r\n", "<0x41> <0x0A>", "ab" * 3000, "the end of the text is the end", "the end of the text is the end", " " * 500 + "a",
]


def plain(texts):
    """Figures of each text by lists and sets."""
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    byte = {c: b for c, b in align.byte_of_character().items()}
    spelled = {i: t for t, i in first.get_vocab().items()}

    def ends(spans):
        return np.cumsum([len(s) for s in spans]).tolist()

    seen, links, out = Counter(), [], []
    for text in texts:
        a, b, groups, own = [], [], [], []
        if text:
            whole = b" " + text.encode()
            a = first.encode(" " + text, add_special_tokens=False).ids
            b = second.encode(text)
            a_bytes = [bytes(byte[c] for c in spelled[i]) for i in a]
            b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, second.id_to_piece(i)) for i in b)]
            if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
                a = b = []
        if a:
            x, y = ends(a_bytes), ends(b_bytes)
            last = 0
            for cut in sorted(set(x) & set(y)):
                groups.append(",".join(str(i) for i, e in zip(a, x) if last < e <= cut) + "|" + ",".join(str(i) for i, e in zip(b, y) if last < e <= cut))
                last = cut
            own = [(i, j) for i, e, s in zip(a, x, [0, *x]) for j, f, t in zip(b, y, [0, *y]) if s < f and t < e]
        seen.update(own)
        links.append(own)
        out.append([len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    most = {}
    for (_, j), n in seen.items():
        most[j] = max(most.get(j, 0), n)
    return [(*x[:4], sum(seen[p] == most[p[1]] for p in own), sum(seen[p] for p in own), x[4]) for x, own in zip(out, links)], seen


def figures(df):
    return {r.doc_id: tuple(r[1:]) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}


def test_odd_texts(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)], "doc_id long, text string, codes string")
    want, seen = plain(ODD)
    assert figures(align.statistics(docs, A, B)) == dict(enumerate(want))
    assert want[0] == want[1] == want[7] == (0, 0, 0, 0, 0, 0, "") and want[17] == want[18]
    pairs = {(r.a_id, r.b_id): r.n for r in align.pair_counts(docs, A, B).collect()}
    assert pairs == dict(seen)
    for r in align.alignments(docs, A, B).collect():
        assert (len(r.a_ids), len(r.b_ids), len(r.a_ends), len(r.b_ends)) == (*want[r.doc_id][:3], want[r.doc_id][2])
        assert (not r.a_ends) or (r.a_ends[-1], r.b_ends[-1]) == (len(r.a_ids), len(r.b_ids))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want, _ = plain([r.text[:4000] for r in rows])
    cut = spark.createDataFrame([(r.doc_id, r.text[:4000]) for r in rows], "doc_id long, text string")
    assert figures(align.statistics(cut, A, B)) == {r.doc_id: w for r, w in zip(rows, want)}
    whole = figures(queries.op13_token_alignment(spark, folder))
    assert len(whole) == len(rows) and all(v[3] == v[0] + v[1] - v[2] for v in whole.values())


def test_empty_and_null(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.statistics(none, A, B).collect() == []
    rows = spark.createDataFrame([(None, "a b"), (3, None)], "doc_id long, text string")
    got = figures(align.statistics(rows, A, B))
    assert got[None][:4] == (2, 2, 2, 2) and got[3][0] == 0


def test_blocks_of_pairs(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    monkeypatch.setattr(align, "BLOCK", 50)
    assert figures(align.statistics(docs, A, B)) == dict(enumerate(plain(ODD)[0]))


sizes = st.lists(st.integers(1, 5), min_size=1, max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(sizes, sizes), min_size=1, max_size=5), st.integers(1, 4))
def test_cuts(texts, steps):
    ends_a, ends_b, at, base = [], [], [0], 0
    for x, y in texts:
        short = sum(x) - sum(y)
        x, y = (x, [*y, short]) if short > 0 else ([*x, -short], y) if short else (x, y)
        ends_a += (np.cumsum(x) + base).tolist()
        ends_b += (np.cumsum(y) + base).tolist()
        base += sum(x)
        at.append(len(ends_a))
    old, align.STEPS = align.STEPS, steps
    try:
        got = align.shared_cuts(np.array(ends_a), np.array(ends_b), np.array(at))
    finally:
        align.STEPS = old
    assert [e for e, c in zip(ends_a, got) if c] == sorted(set(ends_a) & set(ends_b))
    with pytest.raises(IndexError):
        align.shared_cuts(np.array([1]), np.array([1]), np.array([0, 2]))
