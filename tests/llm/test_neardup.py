"""Near-duplicate groups against all pairs."""

import random

import pytest

from lorebase.llm import neardup


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows):
    """Each (id, text) to the smallest id that it reaches over pairs at 0.8 or more."""
    known = sorted({(i, t or "") for i, t in rows if i is not None})
    sets, up = [shingles(t) for _, t in known], list(range(len(known)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(known)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if 5 * len(x & y) >= 4 * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {known[k]: known[find(k)][0] for k in range(len(known))}


def cases():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    common = [word() for _ in range(40)]
    rows = []
    for k in range(60):
        words = [word() for _ in range(rng.randint(1, 120))]
        rows.append((k, " ".join(words + common if k % 3 == 0 else words)))
    for k in range(100, 240):
        words = rng.choice(rows[:60] if k % 4 else rows[:6])[1].split(" ")
        for _ in range(rng.randint(0, 1 + len(words) // 25)):
            words[rng.randrange(len(words))] = word()
        rows.append((k, " ".join(words)))
    text = " ".join(word() for _ in range(120))
    half = text.split(" ")
    for k in range(3, 120, 14):  # few changed words, spread: alike in words, under 0.8 in runs of five
        half[k] = word()
    rows += [(300, text), (301, " ".join(half)), (400, None), (401, ""), (402, " \t"), (None, rows[0][1]), rows[3], (403, rows[3][1].upper()), (404, "a b"), (405, "a b c"), (3, text)]
    return rows


@pytest.mark.parametrize("often", [2, 10])
def test_groups_equal_all_pairs(spark, monkeypatch, often):
    monkeypatch.setattr(neardup, "OFTEN", often)
    rows = cases()
    want = brute_groups(rows)
    v = {r.v: r.text for r in docs(spark, rows).selectExpr("coalesce(text, '') text", "xxhash64(coalesce(text, '')) v").collect()}
    got = {(r.doc_id, v[r.v]): r.component_id for r in neardup.groups(docs(spark, rows).repartition(3)).collect()}
    assert got == want
    assert sum(i != c for (i, _), c in want.items()) > 30
    assert neardup.groups(docs(spark, [])).count() == 0


def test_stage_keeps_documents_below_the_similarity(spark):
    """SimHashes of words link 300 and 301, which are under 0.8; 301 went before."""
    import corpus_pipeline
    from lorebase.llm import simhash

    rows = [r for r in cases() if r[0] in (300, 301)]
    a, b = (simhash.sketch(t, (1, 2, 3, 4)) for _, t in rows)
    assert any((x ^ y).bit_count() <= 4 for x, y in zip(a, b))
    assert corpus_pipeline.near_dedup(spark, docs(spark, rows), "").count() == 2
