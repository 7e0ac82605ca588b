"""op7 and op9 against brute force and held-out labels."""

import random
import zlib

import numpy as np
import pytest
import xxhash

from lorebase.llm import quality, simhash


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, bits string, score int")


def plain_print(text):
    import re

    words = re.findall("[^\\x20\\x09-\\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    runs = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(prints):
    ids = [i for i in prints if i is not None]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice(["alpha", "Beta", "GAMMA", "délta", "Éx", "eps x"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(5, 300))) for _ in range(60)]
    rows = [(k, t, "x", 1) for k, t in enumerate(base)]
    for k in range(100, 180):
        words = rng.choice(base).split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((k, " ".join(words), "x", 1))
    rows += [(500, None, "x", 1), (501, "", None, None), (502, "one two", "x", 1), (503, "ONE\t two\n", "x", 1), (504, base[0].upper().lower(), "x", 1), (None, base[0], "x", 1)]
    got = simhash.near_duplicates(docs(spark, rows).repartition(3)).collect()
    prints = {i: plain_print(t or "") for i, t, *_ in rows}
    assert {r.doc_id: r.bits & (1 << 64) - 1 for r in got} == prints
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == plain_groups(prints)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("tree, shard", [(48, 20_000), (2, 20_000), (2, 10)])
def test_shard_links_join_all(monkeypatch, tree, shard):
    monkeypatch.setattr(simhash, "TREE", tree)
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng = random.Random(tree + shard)
    bits = sorted({(rng.choice([0, 1 << 63, 0xFF00FF]) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5)))) & (1 << 64) - 1 for _ in range(40)})
    sets = simhash.Sets(len(bits))
    pairs = simhash.shard_links(np.array(bits, np.uint64), 4)
    assert all((bits[a] ^ bits[b]).bit_count() <= 4 for a, b in pairs) and len(pairs) < len(bits)
    for a, b in pairs:
        sets.join(a, b)
    whole = plain_groups(dict(enumerate(bits)))
    assert [sets.find(k) for k in range(len(bits))] == [whole[k] for k in range(len(bits))]


@pytest.mark.parametrize("n, kind", [(400, "random"), (400, "copies"), (3000, "near"), (100, "chain")])
def test_wide_tree_joins_what_all_pairs_join(n, kind):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, 20).astype(np.uint64)
    if kind == "chain":
        bits = np.array([(1 << 60) - 1 >> k << k for k in range(0, 60)], np.uint64)
    else:
        flips = {"random": 30, "copies": 2, "near": 7}[kind]
        bits = base[rng.integers(0, 20 if kind != "copies" else 1, n)]
        for _ in range(flips):
            bits = bits ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    bits = np.unique(bits)
    pairs = simhash.WideTree(bits, 4).links()
    assert len(pairs) < len(bits) and all((int(bits[a]) ^ int(bits[b])).bit_count() <= 4 for a, b in pairs)
    got, want = simhash.Sets(len(bits)), simhash.Sets(len(bits))
    for a, b in pairs:
        assert got.join(a, b)
    near = np.argwhere(np.triu(np.bitwise_count(bits[:, None] ^ bits[None]) <= 4, 1))
    for a, b in near.tolist():
        want.join(a, b)
    assert [got.find(k) for k in range(len(bits))] == [want.find(k) for k in range(len(bits))]


@pytest.mark.parametrize("levels", [1, 3])
def test_hot_shards_are_dealt_out_again(spark, monkeypatch, levels):
    """Fingerprints that share 21 bits: every place is small enough after dealing, and no link is lost."""
    monkeypatch.setattr(simhash, "SHARD", 60)
    monkeypatch.setattr(simhash, "LEVELS", levels)
    rng = random.Random(levels)
    high = ((1 << 21) - 1) << 43
    bits = set()
    for _ in range(700):
        b = high | rng.getrandbits(43)
        bits |= {b, b ^ sum(1 << k for k in rng.sample(range(43), rng.randint(1, 4)))}
    frame = spark.createDataFrame([(simhash.signed(b),) for b in bits], "bits long")
    sizes = simhash.shards(frame, 4).groupBy("place").count().agg({"count": "max"}).first()[0]
    assert sizes <= (60 if levels == 3 else 400) < len(bits)
    got = {r.node: r.root for r in simhash.components(simhash.links(frame), spark).collect()}
    own = np.array(sorted(bits), np.uint64).view(np.int64)
    own.sort()
    sets = simhash.Sets(len(own))
    for a, b in np.argwhere(np.triu(np.bitwise_count(own.view(np.uint64)[:, None] ^ own.view(np.uint64)[None]) <= 4, 1)).tolist():
        sets.join(a, b)
    want = {int(own[k]): int(own[sets.find(k)]) for k in range(len(own)) if sets.find(k) != k}
    assert got == want and len(want) >= 600


def test_all_links_meet(spark):
    rng = random.Random(9)
    bits = set()
    for _ in range(150):
        b = rng.getrandbits(64)
        c = b
        for k in rng.sample(range(64), 4):
            c ^= 1 << k
        bits |= {b, c}
    signed = [(b - (1 << 64) if b >> 63 else b,) for b in bits]
    edges = simhash.links(spark.createDataFrame(signed, "bits long"))
    assert edges.count() >= 150
    roots = simhash.components(edges, spark)
    assert roots.count() == 150


def test_long_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(70)] + [(100, 103), (101, 103)], "low long, high long")
    got = {r.node: r.root for r in simhash.components(edges, spark).collect()}
    assert got == {**{k: 0 for k in range(1, 71)}, 101: 100, 103: 100}


def test_gradients():
    rng = np.random.default_rng(1)
    bags, y = [rng.normal(size=(n, quality.FEATURES)) for n in (1, 3, 2)], np.array([1.0, 0.0, 1.0])
    x, begins = np.concatenate(bags), np.array([0, 1, 4])
    m = quality.train(bags, y, epochs=1)
    loss = lambda m: -np.mean(np.where(y == 1, np.log(quality.forward(m, x, begins)[0]), np.log(1 - quality.forward(m, x, begins)[0])))
    for name, g in zip(m._fields[2:], quality.backward(m, x, begins, y)):
        w = getattr(m, name)
        at = tuple(rng.integers(0, n) for n in w.shape)
        step = np.zeros_like(w)
        step[at] = 1e-5
        assert abs((loss(m._replace(**{name: w + step})) - loss(m._replace(**{name: w - step}))) / 2e-5 - g[at]) < 1e-6


def test_quality_held_out(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(frame, labels)
    kept = {r.doc_id: r.score for r in quality.score(frame, model).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(kept[i] >= 0.7) == bool(q) for i, q in truth.items() if i in kept and zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(kept) == frame.count() and sum(held) / len(held) > 0.95


def plain_score(m, bag):
    """One document's score and weights, passage by passage."""
    import math

    sig = lambda x: 1 / (1 + math.exp(-x))
    hidden = [[math.tanh(sum((x - a) / s * w for x, a, s, w in zip(row, m.mean, m.scale, m.enc[:, k])) + m.enc_b[k]) for k in range(m.enc.shape[1])] for row in bag]
    gates = [sum(g * math.tanh(sum(a * b for a, b in zip(h, m.gate_v[:, k]))) * sig(sum(a * b for a, b in zip(h, m.gate_u[:, k]))) for k, g in enumerate(m.gate_w)) for h in hidden]
    weights = [math.exp(g - max(gates)) for g in gates]
    weights = [w / sum(weights) for w in weights]
    whole = [sum(w * h[k] for w, h in zip(weights, hidden)) for k in range(len(m.out))]
    return sig(sum(a * b for a, b in zip(whole, m.out)) + m.out_b[0]), weights


def test_scores_equal_plain_forward_and_follow_passages():
    """Scores by hand; only what stands in a passage moves its row, and a document's score moves with it."""
    rng = random.Random(41)
    good = lambda n: " ".join(rng.choice(["The", "house", "stands", "near", "river.", "People", "walk", "slowly,", "there."]) for _ in range(n))
    bad = lambda n: " ".join(rng.choice(["BUY!!!", "$$$", "CLICK", "|||", "WIN!!"]) for _ in range(n))
    texts = [good(rng.randint(20, 200)) for _ in range(60)] + [bad(rng.randint(20, 200)) for _ in range(60)]
    m = quality.train([quality.encode(t).astype(np.float64) for t in texts], np.array([1.0] * 60 + [0.0] * 60), epochs=8)
    a, b = good(quality.PASSAGE * 3), bad(quality.PASSAGE)
    words = a.split(" ")
    mixed = " ".join(words[: quality.PASSAGE] + b.split(" ") + words[2 * quality.PASSAGE :])
    p, sizes, top = quality.scored(m, [a, mixed, texts[70]])
    for k, t in enumerate((a, mixed, texts[70])):
        want, weights = plain_score(m, quality.encode(t).astype(np.float16).astype(np.float64))
        assert abs(p[k] - want) < 1e-9 and sizes[k] == len(weights) and top[k] == int(np.argmax(weights))
    assert p[0] > 0.9 and p[2] < 0.1 and p[1] < p[0] - 0.02
    x, y = quality.encode(a), quality.encode(mixed)
    assert (x[0] == y[0]).all() and not (x[1] == y[1]).all() and (x[2, : 2 * quality.CLASSES] == y[2, : 2 * quality.CLASSES]).all()
    lines = quality.encode("a b\nc d\n" * 40)
    assert lines[:, 4].max() > 0 and quality.encode("汉字 字")[0, 0] == 0.75


def test_quality_edges(spark):
    rows = [(k, "Some good words are here. " * 5 if k % 2 else "BAD!! BAD!! $$$ " * 9, "x", 1) for k in range(40)] + [(50, None, "x", 1), (51, "", "x", 1), (None, "no id", "x", 1), (1, "twice", "x", 1)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(None, 1, 0), (50, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    frame = docs(spark, rows)
    got = quality.score(frame, quality.fit(frame, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.fit(frame, labels.where("quality = 1")) == 1.0 and quality.fit(frame, labels.limit(0)) == 1.0
    assert {r.score for r in quality.score(frame, 1.0).collect()} == {1.0}
    assert quality.score(docs(spark, []), 0.5).count() == 0
    assert len(quality.encode("w " * 100_000)) == 2084
