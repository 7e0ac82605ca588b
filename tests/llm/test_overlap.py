"""op2, op6 and the pipeline against brute force."""

import random

import pytest
from test_lines import all_pairs
from test_neardup import brute_groups

from lorebase.llm import decontam, linededup


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, gone string")


def plain_distance(pattern, text):
    """Least edit distance between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def edits(rng, text, n):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        rng.choice([lambda: out.insert(k, "q"), lambda: out.pop(k), lambda: out.__setitem__(k, "z")])()
    return "".join(out)


def test_myers_equals_table():
    rng = random.Random(1)
    for _ in range(400):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (90, 120))
        masks = decontam.pattern(p, 0, 0)
        best, end = decontam.nearest(masks.masks, len(p), t)
        assert best == plain_distance(p, t)
        back, n = decontam.nearest(masks.back, len(p), t[:end][::-1], True)
        assert back == best


def test_matches_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["theon", "inger", "shable", "the", "of", "reat", "ndly"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(8, 30)))) for k in range(8)]
    rows = []
    for k in range(60):
        body = [rng.choice(words) for _ in range(60)]
        if k % 2:
            text = rng.choice(items)[1]
            body.insert(rng.randint(0, 60), edits(rng, text, rng.randint(0, int(len(text) * 0.16))))
        rows.append((k, " ".join(body), "s", 1, "x"))
    rows += [(900, None, "s", 1, "x"), (901, "", None, None, None), (None, items[0][1], "s", 1, "x"), rows[1]]
    bench = spark.createDataFrame([*items, (50, "short"), (51, None), (52, items[3][1].upper() + "!")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in decontam.matches(docs(spark, rows), bench).collect()), key=str)
    want = []
    for i, text, *_ in rows:
        for n, t in [*items, (52, items[3][1])]:
            t = decontam.plain(t)
            d = plain_distance(t, decontam.plain(text))
            if len(t) >= 30 and d <= int(len(t) * 0.1):
                want.append((i, n, d))
    assert got == sorted(want, key=str) and len(want) > 10
    small = decontam.matches(docs(spark, rows), bench, block=400)
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in small.collect()), key=str) == got
    assert decontam.matches(docs(spark, []), bench).count() == 0
    assert decontam.matches(docs(spark, rows), bench.limit(0)).count() == 0


def test_patience_alignment():
    assert linededup.align([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert linededup.align([7, 5, 5, 8], [9, 5, 5, 6]) == [(1, 1), (2, 2)]
    line = lambda k, n: (k, k, n, 30)
    own = [line(k, n) for k, n in enumerate([1, 2, 3, 4, 1, 2, 9])]
    assert sorted(linededup.common_blocks(own, [(0, 3), (1, 4), (2, 8), (3, 1), (4, 2)], 50)) == [(0, 1), (2, 3), (4, 5)]
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randint(0, 12) for _ in range(rng.randint(0, 15))] for _ in range(2))
        pairs = linededup.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    run = linededup.rising([(k, v) for k, v in enumerate([3, 1, 2, 9, 4, 5])])
    assert [j for _, j in run] == [1, 2, 4, 5]


def brute_dedup(rows):
    """All later documents against all earlier ones."""
    out = all_pairs([(i, t) for i, t, *_ in rows])
    return sorted(((i, t if i is None or t is None else out[i]) for i, t, *_ in rows), key=str)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    line = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 999)) for _ in range(n))
    passages = [[line(rng.randint(5, 40)) for _ in range(rng.randint(1, 4))] for _ in range(10)]
    boiler = [line(6), line(9), "", "ok"]
    rows = []
    for k in range(80):
        body = []
        for _ in range(rng.randint(1, 5)):
            body += rng.choice([[line(rng.randint(1, 30))], [rng.choice(boiler)], rng.choice(passages)])
        rows.append((k, "\n".join(body), "s", 1, "x"))
    rows += [(200, rows[5][1], "s", 1, "x"), (None, rows[5][1], "s", 1, "x"), (201, None, "s", 1, "x"), (202, "", None, None, None), rows[7]]
    got = linededup.dedup(docs(spark, rows).repartition(3))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute_dedup(rows)
    assert got.columns == ["doc_id", "text", "source", "n_chars", "gone", "__n_lines", "__n_removed"]
    assert linededup.dedup(docs(spark, [])).count() == 0
    kept = {r.doc_id: r.text for r in got.collect() if r.doc_id is not None}
    assert kept[200] == "" or len(kept[200]) < len(rows[5][1])
    for p in passages:
        if sum(len(x.split()) for x in p) >= 50:
            assert sum("\n".join(p) in (t or "") for t in kept.values()) <= 1


def linked(prints):
    """Groups of ids of which any two sketches are within four bits, in plain Python."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and any((x ^ y).bit_count() <= 4 for x, y in zip(prints[a], prints[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_similar_groups(spark):
    from lorebase.llm import simhash

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = [(k, " ".join(word() for _ in range(rng.randint(50, 300))), "s", 1, "x") for k in range(40)]
    for k in range(100, 160):
        words = rng.choice(rows[:40])[1].split(" ")
        for _ in range(len(words) // 50):
            words[rng.randrange(len(words))] = word()
        rows.append((k, " ".join(words), "s", 1, "x"))
    rows += [(200, None, "s", 1, "x"), (201, "", "s", 1, "x"), (None, rows[0][1], "s", 1, "x"), rows[3]]
    got = simhash.similar_groups(docs(spark, rows).repartition(3)).collect()
    want = linked({i: simhash.sketch(t or "", (1, 2, 3, 4)) for i, t, *_ in rows if i is not None})
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert sum(want[k] < 40 for k in range(100, 160)) > 50 and all(want[k] == k for k in range(40))
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.similar_groups(docs(spark, [])).count() == 0


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    frames = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, frames[-1], folder).write.parquet(path)
        frames.append(spark.read.parquet(path))
    return frames


def test_pipeline_stages(spark, staged):
    import corpus_pipeline

    first, good, lines, near, clean, ids = staged
    for frame in staged[1:5]:
        assert frame.columns == first.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    right = [(i in kept) == bool(q) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.9
    assert {r.doc_id for r in lines.collect()} == kept
    assert sorted(((r.doc_id, r.text) for r in lines.collect()), key=str) == brute_dedup([(r.doc_id, r.text) for r in good.collect()])
    groups = brute_groups([(r.doc_id, r.text) for r in lines.collect()])
    assert {r.doc_id for r in near.collect()} == set(groups.values()) and len(set(groups.values())) < len(kept)
    bench = [decontam.plain(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    left = {r.doc_id for r in clean.collect()}
    for r in near.collect():
        if any(b in decontam.plain(r.text) for b in bench):
            assert r.doc_id not in left
    assert {r.doc_id for r in ids.collect()} == left and all(r.lossless for r in ids.collect())
    assert {r.doc_id for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()} == left


def test_stages_keep_odd_rows(spark):
    import corpus_pipeline

    rows = [(1, None, "s", 1, "x"), (None, "Some words. " * 9, "s", 1, "x"), (2, "", "s", None, None), (2, "", "s", None, None)]
    frame = docs(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, frame, "/root/testdata/sf0.001")
        assert got.where("doc_id is null").count() == 1
        assert name == "byte_bpe" or got.columns == frame.columns
        assert stage(spark, frame.limit(0), "/root/testdata/sf0.001").count() == 0
    ids = {(r.doc_id, r.n_tokens) for r in corpus_pipeline.encode(spark, frame, "").collect()}
    assert {(1, 0), (2, 0)} < ids


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    frame = spark.createDataFrame([(1, "a b c", 1, 2, 3, 4), (2, "a b c", 1, 2, 3, 4)], "doc_id long, text string, `row` int, __gone int, v int, __kept int")
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, frame, "/root/testdata/sf0.001")
        assert got.columns == frame.columns and got.count() <= 2


def test_short_items_match_exactly(spark):
    bench = spark.createDataFrame([(1, "short item"), (2, "a b"), (3, "")], "item_id long, text string")
    rows = [(1, "Here a SHORT, item stands", "s", 1, "x"), (2, "here a shortitem", "s", 1, "x"), (3, "a b", "s", 1, "x"), (4, "nab b", "s", 1, "x")]
    got = {(r.doc_id, r.item_id) for r in decontam.matches(docs(spark, rows), bench).collect()}
    assert got == {(1, 1), (3, 2)}
