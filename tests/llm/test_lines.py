"""Line dedup: lines between keys, lines without spaces, passages of common lines."""

import random

from lorebase.llm import linededup


def dedup(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.text for r in linededup.dedup(frame.repartition(3)).collect()}


def line(rng, n):
    return " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 9999)) for _ in range(n))


def test_lines_between_keys_are_compared(spark):
    rng = random.Random(21)
    a, b, c, d = (line(rng, 25) for _ in range(4))
    got = dedup(spark, [(1, f"{a}\nTotal: 9\n{b}"), (2, f"{a}\nTotal: 5\n{b}"), (3, f"{c}\nok\n\n{d}"), (4, f"{c}\n\nok\n{d}\nend"), (5, f"{c}\n{d}")])
    assert got == {1: f"{a}\nTotal: 9\n{b}", 2: "Total: 5", 3: f"{c}\nok\n\n{d}", 4: "end", 5: ""}


def test_lines_without_spaces_are_keys(spark):
    rng = random.Random(22)
    chinese = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(120))
    tabs, link = line(rng, 25).replace(" ", "\t"), "https://example.org/" + "".join(rng.choice("abc/") for _ in range(200))
    other = chinese[::-1]
    a, b = line(rng, 25), line(rng, 25)
    got = dedup(spark, [(1, chinese), (2, f"{chinese}\nown"), (3, tabs), (4, f"own\n{tabs}"), (5, link), (6, link), (7, f"{a}\n{b}"), (8, f"{a}\n{other}\n{b}")])
    assert got == {1: chinese, 2: "own", 3: tabs, 4: "own", 5: link, 6: "", 7: f"{a}\n{b}", 8: other}


def all_pairs(rows):
    """Each document against all earlier ones: lines of common runs of adjacent lines with enough words, in plain Python.

    Rows without id or text stay as they are; repeated rows are one document.
    """
    keys = {}
    for i, text in sorted({r for r in rows if None not in r}):
        found, between = [], []
        for pos, x in enumerate(text.split("\n")):
            x = x.strip(" ")
            if x.count(" ") + 1 >= linededup.KEY_WORDS:
                found.append((pos, x, x.count(" ") + 1, tuple(between)))
                between = []
            elif x:
                between.append(x)
        keys[i] = found
    out = {}
    for i, text in sorted({r for r in rows if None not in r}):
        gone = set()
        for s in (s for s in keys if s < i):
            own, other = keys[i], keys[s]
            at = {}
            for b, x in enumerate(other):
                at.setdefault(x[1], []).append(b)
            for a in range(len(own)):
                for b in at.get(own[a][1], []):
                    n = 0
                    while a + n < len(own) and b + n < len(other) and own[a + n][1] == other[b + n][1] and (not n or own[a + n][3] == other[b + n][3]):
                        n += 1
                    if sum(x[2] for x in own[a : a + n]) >= linededup.BLOCK_WORDS:
                        gone |= set(range(own[a][0], own[a + n - 1][0] + 1))
        out[i] = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
    return out


def test_passage_of_lines_from_other_documents(spark):
    rng = random.Random(23)
    a, b, c, d = (line(rng, 12) for _ in range(4))
    rows = [(1, f"{a}\n{line(rng, 30)}"), (2, f"{b}\n{line(rng, 30)}"), (3, f"{a}\n{b}"), (4, f"{c}\n{a}\n{b}\n{d}")]
    got = dedup(spark, rows)
    assert got == {**dict(rows), 4: f"{c}\n{d}"} == all_pairs(rows)


def test_equals_all_pairs(spark):
    """Without lines that a document holds twice, alignment finds every common run."""
    rng = random.Random(24)
    pool = [line(rng, rng.choice([4, 5, 9, 13, 19, 20, 31])) for _ in range(16)] + ["", "ok", "Total: 5"]
    rows = [(k, "\n".join(x if rng.random() < 0.8 else line(rng, 8) for x in rng.sample(pool, rng.randint(1, 14)))) for k in range(150)]
    assert dedup(spark, rows) == all_pairs(rows)
    assert sum(t != u for (_, t), u in zip(rows, all_pairs(rows).values())) > 30


def test_repeated_lines(spark):
    """With lines that documents hold over and over, an alignment may cut a common run, and never deletes another line."""
    rng = random.Random(24)
    pool = [line(rng, rng.choice([4, 5, 9, 13, 19, 20, 31])) for _ in range(16)] + ["", "ok", "Total: 5"]
    rows = [(k, "\n".join(rng.choice(pool) if rng.random() < 0.8 else line(rng, 8) for _ in range(rng.randint(1, 14)))) for k in range(150)]
    got, most = dedup(spark, rows), all_pairs(rows)
    for i, _ in rows:
        left = iter(got[i].split("\n"))
        assert not most[i] or all(x in left for x in most[i].split("\n"))
    assert sum(got[i] != most[i] for i, _ in rows) <= 2


def test_eight_holders_of_a_block(spark):
    """Each line of a block is first held by another document; two later documents hold all of it."""
    rng = random.Random(26)
    block = [line(rng, 5) for _ in range(8)]
    rows = [(k, f"{line(rng, 30)}\n{x}") for k, x in enumerate(block)] + [(20, "\n".join([line(rng, 9), *block])), (21, "\n".join([line(rng, 9), *block]))]
    got = dedup(spark, rows)
    assert got == all_pairs(rows) and got[21].count("\n") == 0


def test_long_repeats_take_linear_time():
    import time

    began = time.process_time()
    same = [(k, k, 7, 30, 0) for k in range(100_000)]
    assert len(linededup.common_blocks(same, [(0, 7, 0)], 20)) == 100_000
    rng = random.Random(27)
    mixed = [(k, k, rng.randint(0, 1), 30, 0) for k in range(50_000)]
    linededup.common_blocks(mixed, [(k, rng.randint(0, 1), 0) for k in range(50_000)], 20)
    assert time.process_time() - began < 10
    assert linededup.stays({0, 1, 5}) == [{"first": 2, "n": 3}, {"first": 6, "n": 1 << 30}]


def test_columns_of_any_name(spark):
    rng = random.Random(28)
    a = line(rng, 30)
    rows = [(1, a, 1, "x", 2, 3, 4, 5), (2, f"{a}\nown", 1, "x", 2, 3, 4, 5)]
    names = ("doc_id", "text", "__gone", "__id", "__v", "__w", "__kept", "row")
    got = linededup.dedup(spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n in ('text', '__id') else 'long'}" for n in names)))
    assert got.columns == [*names, "__n_lines", "__n_removed"]
    assert [(r.doc_id, r.text, r["__gone"], r["__n_removed"]) for r in got.orderBy("doc_id").collect()] == [(1, a, 1, 0), (2, "own", 1, 1)]


def test_frequent_passages(spark, monkeypatch):
    """Passages of very many holders are sent to them in parts."""
    monkeypatch.setattr(linededup, "PART", 16)
    rng = random.Random(29)
    common = [line(rng, 12), line(rng, 12)]
    rows = [(k, "\n".join([line(rng, 6), *common, line(rng, 6)])) for k in range(84)]
    got = dedup(spark, rows)
    assert got == all_pairs(rows) and sum(common[0] in t for t in got.values()) == 1


def keyed(lines, words=12):
    return [(k, k, x, words, 0) for k, x in enumerate(lines)]


def test_alignment_decides():
    """A common run that crosses an aligned block's end stays; equal lines next to their neighbours are kept together."""
    of = lambda own, other: sorted(linededup.common_blocks(keyed(own), [x[::2][:2] + (0,) for x in keyed(other)], 20))
    whole, torn = [1, 2, 3], [1, 2, 9, 2, 3]
    assert of(whole, torn) == [(0, 1)]
    hashes = lambda own: {tuple(own[a : b + 1]) for a, b in linededup.runs(keyed(own), 20)}
    assert {(1, 2), (2, 3)} == hashes(torn) & hashes(whole)
    assert of([1, 2], [1, 9, 1, 2, 8, 2]) == [(0, 1)]
    assert of([1, 2], [1, 9, 1, 2]) == of([1, 2], [1, 2, 9, 2]) == [(0, 1)]
    assert of([3, 4, 7, 1, 2], [1, 2, 8, 3, 4]) == [(0, 1), (3, 4)]
    assert of([1, 2, 3], [2, 1, 3]) == []


def test_passages_around_runs():
    keys = [(0, 2), (1, 9), (2, 9), (3, 2), (5, 9), (6, 9)]
    assert linededup.around(keys, [(9, 1, 2), (2, 0, 1), (2, 2, 3), (9, 4, 5)]) == [(1, 2), (0, 3), (0, 3), (4, 5)]
    assert linededup.around(keys, []) == []


def test_against_aligning_all_pairs(spark):
    """Each document aligned with every earlier whole one deletes the same."""
    rng = random.Random(30)
    pool = [line(rng, rng.choice([5, 9, 13, 20, 31])) for _ in range(60)]
    rows = []
    for k in range(120):
        start, n = rng.randrange(len(pool)), rng.randint(1, 9)
        rows.append((k, "\n".join([line(rng, 8), *pool[start : start + n], line(rng, 8), *rng.sample(pool[:start] + pool[start + n :], 3)])))
    docs = {i: [(k, k, x, x.count(" ") + 1, 0) for k, x in enumerate(t.split("\n"))] for i, t in rows}
    want = {}
    for i, own in docs.items():
        gone = {k for j in range(i) for first, last in linededup.common_blocks(own, [(x[0], x[2], 0) for x in docs[j]], linededup.BLOCK_WORDS) for k in range(first, last + 1)}
        want[i] = "\n".join(x[2] for x in own if x[0] not in gone)
    assert dedup(spark, rows) == want
