"""Line dedup by pairwise alignment.

Documents overlap where they share a rare line. A line of 20 words is rare enough alone; shorter ones are taken with their
neighbours, as the shortest runs of adjacent key lines with so many words. The first document that holds a run (the
smallest id) is its source, and each later holder is paired with it, so that a run in n documents makes n - 1 pairs, not
n * n. A run only proposes a pair and deletes nothing: the later document's lines are aligned with the source's by patience diff
(lines that occur once on both sides, in the longest order that both keep, hold the alignment, and what lies between is
aligned in turn), aligned lines slide to equal places next to their neighbours, and what is in no aligned block is walked
through once more for moved and repeated blocks. Aligned blocks of enough words are deleted from the later document; a
line's source always keeps it. What no alignment keeps whole stays: of `x a b`, held against `x a . a b`, the first two
lines go, and the third is no block of enough words, though each pair of neighbours is common.

Of the source only the passage around the run goes to its later holders: adjacent shared lines with at least as many
holders as the run. What is sent is thereby no more than the occurrences of the passage's lines, also where a common line
is in the midst of a long document; a passage of very many holders is sent out in parts of its holders.

Lines of a few words (bullets) are no keys; they go with a block that has the same ones inside in both documents, and a
block ends where they differ. Blank lines hold no text and aren't compared. Words end at spaces, tabs and the like; a
line of over 20 characters a word (one without spaces: Chinese, a link, encoded data) has a word for each five
characters instead. Only hashes of shared lines are shuffled for the search, the texts once, to delete lines.

Cases: null texts stay null; empty texts stay empty; a null id is left alone; repeated rows are one document here, and
all of them keep what it keeps; rows with one id and other texts are documents in the order of their hashes; an empty
table gives an empty result; other columns are kept by `dedup` and never clash.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lorebase.functions.text import bind

from .common import bounded_batches, materialize

#: Least words of a line that is a key, and of a block that is deleted; holders of a passage that one part of a join has.
KEY_WORDS, BLOCK_WORDS, PART = 4, 20, 1024
#: What ends a word, the most characters a word of a spaced line, and the characters of a word in other lines.
SPACES, LONGEST, CHARACTERS = " \t\r\f\v\u00a0\u3000", 20, 5


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions of aligned equal lines, ascending on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        left, right = places(a, a0, a1), places(b, b0, b1)
        both = [x for x in left if x in right]
        once = [x for x in both if len(left[x]) == len(right[x]) == 1]
        if once:
            held = rising(sorted((left[x][0], right[x][0]) for x in once))
            for (i, j), (m, n) in zip([(a0 - 1, b0 - 1), *held], [*held, (a1, b1)]):
                todo.append((i + 1, m, j + 1, n))
            out += held
        else:
            # No line is unique: equal lines go together in their order, at once, so that long repeats stay cheap.
            out += rising(sorted(p for x in both for p in zip(left[x], right[x])))
    return sorted(out)


def places(lines: list[int], start: int, end: int) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for k in range(start, end):
        out.setdefault(lines[k], []).append(k)
    return out


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs whose second places rise too: cards on piles, each with the top of the pile before."""
    tops: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        before.append(last[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            last.append(k)
        else:
            tops[pile], last[pile] = j, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def common_blocks(own: list[tuple[int, ...]], other: list[tuple[int, ...]], least: int) -> list[tuple[int, int]]:
    """First and last line of each aligned block with enough words. own: key, line, hash, words, gap; other: key, hash, gap.

    Keys number a document's key lines, so that a line which the other lacks ends a block; so does another gap (the hash
    of the lines between a key and the key before; without gaps these lines aren't compared). What is in no block of the
    alignment is held against the other once more, from the first place there on where a line and the next one are, or the
    line alone: that finds moved and repeated blocks in one walk.
    """
    theirs = [x[1] for x in other]
    found = list(blocks(own, other, slid(own, other, align([x[2] for x in own], theirs)), least))
    gone = {k for first, last in found for k in range(first, last + 1)}
    first_place: dict[object, int] = {}
    for j, x in enumerate(theirs):
        first_place.setdefault(x, j)
        if j + 1 < len(theirs) and other[j + 1][0] == other[j][0] + 1:
            first_place.setdefault((x, theirs[j + 1], other[j + 1][2:]), j)
    moved, j = [], -1
    for i, x in enumerate(own):
        if x[1] in gone or x[2] not in first_place:
            continue
        if moved and moved[-1][0] == i - 1 and j + 1 < len(theirs) and theirs[j + 1] == x[2]:
            j += 1
        else:
            after = (x[2], own[i + 1][2], own[i + 1][4:]) if i + 1 < len(own) and own[i + 1][0] == x[0] + 1 else x[2]
            j = first_place.get(after, first_place[x[2]])
        moved.append((i, j))
    return found + list(blocks(own, other, moved, least))


def slid(own: list[tuple[int, ...]], other: list[tuple[int, ...]], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs whose lines moved to equal lines next to where their neighbour is, backward first: an alignment leaves the choice."""
    out = list(pairs)
    for way in (-1, 1):
        for n in range(len(out) - 2, -1, -1) if way < 0 else range(1, len(out)):
            (i, j), (i2, j2) = out[n], out[n - way]
            if i + 1 != i2 and i2 + 1 != i or j == j2 + way:
                continue
            j = j2 + way
            free = n + way < 0 or n + way >= len(out) or way * (out[n + way][1] - j) > 0
            if free and 0 <= j < len(other) and other[j][1] == own[i][2]:
                out[n] = (i, j)
    return out


def blocks(own: list[tuple[int, ...]], other: list[tuple[int, ...]], pairs: list[tuple[int, int]], least: int) -> Iterator[tuple[int, int]]:
    """First and last line of the runs of pairs that go on without a break on both sides and have enough words."""
    words, first = 0, None
    for n, (i, j) in enumerate(pairs):
        first = own[i] if first is None else first
        words += own[i][3]
        goes_on = n + 1 < len(pairs) and own[pairs[n + 1][0]][0] == own[i][0] + 1 and other[pairs[n + 1][1]][0] == other[j][0] + 1
        if not (goes_on and own[pairs[n + 1][0]][4:] == other[pairs[n + 1][1]][2:]):
            if words >= least:
                yield first[1], own[i][1]
            words, first = 0, None


def runs(own: list[tuple[int, ...]], least: int) -> set[tuple[int, int]]:
    """First and last place of the shortest runs of adjacent keys with enough words, by their first and by their last key.

    Of two neighbours with enough words each, the pair is a run too: else the lines between them were in none.
    """
    out, n, begin = set(), len(own), 0
    while begin < n:
        end = begin + 1
        while end < n and own[end][0] == own[end - 1][0] + 1:
            end += 1
        last, words = begin, 0
        for k in range(begin, end):
            while last < end and words < least:
                words += own[last][3]
                last += 1
            if words >= least:
                out.add((k, last - 1))
            words -= own[k][3]
        first, words = end - 1, 0
        for k in range(end - 1, begin - 1, -1):
            while first >= begin and words < least:
                words += own[first][3]
                first -= 1
            if words >= least:
                out.add((first + 1, k))
            words -= own[k][3]
        out |= {(k - 1, k) for k in range(begin + 1, end) if own[k - 1][3] >= least and own[k][3] >= least}
        begin = end
    return out


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema.types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def run_rows(held: DataFrame, least: int) -> DataFrame:
    """id, v, run, a, b: the hash of each run, and its first and last place among the document's shared keys. held: id, v, own."""
    kind = StructType().add("id", held.schema["id"].dataType)
    for name, t in (("v", "long"), ("run", "long"), ("a", "integer"), ("b", "integer")):
        kind.add(name, t)
    arrow = to_arrow_schema(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v, mine in zip(*(c.to_pylist() for c in batch.columns)):
                own = [(x["k"], x["pos"], x["hash"], x["words"], x["gap"]) for x in mine]
                for a, b in runs(own, least):
                    # The gap before the first line is no part of the run.
                    parts = [own[a][2], *(y for x in own[a + 1 : b + 1] for y in (x[4], x[2]))]
                    code = xxhash.xxh64_intdigest(struct.pack(f"<{len(parts)}q", *parts))
                    out.append((i, v, code - (1 << 64) if code >> 63 else code, a, b))
            yield _arrow(out, arrow)

    return held.select("id", "v", "own").mapInArrow(work, kind)


def around(keys: list[tuple[int, int]], begun: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """First and last place of the passage around each run. keys: number of the key, holders; begun: holders, first, last place."""
    out, held = [], {}
    for n, a, b in begun:
        first, last = held.get(n, (0, -1))
        if not first <= a <= b <= last:
            first, last = a, b
            while first and keys[first - 1][0] == keys[first][0] - 1 and keys[first - 1][1] >= n:
                first -= 1
            while last + 1 < len(keys) and keys[last + 1][0] == keys[last][0] + 1 and keys[last + 1][1] >= n:
                last += 1
            held[n] = first, last
        out.append((first, last))
    return out


def passages(held: DataFrame, run: DataFrame) -> DataFrame:
    """id, v, part, n, runs, other: the passages of sources that hold runs of later documents, n: the most holders of a run."""
    me = F.struct("id", "v")
    # A document may hold a run twice: its first place counts.
    begun = run.groupBy("run").agg(F.min(F.struct("id", "v", "a", "b")).alias("s"), F.max(me).alias("end"), F.count(F.lit(1)).alias("n"))
    begun = begun.where((F.col("s.id") != F.col("end.id")) | (F.col("s.v") != F.col("end.v")))
    begun = begun.groupBy(F.col("s.id").alias("id"), F.col("s.v").alias("v")).agg(F.sort_array(F.collect_list(F.struct("n", "s.a", "s.b", "run"))).alias("begun"))
    kind = StructType().add("id", held.schema["id"].dataType)
    for name, t in (("v", "long"), ("part", "integer"), ("n", "long"), ("runs", "array<long>"), ("other", "array<struct<k:int,hash:bigint,gap:bigint>>")):
        kind.add(name, StructType.fromDDL(f"x {t}")["x"].dataType)
    arrow = to_arrow_schema(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v, mine, first in zip(*(c.to_pylist() for c in batch.columns)):
                found: dict[tuple[int, int], list] = {}
                places = around([(x["k"], x["n"]) for x in mine], [(x["n"], x["a"], x["b"]) for x in first])
                for place, x in zip(places, first):
                    found.setdefault(place, []).append(x)
                for part, ((a, b), own) in enumerate(found.items()):
                    lines = [{"k": x["k"], "hash": x["hash"], "gap": x["gap"]} for x in mine[a : b + 1]]
                    out.append((i, v, part, max(x["n"] for x in own), [x["run"] for x in own], lines))
            yield _arrow(out, arrow)

    return held.join(begun, ["id", "v"]).select("id", "v", "own", "begun").mapInArrow(work, kind)


def _lines(text):
    return F.split(text, "\n")


def line_words(line):
    """Words of a trimmed line."""
    size = F.length(line)
    words = size - F.length(F.translate(line, SPACES, "")) + 1
    return F.when(size > LONGEST * words, F.floor(size / CHARACTERS)).otherwise(words).cast("int")


def gapped(lines, keys):
    """Keys with gap, the hash of the lines with text between a key and the key before."""

    def gap(x, k):
        before = F.when(k > 0, F.get(keys, k - 1)["pos"] + 1).otherwise(0)
        between = F.filter(F.slice(lines, before + 1, x["pos"] - before), lambda y: y != "")
        return F.struct(x["pos"].alias("pos"), x["hash"].alias("hash"), x["words"].alias("words"), F.xxhash64(between).alias("gap"))

    return F.transform(keys, gap)


def deletions(docs: DataFrame, key_words: int = KEY_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """id, v, n_gone, kept: how many lines go from each later document, and first line and number of each run that stays.

    docs: id, v (hash of the text), text. The last run that stays has no end.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    trimmed = F.transform(_lines(F.col("text")), lambda x: F.trim(x))
    numbered = lambda lines: F.transform(lines, lambda x, k: F.struct(k.alias("pos"), F.xxhash64(x).alias("hash"), line_words(x).alias("words")))
    keys = lambda lines: F.filter(numbered(lines), lambda x: x["words"] >= key_words)
    keyed = docs.where("id is not null and text is not null").select("id", "v", bind(trimmed, lambda lines: bind(keys(lines), lambda found: gapped(lines, found))).alias("keys"))
    keyed = materialize(keyed, spark, "lines")
    at = keyed.select("id", "v", F.posexplode("keys").alias("k", "x")).select("id", "v", "k", "x.*").distinct()
    me = F.struct("id", "v")
    # One row for each line and holder; summed up before the shuffle, so that a line in most documents is no load.
    counted = at.groupBy("hash").agg(F.min(me).alias("first"), F.max(me).alias("last"), F.count(F.lit(1)).alias("n")).where("first <> last").select("hash", "n")
    held = at.join(counted, "hash").groupBy("id", "v").agg(F.sort_array(F.collect_list(F.struct("k", "pos", "hash", "words", "gap", "n"))).alias("own"))
    held = materialize(held, spark, "held")
    run = materialize(run_rows(held, block_words), spark, "runs")
    passage = materialize(passages(held, run), spark, "passages")
    source = F.struct("id", "v").alias("source")
    begun = passage.select(source, "part", "n", F.explode("runs").alias("run"))
    pairs = run.join(begun, "run").where(me != F.col("source")).select("id", "v", "source", "part", "n").distinct()
    pairs = materialize(pairs, spark, "pairs")
    parts = F.floor(F.col("n") / PART)
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("id", "v"), parts + 1))
    others = salted.join(passage.select(source, "part", "other", F.explode(F.sequence(F.lit(0).cast("long"), parts)).alias("salt")), ["source", "part", "salt"])
    nothing = lambda frame, name: F.lit(None).cast(frame.schema[name].dataType).alias(name)
    rows = held.join(pairs.select("id", "v").distinct(), ["id", "v"], "left_semi").select("id", "v", F.lit(0).alias("turn"), "own", nothing(others, "other"))
    rows = rows.unionByName(others.select("id", "v", F.lit(1).alias("turn"), nothing(held, "own"), "other"))
    near = rows.repartition("id", "v").sortWithinPartitions("id", "v", "turn").select("id", "v", "own", "other")
    kind = StructType().add("id", docs.schema["id"].dataType).add("v", "long").add("n_gone", "integer").add("kept", StructType.fromDDL("k array<struct<first:int,n:int>>")["k"].dataType)
    arrow = to_arrow_schema(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, own, where, gone = None, [], {}, set()
        for batch in batches:
            out = []
            for i, v, mine, other in zip(*(c.to_pylist() for c in batch.columns)):
                if mine is not None:
                    if gone:
                        out.append((*name, len(gone), stays(gone)))
                    name, own, gone = (i, v), [(x["k"], x["pos"], x["hash"], x["words"], x["gap"]) for x in mine], set()
                    where = places([x[2] for x in own], 0, len(own))
                else:
                    other = [(x["k"], x["hash"], x["gap"]) for x in other]
                    # Lines that the other lacks are aligned with nothing.
                    both = [own[k] for k in sorted(k for x in {x[1] for x in other} for k in where.get(x, []))]
                    for first, last in common_blocks(both, other, block_words):
                        gone.update(range(first, last + 1))
            yield _arrow(out, arrow)
        if gone:
            yield _arrow([(*name, len(gone), stays(gone))], arrow)

    return near.mapInArrow(work, kind)


def stays(gone: set[int]) -> list[dict[str, int]]:
    """First line and number of lines between deleted ones; the last run has no end."""
    out, at = [], 0
    for k in sorted(gone):
        if k > at:
            out.append({"first": at, "n": k - at})
        at = k + 1
    return [*out, {"first": at, "n": 1 << 30}]


def dedup(docs: DataFrame, key_words: int = KEY_WORDS, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with the text's deleted lines gone, and __n_lines, __n_removed, which replace columns of these names."""
    spark = docs.sparkSession
    v = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    found = deletions(docs.select(F.col(id_col).alias("id"), v.alias("v"), F.col(text_col).alias("text")), key_words, block_words)
    # The list grows with the documents: the same join at every size.
    found = materialize(found, spark, "deletions").hint("merge")
    # The row goes along as one value, so that its names meet no other ones.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), v.alias("v"))
    joined = rows.join(found, ["id", "v"], "left")
    text = F.col("row")[text_col]
    left = lambda lines: F.flatten(F.transform("kept", lambda r: F.slice(lines, r["first"] + 1, r["n"])))
    new = F.when(F.col("kept").isNull(), text).otherwise(F.array_join(bind(_lines(text), left), "\n"))
    columns = [new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in ("__n_lines", "__n_removed")]
    size = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.translate(text, "\n", "")) + 1)
    return joined.select(*columns, size.alias("__n_lines"), F.coalesce("n_gone", F.lit(0)).alias("__n_removed"))
