"""Fingerprints of documents by a homomorphic multiset hash.

Each paragraph is hashed to a wide vector; a document's fingerprint is the sum of its paragraphs' vectors, lane by lane,
modulo 2**32 for the 128 lanes of signs and modulo 2**64 for four more. So the order of paragraphs doesn't matter, a
paragraph is put in or taken out by one addition or subtraction, and equal texts have equal fingerprints. The sign lanes
also estimate how alike two multisets are: their mean product is the expected number of shared paragraphs. No text has
so many paragraphs that a sign lane would wrap.

A line is a paragraph; one with several sentences counts as these, one without an end for long is cut where a word's
checksum says so, so that a cut depends on nothing before it.

Cases: null and empty texts have the zero fingerprint and are wholly alike; of repeated ids the order is that of their
texts' digests; null ids come first, in that order too; a single document is its own next; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import bounded_batches

SIGNS, WIDE = 128, 4
LONG, WORDS = 256, 8
#: Hex digits of a digest that cut an id with very many rows.
DIGITS = 2
END = re.compile(r"\n+|(?<=[.!?])\s+")


def paragraphs(text: str) -> list[str]:
    out = []
    for p in END.split(text):
        out += cut_long(p.strip())
    return out


def cut_long(p: str) -> list[str]:
    """A paragraph, or the parts of a long one; none of an empty one."""
    if len(p) <= LONG:
        return [p] if p else []
    out: list[str] = []
    held: list[str] = []
    for w in p.split():
        held.append(w)
        if zlib.crc32(w.encode()) % WORDS == 0:
            out.append(" ".join(held))
            held = []
    return [*out, " ".join(held)] if held else out


def paragraphs_at(text: str, place: int) -> tuple[list[str], int, int]:
    """The paragraphs, how many of them end before a place whatever stands from there on, and where the next one begins."""
    out, start, before, begin = [], 0, 0, 0
    for m in END.finditer(text):
        out += cut_long(text[start : m.start()].strip())
        start = m.end()
        if start < place:
            before, begin = len(out), start
    return out + cut_long(text[start:].strip()), before, begin


def rows_of(texts: list[str]) -> np.ndarray:
    """The hash of each paragraph, as bytes: bits of signs, then wide lanes."""
    size = SIGNS // 8 + WIDE * 8
    return np.frombuffer(b"".join(hashlib.blake2b(p.encode(), digest_size=size).digest() for p in texts), np.uint8).reshape(-1, size)


def sums(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of so many rows each the sums: signs (n, 128) modulo 2**32 and wide lanes (n, 4) modulo 2**64."""
    signs, wide = np.zeros((len(sizes), SIGNS), np.int32), np.zeros((len(sizes), WIDE), np.uint64)
    full = sizes > 0
    if full.any():
        begins = (np.cumsum(sizes) - sizes)[full]
        ones = np.add.reduceat(np.unpackbits(rows[:, : SIGNS // 8], axis=1), begins, axis=0, dtype=np.int64)
        signs[full] = (2 * ones - sizes[full, None]).astype(np.int32)
        wide[full] = np.add.reduceat(np.ascontiguousarray(rows[:, SIGNS // 8 :]).view("<u8"), begins, axis=0)
    return signs, wide


def fingerprints(multisets: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of each multiset of paragraphs."""
    return sums(rows_of([p for m in multisets for p in m]), np.fromiter(map(len, multisets), np.int64, len(multisets)))


def sums_of_edits(texts: list[str], after: list[str]) -> tuple[list[str], tuple, tuple]:
    """Edited texts, the sums of all texts, and those of the edited ones, of which each has a text behind it in `after`.

    The last half of a text is replaced by as much of the beginning of the next one. Its sums lose the paragraphs that
    the edit touches and get the new ones; all before stay as they are.
    """
    new, split, put = [], [], []
    for text, behind in zip(texts, after):
        half = len(text) // 2
        new.append(text[: len(text) - half] + behind[:half])
        split.append(paragraphs_at(text, len(text) - half))
        put.append(paragraphs(new[-1][split[-1][2] :]))
    split += [(paragraphs(t), 0, 0) for t in texts[len(after) :]]
    sizes = np.fromiter((len(p) for p, *_ in split), np.int64, len(split))
    rows = rows_of([x for p, *_ in split for x in p])
    own = sums(rows, sizes)
    kept = np.fromiter((n for _, n, _ in split), np.int64, len(split))[: len(after)]
    begins = (np.cumsum(sizes) - sizes)[: len(after)]
    taken = np.concatenate([np.empty(0, np.int64), *(np.arange(s + k, s + n) for s, k, n in zip(begins.tolist(), kept.tolist(), sizes.tolist()))])
    out, more = sums(rows[taken], sizes[: len(after)] - kept), fingerprints(put)
    return new, own, tuple(a[: len(after)] - b + c for a, b, c in zip(own, out, more))


def insert(fingerprint: str, texts: list[str], sign: int = 1) -> str:
    """The fingerprint after the paragraphs of some texts are put in (sign 1) or taken out (-1)."""
    signs, wide = parse(fingerprint)
    more, most = fingerprints([[p for t in texts for p in paragraphs(t)]])
    return show(signs + np.int32(sign) * more[0], wide + most[0] if sign > 0 else wide - most[0])


def show(signs: np.ndarray, wide: np.ndarray) -> str:
    return signs.astype("<i4").tobytes().hex() + wide.astype("<u8").tobytes().hex()


def parse(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[: SIGNS * 4], "<i4"), np.frombuffer(raw[SIGNS * 4 :], "<u8")


def likeness(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
    """The estimated share of common paragraphs, row by row: 2 |A and B| / (|A| + |B|)."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    total = (x * x).sum(1) + (y * y).sum(1)
    near = np.clip(2 * (x * y).sum(1) / np.where(total > 0, total, 1), 0, 1)
    return np.where(same, 1.0, np.where(total > 0, near, 0.0))


#: A tile's first key: whether the id is known, the id, the first hex digits of the digest (none: any); and the smallest digest.
Bound = tuple[tuple, str | None]


def bounds(docs: DataFrame, tiles: int) -> tuple[list[Bound], Bound | None]:
    """Where each tile but the first begins, and where the first one does. docs: id, text.

    Tiles are ranges of ids. An id with more rows than a tile should have, and rows without an id, if they are as many, are
    cut by their digests too. No tile is empty. The driver gets a bounded number of keys.
    """
    i, sha = F.col("id"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    at = [k / tiles for k in range(1, tiles)] or [0.5]
    row = docs.select(F.percentile_approx(i, at, 20 * tiles).alias("cuts"), F.min(i).alias("least"), F.count(F.lit(1)).alias("n"), F.count(i).alias("known")).first()
    cuts = [c for c in row.cuts or [] if tiles > 1]
    heavy = sorted({c for c, n in Counter(cuts).items() if n > 1})
    nulls = row.n - row.known
    firsts = {}
    if heavy or nulls:
        own = docs.where(i.isNull() | i.isin(heavy)).groupBy("id", F.substring(sha, 1, DIGITS).alias("sub")).agg(F.min(sha).alias("first"))
        for r in own.collect():
            firsts.setdefault(r.id, []).append((r["sub"], r["first"]))
    out: list[Bound] = []
    if nulls:
        subs = sorted(firsts[None])
        out += [((0, 0, d), f) for d, f in (subs if nulls * tiles > row.n else [("", subs[0][1])])]
    if row.known:
        for c in sorted({row.least, *cuts}):
            out += [((1, c, d), f) for d, f in (sorted(firsts[c]) if c in heavy else [("", None)])]
    return out[1:], out[0] if out else None


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text of a document has its last half replaced by the beginning of the next one. Documents are dealt
    out by ranges of ids; the first of each range is also sent to the one before, so that no task needs another's rows.
    The text crosses the network once, compressed.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = 4 * partitions  # several for each task, as the hash of a tile's number deals them unevenly
    begins, first = bounds(narrow, tiles)
    kind = narrow.schema["id"].dataType
    dealt = StructType().add("tile", "integer").add("carry", "boolean").add("known", "boolean").add("id", kind).add("sha", "string").add("packed", "binary")
    arrow = to_arrow_schema(dealt)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, pack = [b for b, _ in begins], zstandard.ZstdCompressor(level=3)

        def leads(bound: Bound, known: int, i, sha: str) -> bool:
            return bound[0][:2] == (known, i) and bound[1] in (None, sha)

        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode()
                sha = hashlib.sha256(data).hexdigest()
                known, own = (0, 0) if i is None else (1, i)
                tile = bisect_right(keys, (known, own, sha[:DIGITS]))
                row = (tile, False, i is not None, i, sha, pack.compress(data))
                rows.append(row)
                if tile and leads(begins[tile - 1], known, own, sha):
                    rows.append((tile - 1, True, *row[2:]))
                if leads(first, known, own, sha):
                    rows.append((len(begins), True, *row[2:]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, arrow.types)], schema=arrow)

    result = StructType().add("id", kind).add("n_chars", "long").add("edited_sha256", "string").add("fingerprint", "string").add("edited_fingerprint", "string").add("near_edited", "double").add("near_next", "double")
    shape = to_arrow_schema(result)

    def pairs(run: list[tuple]) -> pa.RecordBatch:
        """run: id and text of documents in a row; all but the last give a row."""
        texts = [t for _, t in run]
        new, (signs, wide), (b, wb) = sums_of_edits(texts, texts[1:])
        a, wa, c, wc = signs[:-1], wide[:-1], signs[1:], wide[1:]
        same = lambda s, w: (a == s).all(1) & (wa == w).all(1)
        columns = [[i for i, _ in run[:-1]], [len(t) for t in texts[:-1]], [hashlib.sha256(t.encode()).hexdigest() for t in new], [show(*x) for x in zip(a, wa)], [show(*x) for x in zip(b, wb)], likeness(a, b, same(b, wb)), likeness(a, c, same(c, wc))]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, shape.types)], schema=shape)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        run, size, at, ended = [], 0, None, False
        for batch in batches:
            for tile, carry, i, packed in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 5))):
                if tile != at:
                    if len(run) > 1:
                        yield pairs(run)
                    run, size, at, ended = [], 0, tile, False
                if ended:
                    continue  # of several rows that lead the next tile the first counts
                text = unpack.decompress(packed).decode()
                run.append((i, text))
                size += len(text)
                ended = carry
                if size > 4 << 20 or len(run) >= 2000:
                    if len(run) > 1:
                        yield pairs(run)
                    run, size = run[-1:], len(text)
        if len(run) > 1:
            yield pairs(run)

    placed = narrow.mapInArrow(deal, dealt).repartition(partitions, "tile").sortWithinPartitions("tile", "carry", "known", "id", "sha")
    return placed.select("tile", "carry", "known", "id", "sha", "packed").mapInArrow(follow, result).select(F.col("id").alias(id_col), *result.names[1:])
