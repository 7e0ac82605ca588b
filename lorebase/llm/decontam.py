"""Benchmark decontamination by pigeonhole edit matching.

A test item with a budget of k edits is halved again and again, and the budget with it: if the whole matches with at
most e edits, one of two halves with budgets e1 + e2 + 1 = e matches within its own. That ends in k + 1 pieces without
budget, which an automaton finds exactly in one pass over a text. From a piece's hit the halves above it are verified
one by one with Myers' bit-parallel distance, up to the whole item, so that chance hits end at short patterns.

Texts and items are compared as lower-case words with one space between them; the budget is a share of the item's
length in that form. Items are sent to the tasks in blocks of bounded size; each block is one more pass over the
documents, so that the benchmark may have any size. No candidates are dropped: every hit is verified.

Items shorter than least_chars have no budget and match as whole words alone: a few edits make other words of them.

Cases: null texts and items count as empty; items without a word find nothing; repeated items are reported by each id,
repeated documents each; null ids stay null; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyarrow import parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import bounded_batches, by_bytes, local_path, shared_dir

#: Edits for each character of an item; shortest item that may have any; bytes of items that one pass carries.
RATE, LEAST_CHARS, BLOCK = 0.1, 30, 1 << 20
WORD = re.compile(r"\w+")


def plain(text: str | None) -> str:
    return " ".join(WORD.findall((text or "").lower()))


class Pattern(NamedTuple):
    """A part of an item: its place there, its budget, and bit masks of its characters from either side."""

    start: int
    length: int
    budget: int
    masks: dict[str, int]
    back: dict[str, int]


def pattern(text: str, start: int, budget: int) -> Pattern:
    masks: dict[str, int] = {}
    back: dict[str, int] = {}
    for k, c in enumerate(text):
        masks[c] = masks.get(c, 0) | 1 << k
        back[c] = back.get(c, 0) | 1 << (len(text) - 1 - k)
    return Pattern(start, len(text), budget, masks, back)


def nearest(masks: dict[str, int], length: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """The least edit distance between a pattern and a part of the text that ends somewhere, and the first such end.

    Anchored: the part begins where the text does, and the longest end is taken. Vertical differences of the distance
    table are two bit vectors; one addition carries along a whole column.
    """
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, now = full, 0, length
    best, at = length, 0
    get = masks.get
    for k, c in enumerate(text, 1):
        eq = get(c, 0)
        x = eq | down
        d = (((x & up) + up) ^ up) | x
        right, left = down | (full & ~(d | up)), up & d
        if right & top:
            now += 1
        elif left & top:
            now -= 1
        right = right << 1 | anchored
        left <<= 1
        up, down = full & (left | ~(x | right)), right & x
        if now < best or anchored and now == best:
            best, at = now, k
    return best, at


class Item(NamedTuple):
    item_id: object
    whole: Pattern
    #: For each piece: its text, its place, and the parts above it from small to whole.
    pieces: list[tuple[str, int, list[Pattern]]]


def item(item_id, text: str, rate: float, least_chars: int = LEAST_CHARS) -> Item:
    """Halves a text with its budget until none is left. A short text has none from the start."""
    whole = pattern(text, 0, int(len(text) * rate) if len(text) >= least_chars else 0)
    pieces: list[tuple[str, int, list[Pattern]]] = []

    def halve(start: int, end: int, budget: int, above: list[Pattern]) -> None:
        if budget == 0:
            pieces.append((text[start:end], start, above))
            return
        left = (budget - 1) // 2
        right = budget - 1 - left
        cut = start + round((end - start) * (left + 1) / (budget + 1))
        for a, b, e in ((start, cut, left), (cut, end, right)):
            halve(a, b, e, ([pattern(text[a:b], a, e)] if e else []) + above)

    halve(0, len(text), whole.budget, [whole])
    return Item(item_id, whole, pieces)


class Matcher:
    def __init__(self, items: list[tuple[object, str]], rate: float, least_chars: int = LEAST_CHARS):
        import ahocorasick

        self.items = [item(i, t, rate, least_chars) for i, t in items if t]
        self.least_chars = least_chars
        places: dict[str, list[tuple[int, int, list[Pattern]]]] = {}
        for n, it in enumerate(self.items):
            for text, start, above in it.pieces:
                places.setdefault(text, []).append((n, start, above))
        self.pieces = ahocorasick.Automaton()
        for text, found in places.items():
            self.pieces.add_word(text, (len(text), found))
        if places:
            self.pieces.make_automaton()
        self.empty = not places

    def search(self, text: str) -> list[tuple[object, int, int, int, int]]:
        """Item, distance, begin, end and number of places for each item within its budget; of the places the nearest, then the first."""
        if self.empty:
            return []
        spans: dict[int, dict[tuple[int, int], int]] = {}
        tried: set[tuple[int, int, int, int]] = set()
        for end, (size, found) in self.pieces.iter(text):
            for n, start, above in found:
                origin = end + 1 - size - start
                short = self.items[n].whole.length < self.least_chars
                if short and (text[origin - 1 : origin] or " ", text[end + 1 : end + 2] or " ") != (" ", " "):
                    continue  # whole words only
                for p in above:
                    # The same part at the same place was tried from another of its pieces.
                    key = (n, p.start, p.length, origin)
                    if key in tried:
                        break
                    tried.add(key)
                    at = origin + p.start
                    if nearest(p.masks, p.length, text[max(0, at - p.budget) : at + p.length + p.budget])[0] > p.budget:
                        break
                else:
                    self._report(n, text, origin, spans)
        return [(self.items[n].item_id, *min((d, *s) for s, d in own.items()), len(own)) for n, own in spans.items()]

    def _report(self, n: int, text: str, origin: int, spans: dict[int, dict[tuple[int, int], int]]) -> None:
        p = self.items[n].whole
        low = max(0, origin - p.budget)
        part = text[low : origin + p.length + p.budget]
        distance, stop = nearest(p.masks, p.length, part)
        _, back = nearest(p.back, p.length, part[:stop][::-1], True)
        spans.setdefault(n, {})[low + stop - back, low + stop] = distance


@lru_cache(2)
def matcher(folder: str, block: int, rate: float, least_chars: int) -> Matcher:
    """Of one written block of items."""
    system, path = local_path(f"{folder}/b={block}")
    rows = parquet.read_table(path, filesystem=system, partitioning=None).to_pylist() if system.get_file_info(path).type.name == "Directory" else []
    items = sorted(((r["item"], plain(r["text"])) for r in rows), key=str)
    return Matcher(items, rate, least_chars)


def blocks_of(benchmark: DataFrame, block: int = BLOCK, item_col: str = "item_id", item_text: str = "text") -> tuple[str, int]:
    """Writes the items in the shared folder, in blocks of about so many bytes; tasks read a block when they need it.

    The driver holds no items. Each block is one pass over the texts, all in the same tasks.
    """
    spark = benchmark.sparkSession
    tests = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    blocks = max(1, -(-tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // block))
    folder = shared_dir(spark, "items")
    tests.withColumn("b", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int")).repartition(min(blocks, 1000), "b").write.partitionBy("b").parquet(folder)
    return folder, blocks


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least_chars: int = LEAST_CHARS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, item_id, distance, begin, end, n_places for each document and item that match; places are in plain text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = StructType().add("id", rows.schema["id"].dataType).add("item", benchmark.schema[item_col].dataType).add("distance", "integer").add("begin", "long").add("end", "long").add("n_places", "integer")
    arrow = to_arrow_schema(kind)
    folder, blocks = blocks_of(benchmark, block, item_col, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                texts = [plain(t) for t in part.column(1).to_pylist()]
                ids = part.column(0).to_pylist()
                for b in range(blocks):
                    search = matcher(folder, b, rate, least_chars).search
                    found = [(i, *m) for i, t in zip(ids, texts) for m in search(t)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * len(arrow), arrow.types)], schema=arrow)

    return rows.mapInArrow(run, kind).select(F.col("id").alias(id_col), F.col("item").alias(item_col), *kind.names[2:])


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least_chars: int = LEAST_CHARS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item; rows without an id stay. Decided row by row: texts don't leave their tasks."""
    folder, blocks = blocks_of(benchmark, block)

    @F.arrow_udf("boolean")
    def leaks(texts: pa.Array) -> pa.Array:
        plains = [plain(t) for t in texts.to_pylist()]
        out = [False] * len(plains)
        for b in range(blocks):
            search = matcher(folder, b, rate, least_chars).search
            out = [x or bool(search(t)) for x, t in zip(out, plains)]
        return pa.array(out, pa.bool_())

    bounded_batches(docs.sparkSession)
    return docs.where(F.col(id_col).isNull() | ~leaks(F.col(text_col)))
