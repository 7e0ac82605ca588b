"""Two tokenizers' tokens of the same texts, aligned by divide and conquer at shared cuts.

Tokens of either tokenizer are spans of the same bytes. A byte offset at which tokens of both end is a shared cut. An
interval between two cuts is divided at the cut nearest to its middle token: a bisect in the other tokenizer's ends tells
whether an end is shared, and the search goes outwards from the middle, to the left and to the right, up to the first
shared end on each side. What lies between these two holds no cut and is a leaf group; both rests are divided further.
All intervals of a batch of texts are divided at once, level by level, and each end is looked at once.

Within a group, tokens whose byte ranges overlap are linked. Pairs of ids are counted over the whole corpus: tasks add up
what they see, and only sums are shuffled. The counts of a pair and whether it's its second id's most frequent one are
looked up by each task in blocks of bounded size, sorted by pair; no document is shuffled. There are as many pairs as
vocabulary entries can overlap, however large the corpus is.

Cases: null and empty texts, and texts whose joined tokens differ from the text, have no tokens, zeros and an empty
digest; repeated rows give repeated results and all count; an empty table gives an empty result; extra columns are
ignored; a null id stays null. Texts of any length are aligned whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import bounded_batches, by_bytes, local_path, materialize, shared_dir
from .idstore import Texts
from .segments import Memo, raw

MARK = "▁"
#: Only a space begins a segment of a piece model's text.
BLANK = np.zeros(256, bool)
BLANK[32] = True
#: Bytes of texts that are aligned at once; ends that are looked at one by one before the rest is looked at as a whole.
PART, STEPS = 4 << 20, 32
#: Pairs that a task adds up before it gives them out; pairs of a block that tasks look up in; links looked up at once.
HELD, BLOCK, ASKED = 2_000_000, 2_000_000, 4_000_000


class Tokens(NamedTuple):
    """ids of all texts in a row; where each text's begin (one more than texts); where each token ends, in bytes."""

    ids: np.ndarray
    at: np.ndarray
    ends: np.ndarray


class Bytes:
    """The bytes of each entry of a vocabulary."""

    def __init__(self, entries: list[bytes]):
        self.entries = pa.array(entries, pa.large_binary())
        self.sizes = np.fromiter(map(len, entries), np.int64, len(entries))

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return raw(self.entries.take(pa.array(ids)))[0] if len(ids) else np.empty(0, np.uint8)


def byte_of_character() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others behind U+0100 in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteLevel:
    """Ids of a byte-level vocabulary; strings of special tokens are plain text."""

    def __init__(self, path: str):
        self.texts = Texts(path)
        self.texts.library.encode_special_tokens = True
        self.texts.special = []
        table = byte_of_character()
        entries = [b""] * self.texts.library.get_vocab_size()
        special = {t.content for t in self.texts.library.get_added_tokens_decoder().values()}
        for token, i in self.texts.library.get_vocab().items():
            entries[i] = token.encode() if token in special else bytes(map(table.__getitem__, token))
        self.bytes = Bytes(entries)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.texts.encode(column)


class Pieces:
    """Ids of a piece model; the texts of a column begin with the space that the model puts before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this model crosses a word's end: texts can't be cut")
        self.bytes = Bytes([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)])
        #: Ids of a last space, behind which nothing follows.
        self.alone = self.model.encode("a ")[len(self.model.encode("a")) :]
        self.memo = Memo(self._segments, BLANK)

    def _segments(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # The model puts a mark before each text, which stands for a segment's first space.
        coded = self.model.encode([s.decode()[1:] for s in segments], num_threads=1)
        coded = [self.alone if s == b" " else ids for s, ids in zip(segments, coded)]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes.sum())), sizes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.memo.encode(column)


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(2)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


def equal_texts(data: np.ndarray, texts: np.ndarray, tokens: np.ndarray, at: np.ndarray, vocabulary: Bytes) -> np.ndarray:
    """For each text, whether the bytes of its tokens make it up."""
    joined = vocabulary.joined(tokens)
    ends = np.r_[0, np.cumsum(vocabulary.sizes[tokens])][at]
    if len(joined) == len(data) and (ends == texts).all() and (joined == data).all():
        return np.ones(len(texts) - 1, bool)
    return np.fromiter((e - s == f - t and np.array_equal(joined[s:e], data[t:f]) for s, e, t, f in zip(ends, ends[1:], texts, texts[1:])), bool, len(texts) - 1)


def only(tokens: np.ndarray, at: np.ndarray, kept: np.ndarray, sizes: np.ndarray) -> Tokens:
    """Tokens of the kept texts; the others have none."""
    n = np.diff(at)
    if not kept.all():
        tokens, n = tokens[np.repeat(kept, n)], n * kept
    return Tokens(tokens, np.r_[0, np.cumsum(n)], np.cumsum(sizes[tokens]))


def shared_cuts(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the ends a are in b too. at: where the texts' ends begin in a; each text's last end is shared.

    Both lists ascend. By divide and conquer, see the module's head.
    """
    cut = np.zeros(len(a), bool)
    low, high = at[:-1][np.diff(at) > 0], at[1:][np.diff(at) > 0]
    cut[high - 1] = True

    def shared(k: np.ndarray) -> np.ndarray:
        return b[np.searchsorted(b, a[k])] == a[k]

    def nearest(k: np.ndarray, stop: np.ndarray, step: int) -> np.ndarray:
        """From k on, the first place of a shared end before stop; stop if there is none."""
        k, active = k.copy(), np.flatnonzero(k != stop)
        for _ in range(STEPS):
            active = active[~shared(k[active])]
            k[active] += step
            active = active[k[active] != stop[active]]
            if not len(active):
                return k
        for x in active.tolist():  # a long interval without a cut: all that is left of it at once
            rest = np.arange(k[x], stop[x], step)
            found = np.flatnonzero(shared(rest))
            k[x] = rest[found[0]] if len(found) else stop[x]
        return k

    while True:
        # Tokens low to high - 1; the last one's end is a cut.
        wide = high - low > 1
        low, high = low[wide], high[wide]
        if not len(low):
            return cut
        middle = (low + high) // 2 - 1
        left = nearest(middle, low - 1, -1)
        right = left.copy()
        aside = np.flatnonzero(left != middle)
        right[aside] = nearest(middle[aside] + 1, high[aside] - 1, 1)
        cut[left[left >= low]] = True
        cut[right] = True
        low, high = np.stack([low, right + 1], 1).ravel(), np.stack([left + 1, high], 1).ravel()


class Aligned(NamedTuple):
    """Of a batch of texts: tokens, which of them end a group, and links as places of tokens, in order."""

    a: Tokens
    b: Tokens
    a_cut: np.ndarray
    b_cut: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(a: Tokens, b: Tokens) -> Aligned:
    a_cut = shared_cuts(a.ends, b.ends, a.at)
    # The last tokens of groups, in both; the places of each group's first ones are one behind the group before.
    last_a, b_cut = np.flatnonzero(a_cut), np.zeros(len(b.ids), bool)
    last_b = np.searchsorted(b.ends, a.ends[last_a])
    b_cut[last_b] = True
    first_a, first_b = (np.r_[0, x[:-1] + 1] if len(x) else x for x in (last_a, last_b))
    n_a, n_b = last_a - first_a + 1, last_b - first_b + 1
    # Each token of a overlaps those of b from where the one before it ended to where it ends itself.
    to = np.repeat(last_b, n_a)
    inner = np.flatnonzero(~a_cut & np.repeat(n_b > 1, n_a))
    to[inner] = np.searchsorted(b.ends, a.ends[inner])
    start = np.empty_like(to)
    start[1:] = to[:-1]
    start[first_a] = first_b
    n = to - start + 1
    upto = np.cumsum(n)
    link_a = np.repeat(np.arange(len(n)), n)
    link_b = np.arange(len(link_a)) + np.repeat(start - (upto - n), n)
    return Aligned(a, b, a_cut, b_cut, link_a, link_b)


def aligned(column: pa.Array, first: ByteLevel, second: Pieces) -> Aligned:
    """Alignment of a column of texts, each with a space before it."""
    column = pc.fill_null(column, "")
    spaced = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(" ", column, ""))
    data, texts = raw(spaced)
    (ids_a, at_a), (ids_b, at_b) = first.encode(spaced), second.encode(spaced)
    # What stands for a space in the model is no space in a text: where it occurs, joined bytes differ.
    kept = equal_texts(data, texts, ids_a, at_a, first.bytes) & equal_texts(data, texts, ids_b, at_b, second.bytes)
    return align(only(ids_a, at_a, kept, first.bytes.sizes), only(ids_b, at_b, kept, second.bytes.sizes))


def listed(x: Aligned, a_words: pa.Array, b_words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All groups written as a1,a2|b1;a3|b2,b3 in bytes, and where each text's begin.

    words: for each id its decimal digits with a comma, and behind these (by the number of ids) with what ends a list.
    """
    n_a, n_b = len(x.a_cut), len(x.b_cut)
    # A group's tokens of b come behind its tokens of a and before the next group's.
    groups_a, groups_b = (np.r_[0, np.cumsum(c)[:-1]] if len(c) else np.empty(0, np.int64) for c in (x.a_cut, x.b_cut))
    upto_a, upto_b = (np.r_[0, np.flatnonzero(c) + 1] for c in (x.a_cut, x.b_cut))
    order = np.empty(n_a + n_b, np.int64)
    order[np.arange(n_a) + upto_b[groups_a]] = x.a.ids.astype(np.int64) + x.a_cut * (len(a_words) // 2)
    order[np.arange(n_b) + upto_a[groups_b + 1]] = x.b.ids.astype(np.int64) + x.b_cut * (len(b_words) // 2) + len(a_words)
    words = pa.concat_arrays([a_words, b_words])
    text, begins = raw(words.take(pa.array(order)))
    return text, begins[x.a.at + x.b.at]


@lru_cache(4)
def words_of(n: int, last: str) -> pa.Array:
    return pa.array([f"{i}," for i in range(n)] + [f"{i}{last}" for i in range(n)], pa.large_string())


def digests(x: Aligned, n_a: int, n_b: int) -> list[str]:
    """The digest of each text's groups; empty without tokens."""
    text, at = listed(x, words_of(n_a, "|"), words_of(n_b, ";"))
    view = memoryview(np.ascontiguousarray(text))
    return [hashlib.sha256(view[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(at.tolist(), at[1:].tolist())]


def summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs or the sum of its n."""
    if n is not None:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    else:
        keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if n is not None and len(keys) else np.diff(np.r_[first, len(keys)])


def text_pairs(x: Aligned, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of ids of each text, a * n_b + b, how many links have each, and where each text's begin."""
    texts = len(x.a.at) - 1
    codes = x.a.ids[x.link_a].astype(np.int64) * n_b + x.b.ids[x.link_b]
    owner = np.repeat(np.arange(texts), np.diff(np.searchsorted(x.link_a, x.a.at)))
    keys, n = summed(owner << 40 | codes)
    return keys & (1 << 40) - 1, n, np.searchsorted(keys >> 40, np.arange(texts + 1))


def cells(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """One binary value for each text, holding its numbers."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])


def _schema(kind: StructType) -> pa.Schema:
    return to_arrow_schema(kind)


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, a_ids, b_ids, a_ends, b_ends for each text: its tokens, and how many of them each group ends behind."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = StructType().add("id", rows.schema["id"].dataType)
    for name in ("a_ids", "b_ids", "a_ends", "b_ends"):
        kind.add(name, ArrayType(IntegerType()))
    arrow = _schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, PART):
                x = aligned(part.column(1), byte_level(a_path), pieces(b_path))
                out = [part.column(0)]
                for values, at in ((x.a.ids, x.a.at), (x.b.ids, x.b.at)):
                    out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.astype(np.int32))))
                for cut, at in ((x.a_cut, x.a.at), (x.b_cut, x.b.at)):
                    places = np.flatnonzero(cut)
                    own = np.searchsorted(places, at)
                    out.append(pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array((places + 1 - np.repeat(at[:-1], np.diff(own))).astype(np.int32))))
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(out, arrow.types)], schema=arrow)

    return rows.mapInArrow(run, kind).withColumnRenamed("id", id_col)


def _links(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """One row for each text: figures, digest, and its distinct pairs with their numbers as bytes."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = StructType().add("id", rows.schema["id"].dataType)
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        kind.add(name, "long")
    kind = kind.add("groups_sha256", "string").add("codes", "binary").add("counts", "binary")
    arrow = _schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, PART):
                first, second = byte_level(a_path), pieces(b_path)
                n_a, n_b = len(first.bytes.sizes), len(second.bytes.sizes)
                x = aligned(part.column(1), first, second)
                codes, n, at = text_pairs(x, n_b)
                groups = np.diff(np.r_[0, np.cumsum(x.a_cut)][x.a.at])
                sizes = np.diff(x.a.at), np.diff(x.b.at), groups, np.diff(np.searchsorted(x.link_a, x.a.at))
                columns = [part.column(0), *map(pa.array, sizes), pa.array(digests(x, n_a, n_b)), cells(codes, at), cells(n.astype(np.int32), at)]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, arrow.types)], schema=arrow)

    return rows.mapInArrow(run, kind)


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    data, at = raw(column)
    size = np.dtype(kind).itemsize
    return np.frombuffer(data.tobytes(), kind), at // size


def _added(links: DataFrame) -> DataFrame:
    """Pairs of all texts: tasks add up what they read, then sums meet."""
    kind = StructType().add("code", "long").add("n", "long")
    arrow = _schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)

        def given(k, c):
            for s in range(0, len(k), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(k[s : s + (1 << 17)]), pa.array(c[s : s + (1 << 17)])], schema=arrow)

        for batch in batches:
            keys, n = summed(np.concatenate([keys, _numbers(batch.column(0), np.int64)[0]]), np.concatenate([n, _numbers(batch.column(1), np.int32)[0].astype(np.int64)]))
            if len(keys) > HELD:
                yield from given(keys, n)
                keys, n = keys[:0], n[:0]
        yield from given(keys, n)

    return links.select("codes", "counts").mapInArrow(run, kind).groupBy("code").agg(F.sum("n").alias("n"))


class Looked:
    """The blocks of a written table of pairs; as many stay in memory as are HELD."""

    def __init__(self, folder: str):
        self.system, path = local_path(folder)
        from pyarrow import fs

        found = self.system.get_file_info(fs.FileSelector(path))
        self.files = sorted(f.path for f in found if f.path.endswith(".parquet"))
        self.kept: dict[str, tuple] = {}
        self.rows = 0

    def block(self, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if path not in self.kept:
            table = parquet.read_table(path, filesystem=self.system, columns=["code", "n", "best"], partitioning=None)
            own = tuple(table.column(c).to_numpy() for c in ("code", "n", "best"))
            if self.rows + len(own[0]) > 2 * HELD:
                return own
            self.kept[path] = own
            self.rows += len(own[0])
        return self.kept[path]

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The corpus' number of each pair, and whether it's the best of its second id."""
        n, best = np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        for f in self.files:
            own, own_n, own_best = self.block(f)
            if len(own):
                at = np.minimum(np.searchsorted(own, codes), len(own) - 1)
                here = own[at] == codes
                n[here], best[here] = own_n[at[here]], own_best[at[here]]
        return n, best


@lru_cache(1)
def looked(folder: str) -> Looked:
    return Looked(folder)


def pair_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a_id, b_id, n (links of the corpus that hold them linked), best (none of b_id's pairs has more)."""
    n_b = len(pieces(b_path).bytes.sizes)
    links = materialize(_links(docs, a_path, b_path, id_col, text_col), docs.sparkSession, "links")
    return _rated(_added(links), n_b).select(F.expr(f"code div {n_b}").alias("a_id"), (F.col("code") % n_b).alias("b_id"), "n", "best")


def _rated(pairs: DataFrame, n_b: int) -> DataFrame:
    """Marks the best pairs of each second id; it has as many pairs as there are first ids at most."""
    pairs = pairs.withColumn("b", F.col("code") % n_b)
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    return pairs.join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def statistics(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each whole text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n_b = len(pieces(b_path).bytes.sizes)
    links = materialize(_links(docs, a_path, b_path, id_col, text_col), spark, "links")
    pairs = materialize(_added(links), spark, "pairs")
    folder = shared_dir(spark, "rated")
    blocks = max(1, -(-pairs.count() // BLOCK))
    _rated(pairs, n_b).repartitionByRange(blocks, "code").sortWithinPartitions("code").write.parquet(folder)

    kind = StructType([f for f in links.schema.fields if f.name not in ("codes", "counts")]).add("n_best", "long").add("count_sum", "long")
    arrow = _schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                (codes, at), (counts, _) = _numbers(part.column(6), np.int64), _numbers(part.column(7), np.int32)
                n, best = looked(folder).find(codes)
                sums = [np.r_[0, np.cumsum(v)] for v in (counts * best, counts * n)]
                columns = [*part.columns[:6], *(pa.array(np.diff(s[at])) for s in sums)]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, arrow.types)], schema=arrow)

    return links.mapInArrow(run, kind).withColumnRenamed("id", id_col)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into parts of about ASKED links, or one row."""
    held = pc.fill_null(pc.binary_length(batch.column(6)), 0).to_numpy(zero_copy_only=False) // 8
    start = size = 0
    for k, n in enumerate(held.tolist()):
        if size and size + n > ASKED:
            yield batch.slice(start, k - start)
            start, size = k, 0
        size += n
    yield batch.slice(start)
