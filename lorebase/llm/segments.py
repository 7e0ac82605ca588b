"""Ids of whole columns of texts by way of their distinct segments.

A segment is white space and what follows up to the next white space. A pattern none of whose matches goes on from a
character that isn't white space to one that is can't cross from one segment to the next, so each can be encoded by
itself and put together again. All texts of a batch are cut, numbered and put together at once, in arrays; only segments
that a worker has not met before are encoded one by one.

Only ASCII white space begins a segment. Where the character before it is white space beyond ASCII no segment begins,
as the two are one run. Codes 1c to 1f count as white space for Python alone and not here.

Cases: null texts count as empty; empty texts have no segments and no ids; an empty batch gives no ids.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[*range(9, 14), 32]] = True
#: UTF-8 ends of white space beyond ASCII, by their number of bytes.
WIDE2 = np.array([0xC285, 0xC2A0])
WIDE3 = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
#: Segments that a worker remembers, how often a batch must hold one, and the longest; what is forgotten costs time alone.
MOST_ROWS, OFTEN, MOST_BYTES = 200_000, 2, 48
#: How many times as many stay where they are held as a column.
ROOM = 3


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts in a row, and where each begins (one more than texts)."""
    column = pc.fill_null(column, "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return all_bytes[at[0] : at[-1]], at - at[0]


def begins(data: np.ndarray, texts: np.ndarray, spaces: np.ndarray = SPACE) -> np.ndarray:
    """First bytes of the segments of all texts, of which each begins one; spaces tells the bytes that begin others."""
    space = spaces[data]
    begin = np.zeros(len(data), bool)
    begin[1:] = space[1:] & ~space[:-1]
    high = np.flatnonzero(begin[1:] & (data[:-1] >= 0x80)) + 1
    begin[high[wide_before(data, high)]] = False
    begin[texts[:-1][np.diff(texts) > 0]] = True
    return np.flatnonzero(begin)


def wide_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space beyond ASCII ends right before these places."""
    if not len(at):
        return np.zeros(0, bool)
    two = data[at - 1].astype(np.int64) | data[np.maximum(at - 2, 0)].astype(np.int64) << 8
    three = two | data[np.maximum(at - 3, 0)].astype(np.int64) << 16
    return np.isin(two, WIDE2) | np.isin(three, WIDE3)


def coded(data: np.ndarray, starts: np.ndarray) -> pa.DictionaryArray:
    """The segments as a column of numbers of the distinct ones."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    whole = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return whole.dictionary_encode()


def numbered(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each segment among the distinct ones, and these."""
    found = coded(data, starts)
    return found.indices.to_numpy(), found.dictionary.to_pylist()


def runs(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of an array that begin there, in a row, and where each ends in it."""
    upto = np.cumsum(size)
    return flat[np.repeat(begin - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)], upto


class Memo:
    """What `encode` gives for segments. It takes distinct ones and gives their ids in a row and the number of each one's."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], spaces: np.ndarray = SPACE):
        self.encode_new, self.spaces = encode, spaces
        self.clear()

    def clear(self) -> None:
        self.code: dict[bytes, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.begin, self.size, self.rows = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.rows + len(sizes) > len(self.size):
            self.begin, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[self.rows : self.rows + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.rows : self.rows + len(sizes)] = sizes
        self.used += len(ids)
        self.rows += len(sizes)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts in a row, and where each text's begin (one more than texts)."""
        data, texts = raw(column)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        if self.rows > MOST_ROWS:
            self.clear()
        starts = begins(data, texts, self.spaces)
        index, distinct = numbered(data, starts)
        get = self.code.get
        codes = np.fromiter((get(s, -1) for s in distinct), np.int64, len(distinct))
        new = np.flatnonzero(codes < 0)
        rows, used = self.rows, self.used
        if len(new):
            # Segments that are long or stand once in a batch are hardly met again: they come last and are forgotten after it.
            count = np.bincount(index, minlength=len(distinct))
            rare = np.fromiter((count[k] < OFTEN or len(distinct[k]) > MOST_BYTES for k in new.tolist()), bool, len(new))
            new = np.concatenate([new[~rare], new[rare]])
            segments = [distinct[k] for k in new.tolist()]
            ids, sizes = self.encode_new(segments)
            codes[new] = np.arange(rows, rows + len(new))
            kept = len(new) - int(rare.sum())
            self.code.update(zip(segments[:kept], range(rows, rows + kept)))
            self._add(ids, sizes)
            rows, used = rows + kept, used + int(sizes[:kept].sum())
        place = codes[index]
        out, upto = runs(self.flat, self.begin[place], self.size[place])
        self.rows, self.used = rows, used
        return out, np.r_[0, upto][np.searchsorted(starts, texts)]


class ColumnMemo(Memo):
    """As Memo, for an `encode` that takes a column of distinct segments; cut gives the places where those begin.

    What it remembers is a column too and takes a fraction of the room of a dict, so that all but long segments stay.
    When they are too many, those that no other batch had since they came, or since the last time, are forgotten.
    """

    def __init__(self, encode: Callable[[pa.BinaryArray], tuple[np.ndarray, np.ndarray]], cut: Callable[[np.ndarray, np.ndarray], np.ndarray] = begins):
        super().__init__(encode)
        self.cut = cut

    def clear(self) -> None:
        super().clear()
        self.known, self.met = pa.array([], pa.binary()), np.empty(0, np.int32)

    def _forget(self, most: int) -> None:
        kept = np.argsort(-self.met, kind="stable")[: most // 2]
        kept = kept[self.met[kept] > 1]
        known, size = self.known.take(pa.array(kept)), self.size[kept]
        ids, _ = runs(self.flat, self.begin[kept], size)
        self.clear()
        self._add(ids, size)
        self.known, self.met = known, np.ones(len(kept), np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, texts = raw(column)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        if self.rows > ROOM * MOST_ROWS:
            self._forget(ROOM * MOST_ROWS)
        starts = self.cut(data, texts)
        found = coded(data, starts)
        distinct = found.dictionary
        codes = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(codes < 0)
        self.met[codes[codes >= 0]] += 1
        rows, used = self.rows, self.used
        if len(new):
            # Long segments are hardly met again: they come last and are forgotten after the batch.
            long = pc.binary_length(distinct).to_numpy()[new] > MOST_BYTES
            new = np.concatenate([new[~long], new[long]])
            segments = distinct.take(pa.array(new))
            ids, sizes = self.encode_new(segments)
            codes[new] = np.arange(rows, rows + len(new))
            kept = len(new) - int(long.sum())
            self.known = pa.concat_arrays([self.known, segments.slice(0, kept)])
            self.met = np.concatenate([self.met, np.ones(kept, np.int32)])
            self._add(ids, sizes)
            rows, used = rows + kept, used + int(sizes[:kept].sum())
        place = codes[found.indices.to_numpy()]
        out, upto = runs(self.flat, self.begin[place], self.size[place])
        self.rows, self.used = rows, used
        return out, np.r_[0, upto][np.searchsorted(starts, texts)]
