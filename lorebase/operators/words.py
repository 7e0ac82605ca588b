"""Finds given terms among the words of many texts at once, as array operations over the bytes of a column.

A word is a maximal run of lower-case letters and digits (a-z, 0-9, à-ö, ø-ÿ, ß) or of ideographs (U+4E00 to U+9FFF), as
`index.TERM` says it. A word's first and last eight bytes and its length tell words of up to sixteen bytes apart; they are
looked up by a hash of these, and longer ones that are found are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are worked on at once, about.
BYTES = 1 << 20
#: Bytes at either end of a word that are read as a number.
ENDS = 8

LETTER = np.zeros(256, np.uint8)
LETTER[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = 1
#: Second bytes behind 0xC3 of letters.
LATIN = np.zeros(256, bool)
LATIN[[0x9F, *range(0xA0, 0xB7), *range(0xB8, 0xC0)]] = True


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column and where each text's begin (one more than texts); nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text of each word."""
    kind = LETTER[data]
    if len(data) and data.max() >= 0x80:
        after = np.append(data[1:], np.uint8(0))
        lead = np.flatnonzero(data == 0xC3)
        lead = lead[LATIN[after[lead]]]
        kind[lead] = kind[lead + 1] = 1
        lead = np.flatnonzero((data >= 0xE4) & (data <= 0xE9))
        lead = lead[(data[lead] != 0xE4) | (after[lead] >= 0xB8)]
        lead = lead[lead + 2 < len(data)]
        kind[lead] = kind[lead + 1] = kind[lead + 2] = 2
    mark = np.zeros(len(data) + 1, bool)
    mark[1:-1] = kind[1:] != kind[:-1]
    mark[at] = True
    edges = np.flatnonzero(mark)
    word = kind[edges[:-1]] > 0 if len(data) else np.zeros(0, bool)
    starts, ends = edges[:-1][word], edges[1:][word]
    return starts, ends, np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(starts, at)))


MASK = np.array([(1 << 8 * k) - 1 for k in range(ENDS + 1)], np.uint64)


def marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its first and last eight bytes (zeros behind shorter ones) and a hash of these and its length."""
    held = np.zeros(len(data) + 2 * ENDS, np.uint8)
    held[ENDS:-ENDS] = data
    eights = np.ndarray(len(data) + ENDS, "<u8", held, strides=(1,))
    mask = MASK[np.minimum(ends - starts, ENDS)]
    first, last = eights[starts + ENDS] & mask, eights[ends]
    last &= mask << ((np.uint64(ENDS) - np.minimum(ends - starts, ENDS).astype(np.uint64)) * np.uint64(8))
    h = (first ^ (last * np.uint64(0x9E3779B97F4A7C15)) ^ (ends - starts).astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    return first, last, h * np.uint64(0xD6E8FEB86659FD93)


class Terms:
    """Terms with a number each."""

    def __init__(self, numbers: dict[str, int]):
        names = [t.encode() for t in numbers]
        size = np.fromiter(map(len, names), np.int64, len(names))
        ends = np.cumsum(size)
        self.data = np.frombuffer(b"".join(names), np.uint8)
        first, last, h = marks(self.data, ends - size, ends)
        order = np.argsort(h, kind="stable")
        self.hashes, self.first, self.last, self.size, self.starts = h[order], first[order], last[order], size[order], (ends - size)[order]
        self.ids = np.fromiter(numbers.values(), np.int64, len(names))[order]
        #: Terms of one hash, at most: so many places are looked at.
        self.most = int(np.unique(self.hashes, return_counts=True)[1].max(initial=0))
        #: Which upper bits a term's hash has: most words that are no terms end here.
        self.shift = np.uint64(64 - max(16, len(names).bit_length() + 5))
        self.known = np.zeros(1 << int(64 - self.shift), bool)
        self.known[self.hashes >> self.shift] = True

    def among(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and the place of each one's term."""
        first, last, h = marks(data, starts, ends)
        word = np.flatnonzero(self.known[h >> self.shift])
        first, last, h, starts, size = first[word], last[word], h[word], starts[word], (ends - starts)[word]
        at, held = np.searchsorted(self.hashes, h), [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for k in range(self.most):
            place = np.minimum(at + k, len(self.hashes) - 1)
            same = (at + k < len(self.hashes)) & (self.first[place] == first) & (self.last[place] == last) & (self.size[place] == size)
            for x in np.flatnonzero(same & (size > 2 * ENDS)).tolist():
                own = self.starts[place[x]]
                same[x] = np.array_equal(data[starts[x] : starts[x] + size[x]], self.data[own : own + size[x]])
            held.append((word[same], place[same]))
        return tuple(np.concatenate(c) for c in zip(*held))

    def found(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many words each text has; then, as text * number of terms + place, each text's terms and how often it has them."""
        data, at = _flat(column)
        starts, ends, text = bounds(data, at)
        word, place = self.among(data, starts, ends)
        keys, n = np.unique(text[word] * len(self.ids) + place, return_counts=True)
        return np.bincount(text, minlength=len(column)), keys, n


def parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about BYTES bytes of a column of texts, one row at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + BYTES, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def lists(text: np.ndarray, rows: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list of values for each text; text says in ascending order whose each value is."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(text, minlength=rows))], pa.int32()), pa.array(values)).cast(kind)


#: Bytes below 0x80 that are part of a word.
WORD = np.zeros(256, bool)
WORD[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"]] = True


def _wordy(piece: bytes, k: int) -> bool:
    c = piece.decode(errors="ignore")[k:][:1]
    return c.isalnum() or c == "_"


class Hints:
    """Finds which of some hints of two or more bytes a text has: single words as words, others (with a space or hyphen) as substrings.

    A table of three bytes tells where hints may begin; there up to eight bytes are compared as numbers, then what is left.
    """

    def __init__(self, hints: tuple[str, ...]):
        self.names, self.raw = pa.array(hints, pa.string()), [h.encode() for h in hints]
        self.alone = np.array([" " not in h and "-" not in h for h in hints], bool)
        self.size = np.fromiter(map(len, self.raw), np.int64, len(hints))
        begins = [h[:3] + bytes((x,)) * (len(h) < 3) for h in self.raw for x in range(1 if len(h) > 2 else 256)]
        self.may = np.zeros(1 << 16, bool)
        self.may[self._gram(np.frombuffer(b"".join(x + b"\0" for x in begins), "<u4"))] = True
        self.heads = [(n, int.from_bytes(h[:n], "little"), k) for k, h in enumerate(self.raw) for n in [min(len(h), ENDS)]]

    @staticmethod
    def _gram(four: np.ndarray) -> np.ndarray:
        return ((four & np.uint32(0xFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(16)

    def _candidates(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = np.zeros(len(data) + ENDS, np.uint8)
        held[: len(data)] = data
        at = np.flatnonzero(self.may[self._gram(np.ndarray(len(data), "<u4", held, strides=(1,)).copy())])
        eights, places, hints = np.ndarray(len(data), "<u8", held, strides=(1,))[at], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n in range(2, ENDS + 1):
            own = [(v, k) for m, v, k in self.heads if m == n]
            if not own:
                continue
            values = np.array(sorted({v for v, _ in own}), np.uint64)
            w = eights & MASK[n]
            some = np.flatnonzero(values[np.minimum(np.searchsorted(values, w), len(values) - 1)] == w)
            for v, k in own:
                found = at[some[w[some] == np.uint64(v)]]
                places.append(found)
                hints.append(np.full(len(found), k))
        return np.concatenate(places), np.concatenate(hints)

    def found(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of text and hint, in this order."""
        data, at = _flat(column)
        place, hint = self._candidates(data)
        text = np.searchsorted(at, place, "right") - 1
        end = place + self.size[hint]
        fit = end <= at[text + 1]
        first, last = place == at[text], end == at[text + 1]
        before, after = data[np.maximum(place - 1, 0)], data[np.minimum(end, len(data) - 1)] if len(data) else data
        alone = self.alone[hint]
        fit &= ~alone | ((first | ~WORD[before]) & (last | ~WORD[after]))
        look = fit & ((self.size[hint] > ENDS) | (alone & ((~first & (before >= 0x80)) | (~last & (after >= 0x80)))))
        for k in np.flatnonzero(look).tolist():
            p, e, t = int(place[k]), int(end[k]), int(text[k])
            fit[k] = data[p:e].tobytes() == self.raw[hint[k]] and not (alone[k] and (_wordy(data[max(p - 4, at[t]) : p].tobytes(), -1) or _wordy(data[e : min(e + 4, at[t + 1])].tobytes(), 0)))
        return np.divmod(np.unique(text[fit] * len(self.raw) + hint[fit]), len(self.raw))

    def among(self, column: pa.Array) -> pa.Array:
        """The hints of each text, null for null."""
        out = []
        for part in parts(pa.RecordBatch.from_arrays([column], names=["text"]), 0):
            own = part.column(0)
            text, hint = self.found(own)
            upto = np.r_[0, np.cumsum(np.bincount(text, minlength=len(own)))]
            out.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), self.names.take(pa.array(hint)), mask=own.is_null()))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))
