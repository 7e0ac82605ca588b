"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each byte prefix of a piece of text there is exactly one token that can end its encoding: the one that, after the
last token of the prefix before it, would not have been merged otherwise. A table of these last tokens, one for each
prefix, gives the encoding by walking back from the end. Appending bytes only adds entries, and after an edit only
entries behind the edit are made again, until the walk meets the old boundary.

Cases: null texts count as empty and give no ids; an empty table gives an empty result; repeated rows give repeated
results; extra columns are ignored; a null id stays null.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_columns
from .segments import Memo, raw

#: Pieces and pairs of tokens that a worker remembers, and the longest piece; beyond that it starts anew, which costs time and changes nothing.
PIECES, PAIRS, PIECE_BYTES = 50_000, 150_000, 48


class Node(NamedTuple):
    """A beginning of tokens that the bytes read so far end in; ends: length and id of the tokens that end here, longest first."""

    text: bytes
    ends: list[tuple[int, int]]
    next: dict[int, Node]


class Ranks:
    """A vocabulary whose ids are merge ranks, prepared for the table of last tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.size = max(self.bytes_of, default=-1) + 1
        #: The two tokens that a token is merged from; a single byte has none.
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.known: dict[tuple[int, int], bool] = {}
        # A token that its own bytes do not merge to is only met as a whole piece.
        self.merged: dict[bytes, int] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.merged[token] = i
                continue
            two = self._merge_below(token, i)
            if len(two) == 2:
                self.merged[token] = i
                self.parts[i] = (two[0], two[1])
                self.pairs[two[0], two[1]] = i
        self.longest = max(map(len, self.merged), default=1)
        self._begins = {token[:k] for token in self.merged for k in range(len(token) + 1)}
        self._nodes: dict[bytes, Node] = {}
        self.root = self.node(b"")

    def node(self, text: bytes) -> Node:
        """The node of the longest end of text that begins a token."""
        while text not in self._begins:
            text = text[1:]
        if text not in self._nodes:
            ends = [(len(text) - k, self.merged[text[k:]]) for k in range(len(text)) if text[k:] in self.merged]
            self._nodes[text] = Node(text, ends, {})
        return self._nodes[text]

    def _merge_below(self, token: bytes, limit: int) -> list[int]:
        """Merges the bytes of a token by ranks under its own; the pair tables hold all of those."""
        ids = [self.ranks[token[k : k + 1]] for k in range(len(token))]
        while len(ids) > 1:
            best, at = limit, -1
            for k in range(len(ids) - 1):
                r = self.ranks.get(self.bytes_of[ids[k]] + self.bytes_of[ids[k + 1]])
                if r is not None and r < best:
                    best, at = r, k
            if at < 0:
                break
            ids[at : at + 2] = [best]
        return ids

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is just these two."""
        known = self.known.get((left, right))
        if known is None:
            if len(self.known) > PAIRS:
                self.known.clear()
            known = self.known[left, right] = self._stays_apart(left, right)
        return known

    def _stays_apart(self, left: int, right: int) -> bool:
        # Undo merges on both sides of the boundary, the latest first. At each step the two tokens that touch
        # the boundary must not have had a chance to merge before the later of them came to be.
        until = self.size + 1
        while True:
            if self.pairs.get((left, right), until) < until:
                return False
            if left in self.parts and (left > right or right not in self.parts):
                until, left = left, self.parts[left][1]
            elif right in self.parts:
                until, right = right + 1, self.parts[right][0]
            else:
                return True


class PrefixTable:
    """The last token of each prefix of one piece."""

    def __init__(self, ranks: Ranks, piece: bytes = b""):
        self.ranks, self.piece = ranks, b""
        self.last: list[int] = []  # the last token of the prefix of k + 1 bytes
        self.append(piece)

    def append(self, more: bytes) -> PrefixTable:
        """Exact for any appended bytes: no earlier entry depends on what comes later."""
        begin, self.piece = len(self.piece), self.piece + more
        self._fill(begin)
        return self

    def splice(self, start: int, end: int, new: bytes) -> PrefixTable:
        """Replaces the bytes from start to end; entries before start stay as they are.

        Behind the edit an entry depends on the entries of as many bytes as the longest token has; once that many
        in a row came out as before, the rest is taken over.
        """
        rest, old = self.piece[end:], self.last[end:]
        self.piece = self.piece[:start] + new + rest
        self.last = self.last[:start]
        edited = start + len(new)
        self._fill(start, edited)
        same = 0
        for k in range(len(rest)):
            self._fill(edited + k, edited + k + 1)
            same = same + 1 if self.last[-1] == old[k] and k + 1 > self._span(self.last[-1]) else 0
            if same >= self.ranks.longest:
                self.last += old[k + 1 :]
                break
        return self

    def _span(self, token: int) -> int:
        return len(self.ranks.bytes_of[token])

    def _fill(self, begin: int, end: int | None = None) -> None:
        last, ranks = self.last, self.ranks
        known, fits = ranks.known, ranks.fits
        node = ranks.node(self.piece[max(0, begin - ranks.longest) : begin])
        for k, byte in enumerate(self.piece[begin:end], begin):
            step = node.next.get(byte)
            if step is None:
                step = node.next[byte] = ranks.node(node.text + bytes((byte,)))
            node = step
            for n, token in node.ends:
                if n > k:
                    last.append(token)
                    break
                pair = last[k - n], token
                if known[pair] if pair in known else fits(*pair):
                    last.append(token)
                    break

    def ids(self) -> list[int]:
        """Walks back from the end."""
        out, k = [], len(self.piece)
        while k:
            out.append(self.last[k - 1])
            k -= len(self.ranks.bytes_of[out[-1]])
        return out[::-1]


class Encoder:
    """Encodes texts: distinct segments, then matches of the pattern, then the table of each match."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces = Ranks(ranks), regex.compile(pattern)
        self.memo = Memo(self._segments)
        self.by_piece: dict[bytes, list[int]] = {}
        self.tokens = pa.array([self.ranks.bytes_of.get(k, b"") for k in range(self.ranks.size)], pa.binary())

    def piece(self, data: bytes) -> list[int]:
        """A piece that is itself a token is that token, as in the library."""
        known = self.by_piece.get(data)
        if known is None:
            whole = self.ranks.ranks.get(data)
            known = [whole] if whole is not None else PrefixTable(self.ranks, data).ids()
            if len(data) <= PIECE_BYTES:
                if len(self.by_piece) >= PIECES:
                    self.by_piece.clear()
                self.by_piece[data] = known
        return known

    def _segments(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes, piece, find = [], [], self.piece, self.pieces.findall
        for s in segments:
            before = len(ids)
            if s[1:].isalpha() and s[0] == 32:
                ids += piece(s)  # a space and ASCII letters: one match
            else:
                for p in find(s.decode()):
                    ids += piece(p.encode())
            sizes.append(len(ids) - before)
        return np.array(ids, np.uint32), np.array(sizes, np.int64)

    def encode_column(self, column: pa.Array) -> pa.ListArray:
        """The ids of each text of a column."""
        ids, texts = self.memo.encode(column)
        return pa.ListArray.from_arrays(pa.array(texts, pa.int32()), pa.array(ids.view(np.int32)))

    def decode_column(self, ids: pa.ListArray) -> pa.BinaryArray:
        """The bytes of each list of ids."""
        flat, texts = ids.flatten(), np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())]
        taken = self.tokens.take(flat)
        at = np.frombuffer(taken.buffers()[1], np.int32)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int32)
        data = taken.buffers()[2] if len(taken) else pa.py_buffer(b"")
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at[texts].astype(np.int32)), data])

    def encode(self, text: str) -> list[int]:
        return self.encode_column(pa.array([text]))[0].as_py()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.ranks.bytes_of.__getitem__, ids))


@lru_cache(4)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>: the encoding of each whole text."""
    return map_columns(docs, id_col, text_col, "ids array<int>", lambda: lambda texts: [encoder(ranks, pattern).encode_column(texts)])


def unchanged(decoded: pa.BinaryArray, texts: pa.Array) -> np.ndarray:
    """Whether the bytes of each row are those of its text."""
    (a, at), (b, of) = raw(decoded), raw(texts)
    if len(at) == len(of) and (at == of).all() and np.array_equal(a, b):
        return np.ones(len(texts), bool)
    return np.fromiter((x == y.encode() for x, y in zip(decoded.to_pylist(), texts.to_pylist())), bool, len(texts))


def encode_checked(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>, n_tokens, lossless: encodes each whole text, decodes the ids and compares."""

    def make():
        codec = encoder(ranks, pattern)

        def work(texts):
            ids = codec.encode_column(texts)
            return [ids, pc.list_value_length(ids), unchanged(codec.decode_column(ids), texts)]

        return work

    return map_columns(docs, id_col, text_col, "ids array<int>, n_tokens long, lossless boolean", make)


def decode(encoded: DataFrame, ranks: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the decoded bytes of an ids column; null ids give null."""
    bounded_batches(encoded.sparkSession)

    @F.pandas_udf("binary")
    def run(ids):
        codec = encoder(ranks, pattern)
        return ids.map(lambda x: None if x is None else codec.decode(x.tolist()))

    return encoded.withColumn(out, run(F.col(ids_col)))


def sha256_of(rows: pa.Array) -> list[str]:
    """Lowercase hex digests of texts or bytes, read where they are."""
    data, at = raw(rows)
    view, sha = memoryview(np.ascontiguousarray(data)), hashlib.sha256
    return [sha(view[s:e]).hexdigest() for s, e in zip(at[:-1].tolist(), at[1:].tolist())]


def roundtrip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, lossless: encodes each whole text and decodes the ids.

    Ids of a text live in the worker only; what leaves it are digests.
    """

    def make():
        codec = encoder(ranks, pattern)
        decimal = pa.array([str(k) for k in range(codec.ranks.size)])

        def work(texts):
            ids = codec.encode_column(texts)
            decoded = codec.decode_column(ids)
            listed = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, decimal.take(ids.values)), ",")
            return [pc.list_value_length(ids), sha256_of(listed), sha256_of(decoded), unchanged(decoded, texts)]

        return work

    return map_columns(docs, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean", make)
