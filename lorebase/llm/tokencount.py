"""Token counts of whole texts by a piece model, in Arrow functions that return lengths only.

Long texts are cut at safe boundaries: no piece of the model has a word mark behind another character, so no merge
crosses from a word to the mark before the next one, and the counts of the parts add up. Batches hold about as many
bytes each, whatever the number of texts in them.

Cases: null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated results; an empty table gives an
empty result; extra columns are ignored; a null id stays null. Texts of any length are counted whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_texts

#: U+2581 is the model's word mark; a space becomes one.
MARK = "▁"
SEGMENT = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")
BOUNDARY = re.compile(f"(?<=[^ {MARK}])(?=[ {MARK}])")
#: Code points of one part of a long text, and of one batch for the library.
PART, BATCH = 1 << 16, 1 << 20
MEMO_ROWS, MEMO_CHARS = 400_000, 48


def parts(text: str, most: int = PART) -> Iterator[str]:
    """Cuts a text at safe boundaries into parts of about `most` code points; the model's own prefix is put first."""
    if not text:
        return
    text, start = " " + text, 0
    while len(text) - start > most:
        cut = BOUNDARY.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Counter:
    """Counts by whole words, each of which the library encodes once as long as it is remembered."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this model crosses a word's end: texts can't be cut")
        #: Tokens of a last space, behind which nothing follows.
        self.alone = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.memo: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        out, held, size = [0] * len(texts), [], 0
        for k, text in enumerate(texts):
            for part in parts(text):
                held.append((k, part))
                size += len(part)
                if size >= BATCH:
                    self._batch(held, out)
                    held, size = [], 0
        self._batch(held, out)
        return out

    def _batch(self, held: list[tuple[int, str]], out: list[int]) -> None:
        split = [(k, SEGMENT.findall(part)) for k, part in held]
        known = self.memo
        new = list({s for _, segments in split for s in segments if s not in known})
        # The model puts a mark before each text, which stands for a segment's first space.
        coded = self.model.encode([s[1:] for s in new], num_threads=1) if new else []
        fresh = {s: len(ids) if len(s) > 1 else self.alone for s, ids in zip(new, coded)}
        known.update(fresh)
        for k, segments in split:
            out[k] += sum(map(known.__getitem__, segments))
        if len(known) > MEMO_ROWS:
            known.clear()
        else:
            for s in fresh:
                if len(s) > MEMO_CHARS:
                    del known[s]


@lru_cache(2)
def counter(model: str) -> Counter:
    return Counter(model)


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each whole text."""

    def make():
        return lambda texts: [[len(t.encode()) for t in texts], n := counter(model).count(texts), [x > limit for x in n]]

    return map_texts(docs, id_col, text_col, "n_bytes long, n_tokens long, over_limit boolean", make)
