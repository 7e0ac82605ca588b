"""A document quality classifier by attention-based multiple-instance learning.

A document is a bag of passages, of which only the bag has a label. Every passage of the whole text is encoded from what
stands in it: kinds of characters, words and their repeats, and hashed runs of characters; one figure more says how many
of its words earlier passages had. Gated attention (the product of a tanh and a sigmoid layer) gives each passage a
weight, learned from document labels alone, and the weighted sum of the encodings is scored. The weights show which
passages decided.

Learning uses a documented, bounded sample: `most_rows` labelled rows (the smallest by a hash of the id), and of each
`most_passages` evenly spaced ones at most. Scores and figures cover all rows and all passages.

Cases: null and empty texts have one empty passage and are scored like others; labels without a document, null
labels and null ids are not learned from; repeated labels count as their mean; of rows that repeat an id one is learned
from; without labels of both kinds the score is the share of good labels, or 1; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_texts

#: Words of a passage; learned rows and passages of each at most; dimensions of the encoding and of the attention.
PASSAGE, MOST_ROWS, MOST_PASSAGES, HIDDEN, GATE = 48, 6000, 32, 48, 24
THRESHOLD = 0.7

#: Kinds of characters: lower, upper, digit, space, line end, sentence marks, exclamation, bar, other marks, other.
CLASSES = 10
#: Buckets that runs of four characters are hashed to; figures of words.
GRAMS, RUN, FIGURES = 128, 4, 10
FEATURES = 2 * CLASSES + FIGURES + GRAMS


def _classes() -> np.ndarray:
    """The kind of each character of the first plane, by its own properties; those beyond are other."""
    table = np.full(0x10000, 9, np.uint8)
    for k in range(len(table)):
        c = chr(k)
        table[k] = 4 if c in "\r\n" else 3 if c.isspace() else 1 if c.isupper() else 0 if c.isalpha() else 2 if c.isdigit() else 5 if c in ".,;:?'\"()-" else 6 if c == "!" else 7 if c == "|" else 8 if c.isprintable() else 9
    return table


TABLE = _classes()


def encode(text: str) -> np.ndarray:
    """One row of features for each passage of the whole text."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kinds = np.where(points < len(TABLE), TABLE[np.minimum(points, len(TABLE) - 1)], 9)
    blank = (kinds == 3) | (kinds == 4)
    words = np.flatnonzero(~blank & np.r_[True, blank[:-1]]) if len(points) else np.empty(0, np.int64)
    if not len(words):
        out = np.zeros((1, FEATURES), np.float32)
        out[0, 2 * CLASSES + FIGURES - 1] = 1
        return out
    begins = words[::PASSAGE]
    if len(begins) > 1 and (len(words) - 1) % PASSAGE + 1 < PASSAGE // 3:
        begins = begins[:-1]  # a short rest goes with the passage before it
    ends = np.r_[begins[1:], len(points)]
    sizes, n = ends - begins, np.diff(np.searchsorted(words, np.r_[begins, len(points)]))
    out = np.zeros((len(begins), FEATURES), np.float32)
    # What is before the first word belongs to no passage.
    points, kinds, ends, begins = points[begins[0] :], kinds[begins[0] :], ends - begins[0], begins - begins[0]
    changes = np.r_[True, kinds[1:] != kinds[:-1]]
    passage = np.repeat(np.arange(len(begins)), sizes)
    count = lambda mask: np.bincount(passage[mask] * CLASSES + kinds[mask], minlength=len(begins) * CLASSES).reshape(-1, CLASSES)
    out[:, :CLASSES] = count(slice(None)) / sizes[:, None]
    out[:, CLASSES : 2 * CLASSES] = count(changes) / n[:, None]
    small = points | np.where(kinds == 1, np.uint32(32), np.uint32(0))
    if len(small) >= RUN:
        h = np.zeros(len(small) - RUN + 1, np.uint32)
        for k in range(RUN):
            h = (h ^ small[k : len(h) + k]) * np.uint32(0x01000193)
        bucket = (h ^ (h >> np.uint32(15))) % np.uint32(GRAMS)
        inside = passage[: len(h)] == passage[RUN - 1 :]
        out[:, -GRAMS:] = np.bincount((passage[: len(h)] * GRAMS + bucket)[inside], minlength=len(begins) * GRAMS).reshape(-1, GRAMS) / sizes[:, None] * 8
    seen: set[str] = set()
    whole = text[len(text) - len(points) :]
    for k, (s, e) in enumerate(zip(begins.tolist(), ends.tolist())):
        part = whole[s:e]
        own = part.split()
        kept, pairs = set(own), set(zip(own, own[1:]))
        row = out[k, 2 * CLASSES : 2 * CLASSES + FIGURES]
        row[0] = len(kept) / len(own)
        row[1] = sum(a == b for a, b in zip(own, own[1:])) / len(own)
        row[2] = len(kept & seen) / len(kept)
        row[3] = len(pairs) / len(own)
        row[4] = len(part) / len(own) / 10
        row[5] = min(max(map(len, own)) / 50, 4)
        row[6] = sum(w[-1] in ".!?" for w in own) / len(own) * 5
        row[7] = min(part.count("\n") / len(own) * 10, 3)
        raw = part.encode("utf-8", "replace")
        row[8] = min(len(zlib.compress(raw, 1)) / len(raw), 1.5)
        seen |= kept
    return out


class Model(NamedTuple):
    """Weights of the encoder, of the two gates and of the score, and what the features are scaled by."""

    mean: np.ndarray
    scale: np.ndarray
    enc: np.ndarray
    enc_b: np.ndarray
    gate_v: np.ndarray
    gate_u: np.ndarray
    gate_w: np.ndarray
    out: np.ndarray
    out_b: np.ndarray

    def to_json(self) -> str:
        return json.dumps([x.tolist() for x in self])

    @classmethod
    def from_json(cls, text: str) -> Model:
        return cls(*(np.array(x, np.float64) for x in json.loads(text)))


def forward(m: Model, x: np.ndarray, begins: np.ndarray):
    """Scores of bags whose passages begin at the given rows, with what the backward pass needs."""
    h = np.tanh((x - m.mean) / m.scale @ m.enc + m.enc_b)
    v, u = np.tanh(h @ m.gate_v), 1 / (1 + np.exp(-(h @ m.gate_u)))
    e = (v * u) @ m.gate_w
    sizes = np.diff(np.r_[begins, len(x)])
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, begins), sizes))
    a = e / np.repeat(np.add.reduceat(e, begins), sizes)
    z = np.add.reduceat(a[:, None] * h, begins, axis=0)
    return 1 / (1 + np.exp(-(z @ m.out + m.out_b[0]))), h, v, u, a, z, sizes


def backward(m: Model, x: np.ndarray, begins: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean logistic loss for all weights behind the scaling."""
    p, h, v, u, a, z, sizes = forward(m, x, begins)
    d = (p - y) / len(y)
    dz = np.repeat(d[:, None] * m.out, sizes, axis=0)
    da = (dz * h).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, begins), sizes))
    dv, du = de[:, None] * m.gate_w * u * (1 - v * v), de[:, None] * m.gate_w * v * u * (1 - u)
    dh = (a[:, None] * dz + dv @ m.gate_v.T + du @ m.gate_u.T) * (1 - h * h)
    return [((x - m.mean) / m.scale).T @ dh, dh.sum(0), h.T @ dv, h.T @ du, (v * u).T @ de, z.T @ d, np.array([d.sum()])]


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.004, seed: int = 7) -> Model:
    """Adam over small batches of bags; the same rows give the same weights."""
    rng, x = np.random.default_rng(seed), np.concatenate(bags)
    wide = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
    weights = [wide(FEATURES, HIDDEN), np.zeros(HIDDEN), wide(HIDDEN, GATE), wide(HIDDEN, GATE), rng.normal(0, 0.3, GATE), rng.normal(0, 0.1, HIDDEN), np.array([np.log(max(labels.mean(), 1e-3) / max(1 - labels.mean(), 1e-3))])]
    scaled = (x.mean(0), x.std(0) + 0.02)
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        order, pace = rng.permutation(len(bags)), rate * (1 - epoch / epochs)
        for s in range(0, len(order), batch):
            own = [bags[k] for k in order[s : s + batch]]
            begins = np.cumsum([0, *map(len, own[:-1])])
            step += 1
            for w, g, f, q in zip(weights, backward(Model(*scaled, *weights), np.concatenate(own), begins, labels[order[s : s + batch]]), first, second):
                g = g + 1e-4 * w
                f += 0.1 * (g - f)
                q += 0.01 * (g * g - q)
                w -= pace * (f / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-8)
    return Model(*scaled, *weights)


def remainder(id_col: str = "doc_id", parts: int = 4):
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def fit(docs: DataFrame, labels: DataFrame, held: int | None = 2, label: str = "quality", most_rows: int = MOST_ROWS, most_passages: int = MOST_PASSAGES, id_col: str = "doc_id", text_col: str = "text") -> Model | float:
    """Learns from labelled documents whose remainder isn't `held`, at most most_rows of them.

    Passages are encoded on the executors; the driver gets rows of numbers, whose count and size the two bounds limit.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.avg("y").alias("y"))
    if held is not None:
        known = known.where(remainder("id") != held)
    sample = known.orderBy(F.xxhash64("id"), "id").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("text").alias("text"))

    def make():
        def some(bag: np.ndarray) -> bytes:
            at = np.linspace(0, len(bag) - 1, min(len(bag), most_passages)).round().astype(int)
            return bag[at].astype(np.float16).tobytes()

        return lambda batch: [[some(encode(t)) for t in batch]]

    coded = map_texts(rows.withColumn("id", F.struct("id", "y")), "id", "text", "passages binary", make).collect()
    coded.sort(key=lambda r: (r.id.id, bytes(r.passages)))
    y = np.array([r.id.y for r in coded])
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 1.0
    return train([np.frombuffer(r.passages, np.float16).reshape(-1, FEATURES).astype(np.float64) for r in coded], y)


@lru_cache(4)
def unpacked(model: str | float) -> Model | float:
    return model if isinstance(model, float) else Model.from_json(model)


def scored(m: Model | float, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Score, number of passages and the passage with most weight of each text."""
    bags = [encode(t or "") for t in texts]
    sizes = np.array([len(b) for b in bags])
    if isinstance(m, float):
        return np.full(len(bags), m), sizes, [0] * len(bags)
    at = np.cumsum(sizes) - sizes
    p, *_, a, _, _ = forward(m, np.concatenate(bags).astype(np.float16).astype(np.float64), at)
    return p, sizes, [int(a[s : s + n].argmax()) for s, n in zip(at, sizes)]


def cut(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in parts of about so many characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def score(docs: DataFrame, model: Model | float, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted, n_passages, top_passage (the one with most weight) for each whole text."""
    packed = model if isinstance(model, float) else model.to_json()

    def make():
        def work(texts):
            found = [scored(unpacked(packed), part) for part in cut(texts)]
            p, sizes, top = (np.concatenate([np.empty(0), *(f[k] for f in found)]) for k in range(3))
            return [p, (p >= threshold).astype(int), sizes.astype(int), top.astype(int)]

        return work

    return map_texts(docs, id_col, text_col, "score double, predicted int, n_passages int, top_passage int", make)


def accepted(docs: DataFrame, model: Model | float, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores at the threshold or more, and those without an id. Texts don't leave their tasks."""
    packed = model if isinstance(model, float) else model.to_json()

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.empty(0), *(scored(unpacked(packed), part)[0] for part in cut(texts.to_pylist()))]) >= threshold)

    bounded_batches(docs.sparkSession)
    return docs.where(F.col(id_col).isNull() | good(F.col(text_col)))
