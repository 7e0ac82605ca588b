"""Dense retrieval: exact inner products over vectors, and an embedder that needs no model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .index import top

#: Query vectors that one pass over the corpus carries, and cosines that a task holds at once.
BLOCK, CELLS = 4096, 1 << 20


def search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, key, cosine, rank: the k nearest of all vectors for each query, exactly.

    Queries go out in blocks of bounded size; a task keeps k rows of its own for each query, so that what is shuffled
    is k rows for each query and task.
    """
    kind = StructType().add("query_id", queries.schema[key].dataType).add("near_id", vectors.schema[key].dataType).add("cosine", "double")
    arrow = to_arrow_schema(kind)
    n = queries.count()
    blocks = max(1, -(-n // block))
    tagged = queries.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("b"))
    out = None
    for b in range(blocks):
        rows = sorted(tagged.where(F.col("b") == b).collect())
        ids = [r.id for r in rows]
        q = np.array([r.v for r in rows], np.float64).reshape(len(rows), -1)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            best, step = None, max(1, CELLS // max(1, len(ids)))
            for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
                own, values = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                if not len(own) or not len(ids):
                    continue
                x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
                near = np.round(q @ x.T, 6) + 0.0
                names = np.broadcast_to(own, near.shape)
                if best is not None:
                    near, names = np.hstack([best[0], near]), np.hstack([best[1], names])
                order = np.lexsort((names, -near), axis=1)[:, :k]
                best = np.take_along_axis(near, order, 1), np.take_along_axis(names, order, 1)
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best[0].shape[1]), arrow.types[0]), pa.array(best[1].ravel(), arrow.types[1]), pa.array(best[0].ravel())], schema=arrow)

        found = vectors.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, kind)
        out = found if out is None else out.unionByName(found)
    return top(out, "query_id", [F.col("cosine").desc(), F.col("near_id")], k)


def hashing_embedder(c: Column | str, size: int = 256) -> Column:
    """Unit vectors of hashed words and their parts; the default where no model is at hand."""
    import zlib

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            v = np.zeros(size, np.float32)
            for w in (text or "").lower().split():
                for g in [w, *(w[k : k + 3] for k in range(len(w) - 2))]:
                    h = zlib.crc32(g.encode())
                    v[h % size] += 1 if h >> 31 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).tolist()

        return texts.map(one)

    return run(F.col(c) if isinstance(c, str) else c)


def embed(chunks: DataFrame, text: str = "text", model=None) -> DataFrame:
    """V6: adds `embedding`. model: makes, once for each worker, a function of a list of texts."""
    if model is None:
        return chunks.withColumn("embedding", hashing_embedder(text))

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for p in parts:
            yield pd.Series([list(map(float, v)) for k in range(0, len(p), 64) for v in encode(p.iloc[k : k + 64].tolist())])

    return chunks.withColumn("embedding", run(F.col(text)))
