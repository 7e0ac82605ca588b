"""Near-duplicate groups by the exact similarity of texts.

Two texts link if their sets of five-word shingles have a Jaccard similarity of 0.8 at least. In any common order of all
shingles, sets of n shingles that link share one of the first n // 5 + 1 of each (the prefix), so pairs that meet under
a prefix shingle are all candidates there can be. Shingles that a sample finds in many texts come last in the order;
which ones it finds changes the cost and never the result.

Pairs are counted in two rounds. The first takes the links of several SimHashes and, under each prefix shingle,
neighbours by size in one of four orders. The second takes all other pairs whose texts the first left in different
groups, if enough of both is left from the shared shingle on. A pair within a group can't change it. So a large group of
copies costs about its size, not its square.

A pair is held against parity bits before whole sets are: each shingle flips one of about as many bits as its text has
shingles, so two texts' bits differ in no more places than their sets do. Pairs that differ in too many can't link, and
that leaves few pairs that need the sets.

Equal texts are one node: only ids and hashes of texts are shuffled to find them, and the first row of each goes on.
Shingles are compared by 64-bit hashes, texts by theirs. Lists of rows to leave out or to look at are written first, so
that Spark knows their sizes: it sends short ones to the texts and shuffles the texts only for long ones.

Cases: null texts count as empty; empty texts are equal to one another and to nothing else; rows with one id and other
texts are nodes of their own; repeated rows are one; rows without an id take no part; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import bounded_batches, map_texts, materialize
from .simhash import components, shingle_hashes, sketch, sketch_links

WORDS, SEEDS, RADIUS = 5, (1, 2), 4
#: Texts of the sample, the least number of them that makes a shingle frequent, and most frequent shingles sent out.
SAMPLE, OFTEN, MOST = 5_000, 5, 100_000


def shingle_set(text: str) -> np.ndarray:
    """Sorted hashes of the different shingles; a short text is one shingle."""
    return np.unique(shingle_hashes(text, WORDS)).view(np.int64)


def prefix(own: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles in the common order, one of which each linked text has in its prefix too. often: sorted."""
    if not len(own):
        return np.zeros(1, np.int64)
    if len(often):
        hot = often[np.minimum(np.searchsorted(often, own), len(often) - 1)] == own
        own = np.concatenate([own[~hot], own[hot]])
    return own[: len(own) // 5 + 1]


def parity(own: np.ndarray) -> np.ndarray:
    """Which bits an odd number of shingles flips; as many bits as there are shingles, rounded up to a power of two of words."""
    words = 1 << max(0, (len(own) - 1) // 64).bit_length()
    odd = np.bincount((own & (64 * words - 1)).astype(np.int64), minlength=64 * words).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def differences(x, y):
    """Bits in which two texts' parities differ. The longer one is folded, as its upper half stands for the same bits."""
    most = F.least(F.size(x), F.size(y))
    # Linked texts' sizes are within a quarter of each other, and so their words within a factor of two.
    fold = lambda p: F.when(F.size(p) == most, p).otherwise(F.zip_with(F.slice(p, F.lit(1), most), F.slice(p, most + 1, most), lambda i, j: i.bitwiseXOR(j)))
    return F.aggregate(F.zip_with(fold(x), fold(y), lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda n, k: n + k)


def frequent(texts: DataFrame, count: int) -> np.ndarray:
    """Shingles of many texts, by a sample chosen by the hashes of the texts. texts: v, text, each text once."""
    share = min(1.0, SAMPLE / max(1, count))
    some = texts.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(share * 1_000_000))
    sets = map_texts(some, "v", "text", "s array<long>", lambda: lambda t: [[shingle_set(x) for x in t]])
    counted = sets.select(F.explode("s").alias("h")).groupBy("h").count().where(F.col("count") >= OFTEN)
    return np.sort(np.array([r.h for r in counted.orderBy(F.desc("count"), "h").limit(MOST).collect()], np.int64))


def paired(postings: DataFrame, every: bool) -> DataFrame:
    """a, b: pairs under each shingle h whose sizes allow a link; neighbours alone, or all with different roots.

    postings: h, v, n, with place (of h in the text's order, from 0) and root for every. By size, a text's nearest
    neighbour is near enough if any is, so neighbours show each text that has a candidate at all.
    """
    spark = postings.sparkSession
    bounded_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings.repartition(partitions, "h").sortWithinPartitions("h", "n", F.xxhash64(F.pmod("h", F.lit(4)), "v"))

    def pairs(h: np.ndarray, v: np.ndarray, n: np.ndarray, place: np.ndarray | None = None, root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not every:
            near = (h[1:] == h[:-1]) & (5 * n[:-1] >= 4 * n[1:]) & (v[1:] != v[:-1])
            yield v[:-1][near], v[1:][near]
            return
        cuts = np.flatnonzero(np.diff(h)) + 1
        for s, e in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(h)].tolist()):
            if e - s < 2 or (root[s:e] == root[s]).all():
                continue
            ends = np.searchsorted(4 * n[s:e], 5 * n[s:e], "right") + s
            # Under the first shingle that both have, they share no more than what the shorter rest holds, and linked sets
            # share 4/9 of both sizes' sum; under later ones a link needs no second row.
            rest = n[s:e] - place[s:e]
            for k in range(s, e - 1):
                beyond = slice(k + 1, ends[k - s])
                enough = 9 * np.minimum(rest[k - s], rest[k + 1 - s : ends[k - s] - s]) >= 4 * (n[k] + n[beyond])
                other = v[beyond][enough & (root[beyond] != root[k])]
                if len(other):
                    yield np.full(len(other), v[k]), other

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * (5 if every else 3)

        def search(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            a, b, size = [], [], 0
            for x, y in pairs(*columns):
                a.append(np.minimum(x, y))
                b.append(np.maximum(x, y))
                size += len(x)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                    a, b, size = [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        waiting: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows < 100_000:
                continue
            held = [np.concatenate([x, *c]) for x, c in zip(held, zip(*waiting))]
            waiting, rows = [], 0
            cut = int(np.searchsorted(held[0], held[0][-1], "left"))
            if cut:
                yield from search([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if waiting:
            held = [np.concatenate([x, *c]) for x, c in zip(held, zip(*waiting))]
        if len(held[0]):
            yield from search(held)

    kind = StructType().add("a", LongType()).add("b", LongType())
    return dealt.select("h", "v", "n", *(["place", "root"] if every else [])).mapInArrow(run, kind).distinct()


def possible(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs whose parities allow a similarity of 0.8: sets of m and n differ in no more than (m + n) / 9. prints: v, n, odd."""
    side = lambda v, n, odd: prints.select(F.col("v").alias(v), F.col("n").alias(n), F.col("odd").alias(odd))
    both = pairs.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b").where("5 * m >= 4 * n and 5 * n >= 4 * m")
    return both.where(9 * differences(F.col("x"), F.col("y")) <= F.col("m") + F.col("n")).select("a", "b")


def verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, what: str) -> DataFrame:
    """Pairs at a similarity of 0.8 or more. rows: id, v, text; nodes: v, id of the first row with this text."""
    spark = rows.sparkSession
    # By first rows, so that one join alone meets the texts.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(nodes.select("v", "id"), "v")
    wanted = materialize(wanted, spark, f"wanted-{what}")
    sets = map_texts(rows.join(wanted, ["id", "v"], "left_semi"), "v", "text", "s array<long>", lambda: lambda t: [[shingle_set(x) for x in t]])
    if nodes.where("n > 1").limit(1).count():
        sets = sets.dropDuplicates(["v"])
    sets = materialize(sets, spark, f"sets-{what}")
    both = pairs.join(sets.select(F.col("v").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("v").alias("b"), F.col("s").alias("y")), "b")
    both = both.select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_intersect("x", "y")).alias("k"))
    return materialize(both.where("5L * k >= 4L * (m + n - k)").select("a", "b"), spark, f"links-{what}")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, v (xxhash64 of the text, null as empty), component_id: the smallest id of the group, for rows with an id."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("v"), text.alias("text"))
    rows = materialize(every.groupBy("id", "v").agg(F.count(F.lit(1)).alias("n")), spark, "rows")
    nodes = materialize(rows.groupBy("v").agg(F.min(F.struct("id", "n")).alias("first")).select("v", "first.*"), spark, "nodes")
    copies = materialize(rows.join(nodes.select("v", F.col("id").alias("first")), "v").where("id <> first").select("id", "v"), spark, "copies")
    texts = every.join(copies, ["id", "v"], "left_anti").select("v", "text")
    if nodes.where("n > 1").limit(1).count():
        texts = texts.dropDuplicates(["v"])
    often = spark.sparkContext.broadcast(frequent(texts, nodes.count()))

    def make():
        def work(part: list[str]) -> list[list]:
            sets = [shingle_set(t) for t in part]
            return [[np.array(sketch(t, SEEDS), np.uint64).view(np.int64) for t in part], [len(s) for s in sets], [prefix(s, often.value) for s in sets], [parity(s) for s in sets]]

        return work

    prints = materialize(map_texts(texts, "v", "text", "bits array<long>, n int, first array<long>, odd array<long>", make), spark, "prefixes")
    linked = sketch_links(prints.select(F.col("v").alias("id"), "bits"), SEEDS, RADIUS).select(F.col("low").alias("a"), F.col("high").alias("b"))
    near = paired(prints.select(F.explode("first").alias("h"), "v", "n"), False)
    tried = materialize(near.union(linked).distinct(), spark, "pairs")
    good = verified(materialize(possible(tried, prints), spark, "possible"), every, nodes, "first")
    roots = components(good.select(F.col("a").alias("low"), F.col("b").alias("high")), spark)
    # A text without any neighbour under its prefix has no other candidate either.
    wanted = materialize(tried.select(F.explode(F.array("a", "b")).alias("v")).distinct(), spark, "tried")
    left = prints.select("v", "n", "first").join(wanted, "v", "left_semi").join(roots.withColumnRenamed("node", "v"), "v", "left")
    rest = paired(left.select(F.posexplode("first").alias("place", "h"), "v", "n", F.coalesce("root", "v").alias("root")), True)
    rest = possible(rest.join(tried, ["a", "b"], "left_anti"), prints)
    more = verified(materialize(rest, spark, "rest"), every, nodes, "second")
    roots = components(good.union(more).select(F.col("a").alias("low"), F.col("b").alias("high")), spark)
    rooted = nodes.select("v", "id").join(roots.withColumnRenamed("node", "v"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.select("v", "root").join(least, "root").select("v", "component_id")
    return rows.select("id", "v").join(named, "v").select(F.col("id").alias(id_col), "v", "component_id")
