"""SimHash fingerprints, the links between them, and near-duplicate groups.

A fingerprint has 64 bits, each set where more than half of the hashes of a text's word shingles have it. Two link if
they differ in `radius` bits at most. To find all links, the bits are cut into six blocks: two fingerprints within
four bits agree on two blocks at least, so they meet under one of the fifteen pairs of blocks. Each such meeting place
is a shard with a BK-tree: a node's children are keyed by their Hamming distance from it, and a search follows only the
edges within the radius. A tree goes to the one task that needs it by the shuffle instead of a broadcast, as all trees
together grow with the data. Only the links that join sets are given out, so that a group of n has n - 1 links here,
not all pairs. Trees of many nodes are built and searched for many nodes at once; their leaves hold a few nodes each.

A shard with too many nodes for one task is dealt out anew: of the bits that its nodes needn't share, cut into radius + 1
strips, two linked nodes share one strip at least, and meet under it. That goes on until shards are small enough.

Equal fingerprints count as one node. Links then go through alternating star contraction to the smallest id.

Cases: null texts count as empty; empty texts have fingerprint zero and are linked like others; repeated rows share a
fingerprint; a null id gets its fingerprint and takes no part in groups (null component_id); an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import bounded_batches, map_texts, materialize, remove, shared_dir

SEED, RADIUS, WORDS = 42, 4, 4
#: First bit and width of each block.
BLOCKS = ((0, 10), (10, 10), (20, 11), (31, 11), (42, 11), (53, 11))
#: Nodes of a tree in plain Python, and of a leaf of a larger one.
TREE = 48
#: A larger shard is dealt out again by the bits its nodes needn't share, so many times at most.
SHARD, LEVELS = 20_000, 3


def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of words; bytes.lower and bytes.split know ASCII letters and white space alone."""
    w = text.encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([h(b" ".join(w), seed)], np.uint64)
    runs = zip(*(w[k:] for k in range(words)))
    return np.fromiter((h(b" ".join(r), seed) for r in runs), np.uint64, len(w) - words + 1)


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    hashes = shingle_hashes(text, words, seed)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[k : k + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """id, bits: the fingerprint of each whole text as a signed long."""

    def make():
        return lambda texts: [np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs, id_col, text_col, "bits long", make)


class Sets:
    """Disjoint sets of small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = a = self.up[self.up[a]]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


class Tree:
    """A BK-tree; children are keyed by the distance from their parent."""

    def __init__(self, radius: int):
        self.radius, self.nodes, self.children = radius, [], []

    def search_and_add(self, bits: int, name: int) -> list[int]:
        """Names within the radius; then the new node takes its place."""
        found = []
        if not self.nodes:
            self.nodes.append((bits, name))
            self.children.append({})
            return found
        todo, r = [0], self.radius
        while todo:
            at = todo.pop()
            d = (self.nodes[at][0] ^ bits).bit_count()
            if d <= r:
                found.append(self.nodes[at][1])
            children = self.children[at]
            if children:
                todo += [children[k] for k in range(max(1, d - r), d + r + 1) if k in children]
        at = 0
        while (d := (self.nodes[at][0] ^ bits).bit_count()) in self.children[at]:
            at = self.children[at][d]
        self.children[at][d] = len(self.nodes)
        self.nodes.append((bits, name))
        self.children.append({})
        return found


def shard_links(bits: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Positions of linked pairs that join all of a shard's linked members (a spanning forest)."""
    n, out = len(bits), []
    if n > TREE:
        return WideTree(bits, radius).links()
    tree, sets = Tree(radius), Sets(n)
    for k, b in enumerate(bits.tolist()):
        out += [(k, m) for m in tree.search_and_add(b, k) if sets.join(k, m)]
    return out


class WideTree:
    """A BK-tree in arrays: each step takes all nodes that are at one place of the tree together.

    A place is a pivot and its children by distance, or a leaf of a few nodes. Nodes of one child are searched against
    the child itself and against siblings whose key is within the radius of theirs.
    """

    def __init__(self, bits: np.ndarray, radius: int):
        self.bits, self.radius, self.up, self.found = bits.astype(np.uint64), radius, np.arange(len(bits)), []

    def links(self) -> list[tuple[int, int]]:
        todo = [np.arange(len(self.bits))]
        while todo:
            rows = todo.pop()
            if len(rows) <= TREE:
                self._compare(rows, rows)
                continue
            children = self._children(rows[0], rows[1:])
            self._join(np.full(sum(len(c) for d, c in children if d <= self.radius), rows[0]), np.concatenate([rows[:0], *(c for d, c in children if d <= self.radius)]))
            for k, (d, own) in enumerate(children):
                todo.append(own)
                for e, other in children[k + 1 :]:
                    if e - d > self.radius:
                        break
                    self._search(own, other)
        return self.found

    def _children(self, pivot: int, rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
        far = np.bitwise_count(self.bits[rows] ^ self.bits[pivot])
        order = np.argsort(far, kind="stable")
        far, rows = far[order], rows[order]
        cuts = np.flatnonzero(np.diff(far)) + 1
        return [(int(far[s]), rows[s:e]) for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]) if e > s]

    def _search(self, queries: np.ndarray, rows: np.ndarray) -> None:
        """Links of all queries to the nodes of one subtree."""
        todo = [(queries, rows)]
        while todo:
            queries, rows = todo.pop()
            if min(len(rows), len(queries)) <= TREE:
                self._compare(queries, rows)
                continue
            far = np.bitwise_count(self.bits[queries] ^ self.bits[rows[0]]).astype(np.int16)
            near = queries[far <= self.radius]
            self._join(near, np.full(len(near), rows[0]))
            for d, child in self._children(rows[0], rows[1:]):
                some = queries[np.abs(far - d) <= self.radius]
                if len(some):
                    todo.append((some, child))

    def _compare(self, a: np.ndarray, b: np.ndarray) -> None:
        """All of a against all of b, some rows at a time."""
        step = max(1, (1 << 20) // len(b))
        for s in range(0, len(a), step):
            i, j = np.nonzero(np.bitwise_count(self.bits[a[s : s + step], None] ^ self.bits[None, b]) <= self.radius)
            self._join(a[s : s + step][i], b[j])

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the sets of linked nodes: of each set's links to sets with smaller roots one is kept, until none is left."""
        while len(a):
            x, y = self.up[a], self.up[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            high, first = np.unique(np.maximum(x, y), return_index=True)
            self.up[high] = np.minimum(x, y)[first]
            self.found += zip(a[first].tolist(), b[first].tolist())
            while (self.up != (higher := self.up[self.up])).any():
                self.up = higher


def strips(free: int, parts: int) -> list[int]:
    """Masks of some bits in strips of about equal width."""
    at = [k for k in range(64) if free >> k & 1]
    cuts = [len(at) * k // parts for k in range(parts + 1)]
    return [sum(1 << k for k in at[s:e]) for s, e in zip(cuts, cuts[1:])]


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def shards(nodes: DataFrame, radius: int) -> DataFrame:
    """place, bits: each node at its meeting places, of which none has more than SHARD nodes as long as bits are left."""
    spark, b = nodes.sparkSession, F.col("bits")
    block = [F.shiftrightunsigned(b, lo).bitwiseAND(F.lit((1 << width) - 1)) for lo, width in BLOCKS]
    pairs = list(combinations(range(6), 2))
    places = [F.lit(k << 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j]) for k, (i, j) in enumerate(pairs)]
    placed = nodes.select(F.posexplode(F.array(*places)).alias("path", "place"), "bits")
    free = [(1 << 64) - 1 - sum(((1 << w) - 1) << lo for lo, w in (BLOCKS[i], BLOCKS[j])) for i, j in pairs]
    out = None
    for _ in range(LEVELS):
        hot = placed.groupBy("place").count().where(F.col("count") > SHARD).select("place")
        hot = materialize(hot, spark, "hotshards")
        if not hot.limit(1).count():
            break
        cold = placed.join(hot, "place", "left_anti").select("place", "bits")
        out = cold if out is None else out.union(cold)
        masks = [m for own in free for m in strips(own, radius + 1)]
        free = [own & ~m for own in free for m in strips(own, radius + 1)]
        table = F.array(*[F.lit(signed(m)) for m in masks])
        again = placed.join(hot, "place", "left_semi").select("path", "place", "bits", F.explode(F.sequence(F.lit(0), F.lit(radius))).alias("strip"))
        again = again.select((F.col("path") * (radius + 1) + F.col("strip")).alias("path"), "place", "bits")
        again = again.select("path", F.xxhash64("place", "path", b.bitwiseAND(F.get(table, F.col("path")))).alias("place"), "bits")
        placed = materialize(again, spark, "shards")
    placed = placed.select("place", "bits")
    return placed if out is None else out.union(placed)


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """low, high: linked fingerprints of distinct nodes (a column bits), enough of them to join all groups."""
    if radius > 4:
        raise ValueError("six blocks find all links up to four bits")
    bounded_batches(nodes.sparkSession)
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shards(nodes, radius).repartition(partitions, "place").sortWithinPartitions("place", "bits")
    kind = StructType().add("low", LongType()).add("high", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0

        def search(place: np.ndarray, bits: np.ndarray):
            cuts = np.flatnonzero(np.diff(place)) + 1
            begins, ends = np.r_[0, cuts], np.r_[cuts, len(place)]
            low, high = [], []
            for s, e in zip(begins[ends - begins > 1].tolist(), ends[ends - begins > 1].tolist()):
                own = bits[s:e]
                for a, c in shard_links(own.view(np.uint64), radius):
                    low.append(min(own[a], own[c]))
                    high.append(max(own[a], own[c]))
            return pa.RecordBatch.from_arrays([pa.array(np.array(low, np.int64)), pa.array(np.array(high, np.int64))], names=["low", "high"])

        for batch in batches:
            waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows < 50_000:
                continue
            place, bits = (np.concatenate(c) for c in zip(*waiting))
            cut = int(np.searchsorted(place, place[-1], "left"))
            if cut:
                yield search(place[:cut], bits[:cut])
            waiting, rows = [(place[cut:], bits[cut:])], 0
        if waiting:
            yield search(*(np.concatenate(c) for c in zip(*waiting)))

    return dealt.mapInArrow(run, kind).distinct()


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """node, root: the smallest node of each group of linked nodes, by alternating large-star and small-star rounds.

    Each round only needs minima of groups, which Spark sums up before it shuffles; rounds grow with the logarithm
    of a chain's length. Each round is written to the shared folder, and so are the minima, as Spark can then deal out
    the many links of one node over tasks. What no later round needs is deleted. edges: low, high.
    """

    def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
        path = shared_dir(spark, what)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    def sums(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(20,0)")), F.sum(F.hash("b", "a").cast("decimal(20,0)"))).first()

    e, at = written(edges.select(F.col("low").alias("a"), F.col("high").alias("b")).where("a < b"), "edges")
    old = sums(e)
    while old[0]:
        # Large star: each node's larger neighbours go to the smallest node of its neighbourhood.
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, minima = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "minima")
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        # Small star: each node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct()
        e, path = written(small, "edges")
        new = sums(e)
        remove(spark, at)
        remove(spark, minima)
        at, done, old = path, new == old, new
        if done:
            break
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """id, bits, component_id: the smallest id that a document reaches over links, itself included."""
    spark = docs.sparkSession
    prints = materialize(fingerprints(docs, id_col, text_col, words, seed).select(F.col(id_col).alias("id"), "bits"), spark, "prints")
    nodes = materialize(prints.where("id is not null").groupBy("bits").agg(F.min("id").alias("first")), spark, "nodes")
    found = components(links(nodes.select("bits"), radius), spark)
    # Written lists are joined, so that Spark can split what one root or one fingerprint has too much of.
    named = nodes.join(found.select(F.col("node").alias("bits"), "root"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    named = materialize(named, spark, "named")
    first = materialize(named.groupBy("root").agg(F.min("first").alias("component_id")), spark, "firsts")
    named = materialize(named.select("bits", "root").join(first, "root").select("bits", "component_id"), spark, "groups")
    out = prints.join(named, "bits", "left")
    return out.select(F.col("id").alias(id_col), "bits", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def sketch(text: str, seeds: tuple[int, ...]) -> list[int]:
    """SimHashes of the different words of a text, one for each seed. A few changed words move few bits of these."""
    words = list(set(text.encode().lower().split()))
    if not words:
        return [0] * len(seeds)
    base = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    out = []
    for seed in seeds:
        h = (base ^ (base >> np.uint64(33))) * np.uint64((2 * seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        ones = np.unpackbits((h ^ (h >> np.uint64(32))).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(words)).tobytes(), "big"))
    return out


def sketch_links(named: DataFrame, seeds: tuple[int, ...], radius: int = RADIUS) -> DataFrame:
    """low, high: ids that any of several SimHashes links, enough of them to join all its groups. named: id, bits array<long>."""
    edges = None
    for k in range(len(seeds)):
        own = named.select("id", F.col("bits")[k].alias("bits"))
        nodes = own.groupBy("bits").agg(F.min("id").alias("first"))
        ends = links(nodes, radius)
        for side in ("low", "high"):
            ends = ends.join(nodes.select(F.col("bits").alias(side), F.col("first").alias(f"{side}_id")), side)
        found = ends.select(F.least("low_id", "high_id").alias("low"), F.greatest("low_id", "high_id").alias("high"))
        equal = own.join(nodes, "bits").where("id <> first").select(F.col("first").alias("low"), F.col("id").alias("high"))
        found = found.union(equal)
        edges = found if edges is None else edges.union(found)
    return edges.distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: tuple[int, ...] = (1, 2, 3, 4), radius: int = RADIUS) -> DataFrame:
    """id, component_id over links of any of several SimHashes.

    Copies at a five-word similarity of 0.8 differ in about ten bits of one shingle SimHash, too many for any index of
    whole fingerprints; in four of different words nine in ten of them have one within four bits, unrelated texts none.
    """
    spark = docs.sparkSession

    def make():
        return lambda texts: [[np.array(sketch(t, seeds), np.uint64).view(np.int64) for t in texts]]

    prints = materialize(map_texts(docs, id_col, text_col, "bits array<long>", make).select(F.col(id_col).alias("id"), "bits"), spark, "sketches")
    edges = sketch_links(prints.where("id is not null"), seeds, radius)
    roots = components(edges, spark)
    out = prints.join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("root", "id").alias("component_id"))


def show(bits: str = "bits") -> F.Column:
    """Sixteen hex digits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
