"""A content-addressed store of token ids.

Rolling hashes over the ids cut each document's stream into chunks, so that equal passages give equal chunks wherever
they stand. A chunk is named by its digest and stored once; a document is a recipe of digests, in ascending order of
ids, and Merkle roots over its chunks, over the documents of a shard and over the shards verify what is read.

Layout of a store: packs/*.pack (chunks, then a table of their digests), index (digest, pack, start, length, n), recipes
(one row for each document), manifest (one row for each shard).

Chunks never cross the network: encoding tasks write draft packs, a narrow shuffle of digests finds each chunk's owner,
and drafts are copied without what they don't own. All is written once, and tables name only whole files of tasks that
succeeded.

Cases: null texts count as empty and hold the end id alone; rows that repeat an id stand beside each other, ordered by
their roots; a null id comes first; an empty table gives an empty store and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import bounded_batches, by_bytes, local_path, remove, spread_files
from .segments import SPACE, ColumnMemo, begins, raw, runs, wide_before

#: Least, usual (as bits of the rolling hash) and most ids of a chunk; ids that the hash sees.
LEAST, BITS, MOST, WINDOW = 256, 10, 8192, 32
#: Bytes of a pack, about; bytes of a digest.
PACK, DIGEST = 32 << 20, 16
MAGIC = b"IDPACK01"
#: Bytes of new segments that one call of the library encodes, about; documents of a shard at most, about.
JOINED, SHARD = 1 << 18, 500_000
#: White space of ASCII as Python has it; letters, and characters that are neither letters nor white space, of ASCII.
BLANK, LETTER, MARK = SPACE.copy(), np.zeros(256, bool), np.zeros(256, bool)
BLANK[28:32] = True
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK[33:127] = ~LETTER[33:127]


def cuts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """First bytes of segments: those of `begins`, and ASCII digits and marks right behind a letter.

    Each match of the pattern of ByteLevel that holds a letter ends where the letters end, and none looks at what
    follows one; so words are the same segments whatever mark they stand before. Letters are those of ASCII and Latin-1.
    """
    cut = np.zeros(len(data), bool)
    cut[begins(data, texts)] = True
    at = np.flatnonzero(MARK[data[1:]] & ~MARK[data[:-1]]) + 1
    last, before = data[at - 1], data[np.maximum(at - 2, 0)]
    cut[at[LETTER[last] | (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)]] = True
    return np.flatnonzero(cut)


class Texts:
    """Encodes columns of texts with the library; segments that were met before are remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        rules = json.loads(self.library.to_str())
        first = rules["pre_tokenizer"] or {}
        #: Only for this way of cutting texts is a segment's encoding that of the whole text at its place.
        self.by_segment = rules["normalizer"] is None and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space")
        self.special = [t["content"] for t in rules["added_tokens"]]
        self.memo = ColumnMemo(self._segments, cuts)
        if self.by_segment:
            #: Bytes of each id: a token is written with one character for each byte.
            self.bytes_of = np.zeros(self.library.get_vocab_size(), np.int64)
            for token, i in self.library.get_vocab(with_added_tokens=False).items():
                self.bytes_of[i] = len(token)
            self.line_end = self._one("\n")[0]

    def _one(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _segments(self, segments: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes many segments as few texts and cuts the ids where the segments' bytes end.

        A segment that begins with white space keeps apart from the one before it; others are put behind a line end,
        whose id is taken out again. Segments that end with white space would take in what follows: these go alone.
        """
        data, at = raw(segments)
        starts, ends, n = at[:-1], at[1:], len(data)
        alone = BLANK[data[ends - 1]] | wide_before(data, ends)
        high = np.flatnonzero(data[starts] >= 0x80)
        alone[high] |= wide_before(data, np.minimum(starts[high] + 2, n)) | wide_before(data, np.minimum(starts[high] + 3, n))
        behind = ~SPACE[data[starts[~alone]]]
        joined = pc.binary_join_element_wise(pc.if_else(pa.array(behind), b"\n", b""), segments.filter(pa.array(~alone)), b"")
        data, at = raw(joined)
        parts, first = [(np.empty(0, np.uint32), np.empty(0, np.int64))], 0
        while first < len(behind):
            last = max(first + 1, int(np.searchsorted(at, at[first] + JOINED)))
            last = min(last, len(behind))
            parts.append(self._joined(data[at[first] : at[last]].tobytes().decode(), at[first + 1 : last + 1] - at[first], behind[first:last]))
            first = last
        for s in segments.filter(pa.array(alone)).to_pylist():
            own = np.array(self._one(s.decode()), np.uint32)
            parts.append((own, np.array([len(own)])))
        ids, sizes = (np.concatenate(x) for x in zip(*parts))
        if not alone.any():
            return ids, sizes
        place = np.empty(len(sizes), np.int64)
        place[np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])] = np.arange(len(sizes))
        return runs(ids, (np.cumsum(sizes) - sizes)[place], sizes[place])[0], sizes[place]

    def _joined(self, text: str, upto: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments joined to a text, and the number of each one's; upto: where they end in its bytes."""
        found = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        reached = np.cumsum(self.bytes_of[found])
        ends = np.searchsorted(reached, upto) + 1
        if (reached[ends - 1] != upto).any():
            raise ValueError("a token crosses from one segment to the next")
        starts = np.r_[0, ends[:-1]]
        if (found[starts[behind]] != self.line_end).any():
            raise ValueError("a line end was merged with the segment behind it")
        kept = np.ones(len(found), bool)
        kept[starts[behind]] = False
        return found[kept], ends - starts - behind

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column in a row, and where each text's begin (one more than texts)."""
        column = pc.fill_null(column, "")
        whole = np.full(len(column), not self.by_segment)
        for s in self.special:
            whole |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self.memo.encode(column)
        rest, at = self.memo.encode(pc.if_else(pa.array(whole), "", column))
        parts = [rest[s:e] for s, e in zip(at, at[1:])]
        for k in np.flatnonzero(whole).tolist():
            parts[k] = np.array(self._one(column[k].as_py()), np.uint32)
        return np.concatenate(parts), np.r_[0, np.cumsum([len(x) for x in parts])]


@lru_cache(2)
def texts_of(path: str) -> Texts:
    return Texts(path)


def rolling(ids: np.ndarray) -> np.ndarray:
    """At each id a sum of mixed ids of the window, shifted by their distance; made by doubling."""
    h = ids.astype(np.uint32) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    k = 1
    while k < WINDOW:
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h, k = more, 2 * k
    return h


def chunk_ends(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document: where the rolling hash says so, within the least and most lengths."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    marks = np.flatnonzero(rolling(ids) >> np.uint32(32 - BITS) == 0) + 1
    out, start = [], 0
    for m in [*marks.tolist(), n]:
        while m - start > MOST:
            start += MOST
            out.append(start)
        if m - start >= LEAST or m == n > start:
            start = m
            out.append(m)
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root over some digests; inner nodes are told from leaves by a first byte, an odd last node goes up as it is."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + level[k] + level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def packed(ids: np.ndarray, tool: zstandard.ZstdCompressor) -> bytes:
    """Low bytes, then high bytes: the latter hardly vary."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    planes = np.ascontiguousarray(ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes((width,)) + tool.compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype("<u4")


class Pack:
    """A file of chunks with a table at its end, written under a draft name."""

    def __init__(self, folder: str):
        self.system, top = local_path(folder)
        self.system.create_dir(top, recursive=True)
        self.name = f"{uuid.uuid4().hex}.pack"
        self.draft, self.final = os.path.join(top, f"{self.name}.part"), os.path.join(top, self.name)
        self.stream, self.size, self.table = self.system.open_output_stream(self.draft), len(MAGIC), []
        self.stream.write(MAGIC)

    def add(self, name: bytes, data: bytes, n: int) -> tuple[str, int, int]:
        self.stream.write(data)
        place = (self.name, self.size, len(data))
        self.table.append(name + struct.pack("<QII", self.size, len(data), n))
        self.size += len(data)
        return place

    def close(self) -> None:
        self.stream.write(b"".join(self.table) + struct.pack("<Q", len(self.table)) + MAGIC)
        self.stream.close()
        self.system.move(self.draft, self.final)


def pack_table(file) -> list[tuple[bytes, int, int, int]]:
    size, row = file.size(), DIGEST + 16
    file.seek(size - 16)
    tail = file.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("a pack without an end")
    n = struct.unpack("<Q", tail[:8])[0]
    file.seek(size - 16 - n * row)
    raw = file.read(n * row)
    return [(raw[k : k + DIGEST], *struct.unpack_from("<QII", raw, k + DIGEST)) for k in range(0, len(raw), row)]


CHUNK = "array<struct<digest:binary,n:int,pack:string,start:long,length:int>>"


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes whole texts, appends end_id to each and writes a store in `folder`."""
    spark = docs.sparkSession
    bounded_batches(spark)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = StructType().add("id", narrow.schema["id"].dataType).add("n_ids", "long").add("root", "binary").add("chunks", StructType.fromDDL(f"c {CHUNK}")["c"].dataType)
    arrow = to_arrow_schema(kind)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, pack, waiting, places = zstandard.ZstdCompressor(level=3), None, [], {}
        for batch in batches:
            for part in by_bytes(batch):
                every, at = texts_of(tokenizer).encode(part.column(1))
                every, at = np.insert(every.astype("<u4"), at[1:], end_id), at + np.arange(len(at))
                for i, first, last in zip(part.column(0).to_pylist(), at.tolist(), at[1:].tolist()):
                    ids, chunks, start = every[first:last], [], 0
                    for end in chunk_ends(ids):
                        raw = ids[start:end]
                        name = digest(raw.tobytes())
                        if name not in places:
                            pack = pack or Pack(f"{folder}/drafts")
                            places[name] = pack.add(name, packed(raw, tool), len(raw))
                        chunks.append((name, end - start, *places[name]))
                        start = end
                    waiting.append((i, len(ids), merkle([c[0] for c in chunks]), [dict(zip(("digest", "n", "pack", "start", "length"), c)) for c in chunks]))
                if pack and pack.size >= PACK:
                    pack.close()
                    yield _emit(waiting, arrow)
                    pack, waiting, places = None, [], {}
        if pack:
            pack.close()
        if waiting:
            yield _emit(waiting, arrow)

    narrow.mapInArrow(encode, kind).write.parquet(f"{folder}/drafts-index")
    drafts = spark.read.schema(kind).parquet(f"{folder}/drafts-index")

    # Each digest's owner is the first place that holds it; only places are shuffled, summed up before that.
    c = F.col("c")
    owners = drafts.select(F.explode("chunks").alias("c")).groupBy(c["digest"].alias("digest")).agg(F.min(F.struct(c["pack"], c["start"], c["length"], c["n"])).alias("p"))
    spread = owners.select("digest", "p.*").repartition("pack").sortWithinPartitions("pack", "start")
    place = StructType.fromDDL("digest binary, pack string, start long, length int, n int")
    shape = to_arrow_schema(place)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, source, at, waiting = None, None, None, []
        for batch in batches:
            for name, old, start, length, n in zip(*(batch.column(k).to_pylist() for k in ("digest", "pack", "start", "length", "n"))):
                if old != at:
                    if source:
                        source.close()
                    system, top = local_path(f"{folder}/drafts/{old}")
                    source, at = system.open_input_file(top), old
                pack = pack or Pack(f"{folder}/packs")
                source.seek(start)
                waiting.append((name, *pack.add(name, source.read(length), n), n))
                if pack.size >= PACK:
                    pack.close()
                    yield _emit(waiting, shape)
                    pack, waiting = None, []
        if source:
            source.close()
        if pack:
            pack.close()
            yield _emit(waiting, shape)

    spread.mapInArrow(copy, place).write.parquet(f"{folder}/index")
    remove(spark, f"{folder}/drafts")

    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-drafts.count() // SHARD))
    recipe = drafts.select("id", "n_ids", "root", F.transform("chunks", lambda x: F.struct(x["digest"].alias("digest"), x["n"].alias("n"))).alias("chunks"))
    recipe.repartitionByRange(shards, "id", "root").sortWithinPartitions("id", "root").withColumn("shard", F.spark_partition_id()).write.parquet(f"{folder}/recipes")
    remove(spark, f"{folder}/drafts-index")
    manifest(spark, folder).write.parquet(f"{folder}/manifest")


def recipes(spark: SparkSession, folder: str) -> DataFrame:
    """id, shard, start, n_ids, root, chunks. start: ids of all documents before.

    Each shard is a range of ids, so that a running sum within shards and one total for each shard are enough; what
    the driver sees is one row for each shard. The shards' roots are made anew from the recipes and must be those of
    the stored manifest, so that lost, changed or swapped recipes are found.
    """
    rows = spark.read.parquet(f"{folder}/recipes")
    stored, found = ({r.shard: (r.n_docs, r.n_ids, bytes(r.root)) for r in m.collect()} for m in (spark.read.parquet(f"{folder}/manifest"), manifest(spark, folder)))
    if stored != found:
        raise ValueError(f"shards {sorted(k for k in stored.keys() | found.keys() if stored.get(k) != found.get(k))} don't match the manifest")
    begins, total = [], 0
    for shard, (_, n, _) in sorted(found.items()):
        begins.append((shard, total))
        total += n
    before = F.broadcast(spark.createDataFrame(begins, "shard int, base long"))
    own = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("id", "root").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("upto", own).join(before, "shard").select("id", "shard", (F.col("base") + F.col("upto") - F.col("n_ids")).alias("start"), "n_ids", "root", "chunks")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """shard, n_docs, n_ids, root: the Merkle root over the documents' roots of each shard, in their order."""
    kind = StructType.fromDDL("shard int, n_docs long, n_ids long, root binary")
    shape = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, roots = None, 0, []
        for batch in batches:
            for shard, n_ids, root in zip(*(batch.column(k).to_pylist() for k in ("shard", "n_ids", "root"))):
                if shard != at:
                    if roots:
                        yield _emit([(at, len(roots), n, merkle(roots))], shape)
                    at, n, roots = shard, 0, []
                n += n_ids
                roots.append(root)
        if roots:
            yield _emit([(at, len(roots), n, merkle(roots))], shape)

    rows = spark.read.parquet(f"{folder}/recipes").select("shard", "id", "n_ids", "root")
    return rows.repartition("shard").sortWithinPartitions("shard", "id", "root").select("shard", "n_ids", "root").mapInArrow(run, kind)


def store_root(spark: SparkSession, folder: str) -> str:
    """The root over all shards; two stores with the same documents in the same shards have the same."""
    return merkle([bytes(r.root) for r in spark.read.parquet(f"{folder}/manifest").orderBy("shard").collect()]).hex()


def chunks(spark: SparkSession, folder: str, data: bool = False) -> DataFrame:
    """digest, n, crc, ids (with data): every stored chunk, read from its pack and held against its digest."""
    packs = spread_files(spark.read.parquet(f"{folder}/index").select("pack").distinct())
    kind = StructType.fromDDL("digest binary, n int, crc long, ids array<int>")
    shape = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, path = local_path(f"{folder}/packs/{name}")
                file, rows = system.open_input_file(path), []
                for key, start, length, n in pack_table(file):
                    file.seek(start)
                    raw = unpacked(file.read(length))
                    whole = raw.tobytes()
                    if digest(whole) != key or len(raw) != n:
                        raise ValueError(f"a chunk of {name} is damaged")
                    rows.append((key, n, zlib.crc32(whole), raw.astype(np.int32) if data else None))
                    if len(rows) >= 2000:
                        yield _emit(rows, shape)
                        rows = []
                file.close()
                if rows:
                    yield _emit(rows, shape)

    return packs.mapInArrow(run, kind)


@lru_cache(1)
def _shifts() -> list[list[int]]:
    """For each power of two, what a checksum's bits become when so many zero bytes follow."""
    def apply(m, v):
        out = 0
        while v:
            low = v & -v
            out ^= m[low.bit_length() - 1]
            v ^= low
        return out

    one = []
    for k in range(32):
        v = 1 << k
        for _ in range(8):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        one.append(v)
    out = [one]
    for _ in range(40):
        m = out[-1]
        out.append([apply(m, v) for v in m])
    return out


def crc_append(first: int, second: int, n: int) -> int:
    """The CRC-32 of two byte strings in a row from theirs; n: bytes of the second."""
    k, shifts = 0, _shifts()
    while n:
        if n & 1:
            m, v, first = shifts[k], first, 0
            while v:
                low = v & -v
                first ^= m[low.bit_length() - 1]
                v ^= low
        n >>= 1
        k += 1
    return first ^ second


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """id, start, n_tokens, ids_crc32 of each document, from the packs and recipes.

    Each stored chunk is read once; documents only need its checksum, so that copies of a chunk cost a narrow row. The
    recipe's root is made anew from the digests.
    """
    rows = recipes(spark, folder)
    c = F.col("c")
    parts = rows.select("start", F.posexplode("chunks").alias("k", "c")).select("start", "k", c["digest"].alias("digest"))
    # Spark takes the chunks for as small as the list of packs that they are read from; a merge never broadcasts them.
    seen = chunks(spark, folder).select("digest", "n", "crc")
    whole = parts.join(seen.hint("merge"), "digest").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("k", "digest", "n", "crc"))).alias("parts"))

    @F.pandas_udf("struct<n:long,crc:long,root:binary>")
    def fold(column):
        import pandas as pd

        out = []
        for parts in column:
            crc = n = 0
            for p in parts:
                crc, n = crc_append(crc, p["crc"], 4 * p["n"]), n + p["n"]
            out.append((n, crc, merkle([bytes(p["digest"]) for p in parts])))
        return pd.DataFrame(out, columns=["n", "crc", "root"])

    read = whole.withColumn("f", fold("parts")).select("start", "f")
    out = rows.select("id", "start", "n_ids", "root").join(read, "start", "left")
    return out.where(_right(F.col("f.n"), F.col("f.root"))).select("id", "start", F.col("f.n").alias("n_tokens"), F.col("f.crc").alias("ids_crc32"))


def _right(n, root):
    """True where what was read is what the recipe says; otherwise an error."""
    return F.coalesce((n == F.col("n_ids")) & (root == F.col("root")), F.lit(False)) | F.raise_error(F.lit("a recipe's chunks are missing or damaged")).cast("boolean")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """id, start, ids array<int>: the documents, put together again and held against their recipes."""
    rows = recipes(spark, folder)
    c = F.col("c")
    parts = rows.select("start", F.posexplode("chunks").alias("k", "c")).select("start", "k", c["digest"].alias("digest"))
    joined = parts.join(chunks(spark, folder, data=True).hint("merge"), "digest")
    whole = joined.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("k", "digest", "ids"))).alias("parts"))

    @F.pandas_udf("binary")
    def root(digests):
        return digests.map(lambda own: merkle([bytes(d) for d in own]))

    read = whole.select("start", F.flatten(F.col("parts.ids")).alias("ids"), root(F.col("parts.digest")).alias("found"))
    out = rows.select("id", "start", "n_ids", "root").join(read, "start", "left")
    return out.where(_right(F.size("ids"), F.col("found"))).select("id", "start", "ids")
