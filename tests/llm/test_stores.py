"""op4 and op8: what is written is read back whole."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

from lorebase.llm import idstore, warc
from lorebase.llm.common import local_path, shared_dir
from lorebase.llm.queries import ORACLE_SQL


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, bundle int, digest string")


def test_archive_round_trip(spark):
    rng = random.Random(1)
    texts = ["x" * 99, "é" * 50, "y" * 100, "\r\n\r\nWARC/1.1\r\n" * 20, "", *["".join(rng.choice("abc é\n") for _ in range(700)) for _ in range(5)]]
    rows = [(k, f"http://x/{k} \r\n", rng.choice(texts), 1, "z") for k in range(80)] + [(100, None, None, None, None), (None, "u", texts[-1], 1, "z"), (7, "u", texts[-1], 1, "z")]
    frame, folder = pages(spark, rows).repartition(3), shared_dir(spark, "t")
    index = warc.write(frame, folder, frame=2000, bundle=9000)
    assert index.count() == len(rows) and index.select("bundle", "frame").distinct().count() > 3
    got = sorted(((int(r.record_id) if r.record_id else None, r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to) if r.refers_to else None) for r in warc.read(spark, folder).collect()), key=str)
    data = [(i, (h or "").encode()) for i, _, h, *_ in rows]
    first = {}
    for i, b in data:
        if i is not None:
            first[b] = min(first.get(b, i), i)
    want = []
    for i, b in data:
        again = len(b) >= 100 and i is not None and first[b] != i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    assert got == sorted(want, key=str)
    some = warc.lookup(spark, folder, spark.createDataFrame([(5,), (79,), (100,), (4000,)], "page_id long")).collect()
    assert sorted(int(r.record_id) for r in some) == [5, 79, 100]
    assert all(r.payload.decode() == (dict((i, h) for i, _, h, *_ in rows)[int(r.record_id)] or "") for r in some if r.record_type == "response")


def test_bundle_is_plain_zstandard(spark):
    import zstandard

    folder = shared_dir(spark, "t")
    index = warc.write(pages(spark, [(1, "u", "hello", 1, "z")]), folder).collect()
    system, path = local_path(f"{folder}/bundles/{index[0].bundle}")
    raw = system.open_input_file(path).read()
    assert zstandard.ZstdDecompressor().decompressobj().decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: response")
    assert warc.write(pages(spark, []), shared_dir(spark, "t")).count() == 0


def test_archive_query_equals_sql(spark):
    from lorebase.llm.queries import op4_warc

    got = {tuple(r) for r in op4_warc(spark, "/root/testdata/sf0.001").collect()}
    con = duckdb.connect()
    con.sql("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    assert got == set(con.sql(ORACLE_SQL["op4_warc"]).fetchall())


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, start string, chunks int")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_store_round_trip(spark, library, monkeypatch):
    rng = random.Random(4)
    alphabet = "ab cde  \n\t\x1c!'.,s tre llve éüßñ日本語🙂　\x85\xa0012"
    long = " ".join(str(rng.random()) for _ in range(3000))
    rows = [(rng.randint(0, 500), "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))), "x", 1) for _ in range(60)]
    rows += [(1000, long, "x", 1), (1001, "new start " + long, "x", 1), (1002, long, "x", 1), (2, None, "x", 1), (None, "no id", "x", 1), (3, "a<|endoftext|>b", None, None), rows[0]]
    folder = shared_dir(spark, "t")
    idstore.write(docs(spark, rows).repartition(3), folder, P.path("byte_bpe_50k.json"))
    want = [(i, library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, *_ in rows]
    read = idstore.documents(spark, folder).collect()
    assert sorted((r.ids, -1 if r.id is None else r.id) for r in read) == sorted((ids, -1 if i is None else i) for i, ids in want)
    order = sorted(read, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0, *[len(r.ids) for r in order]])[:-1].tolist()
    assert [r.id for r in order] == sorted((r.id for r in order), key=lambda i: (i is not None, i))
    sums = {r.start: r for r in idstore.checksums(spark, folder).collect()}
    assert all((sums[r.start].n_tokens, sums[r.start].ids_crc32) == (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in read)
    stored = idstore.chunks(spark, folder).agg({"n": "sum"}).first()[0]
    assert stored < sum(len(ids) for _, ids in want) - len(library.encode(long).ids) * 1.5
    assert sum(r.n_docs for r in spark.read.parquet(f"{folder}/manifest").collect()) == len(rows)
    assert len(idstore.store_root(spark, folder)) == 32


def test_damage_is_found(spark):
    folder = shared_dir(spark, "t")
    idstore.write(docs(spark, [(1, "some words", "x", 1)]), folder, P.path("byte_bpe_50k.json"))
    pack = spark.read.parquet(f"{folder}/index").first()
    system, path = local_path(f"{folder}/packs/{pack.pack}")
    raw = bytearray(system.open_input_file(path).read())
    tool = __import__("zstandard").ZstdCompressor(level=3)
    other = idstore.packed(np.array([7] * 3, np.uint32), tool)
    raw[pack.start : pack.start + pack.length] = other.ljust(pack.length, b"\0")[: pack.length]
    with system.open_output_stream(path) as f:
        f.write(bytes(raw))
    with pytest.raises(Exception):  # noqa: B017
        idstore.checksums(spark, folder).collect()


def test_empty_store(spark):
    folder = shared_dir(spark, "t")
    idstore.write(docs(spark, []), folder, P.path("byte_bpe_50k.json"))
    assert idstore.checksums(spark, folder).count() == 0


def test_chunks_and_checksums():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 50000, 30000).astype(np.uint32), rng.integers(0, 50000, 777).astype(np.uint32)
    ends, later = idstore.chunk_ends(a), idstore.chunk_ends(np.concatenate([b, a]))
    assert ends[-1] == len(a) and max(np.diff([0, *ends])) <= idstore.MOST
    assert len({e + len(b) for e in ends} & set(later)) > len(ends) * 0.8
    x, y = a.tobytes(), b.tobytes()
    assert idstore.crc_append(zlib.crc32(x), zlib.crc32(y), len(y)) == zlib.crc32(x + y)
    for width in (a, a + np.uint32(1 << 20), a[:0]):
        assert (idstore.unpacked(idstore.packed(width, __import__("zstandard").ZstdCompressor())) == width).all()
