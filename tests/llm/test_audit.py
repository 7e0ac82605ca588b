"""The filters' audit: micro-batches that retract against plain Python, and the query against its SQL."""

import os
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from lorebase.llm import audit, queries

KIND = "doc_id long, text string, lang string, source string, n_chars long"
FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"w{k}" for k in range(250))


def write(spark, folder, files):
    for rows in files:
        spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], KIND).coalesce(1).write.mode("append").parquet(folder)
    return folder


def plain(rows, labels):
    """The contract by loops over rows."""
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))

    def fails(i, t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        return dict(A=len(words) < 200, B=100 * len(set(words)) < 50 * len(words), C=100 * len(re.findall("[A-Z]", t)) > 2 * len(t), D=bool(re.search("[#$%&*|]", t)), E=copy)

    out = {}
    looked = [(i, s or "", fails(i, t or "")) for i, t, s in rows]
    for part in {s for _, s, _ in looked}:
        shapley = Counter()
        own = [(i, f) for i, s, f in looked if s == part]
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[x]]
                left = [(i, f) for i, f in left if not f[x]]
                shapley[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f[x] for _, f in own) - len(gone), sum(f[x] and sum(f.values()) == 1 for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), x,
                ]
        for k, v in out.items():
            if k[0] == part:
                v[-1] = shapley[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def run(spark, path, labels, size=None):
    rows = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string") if labels else spark.createDataFrame([], "doc_id long, quality int, toxic int, text string")
    found = audit.audit(audit.counters(spark, path, rows, size)).collect()
    assert len(found) == len({(r.part, r.filter_order, r.step) for r in found})
    return {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in found}


def test_retractions(spark, tmp_path):
    files = [
        [(9, LONG, "a"), (8, "x", "b"), (7, LONG + " # A", "a"), (None, "x", "a")],
        [(5, LONG, "b"), (9, LONG, "b"), (8, "x", None), (8, "x", "b"), (3, None, "a")],
        [(4, LONG, None), (8, "y " * 300, "a"), (2, "", "b"), (1, "", ""), (1, "", "c"), (None, None, "c"), (6, "A" * 10, "b")],
        [(4, LONG, "a"), (10, LONG, "a"), (0, "x", "a")],
    ]
    labels = [(9, 1, 0, "t"), (9, 0, 1, "t"), (4, 1, None, "t"), (8, None, 1, "t"), (None, 1, 1, "t"), (77, 1, 1, "t")]
    want = plain([r for f in files for r in f], [x[:3] for x in labels])
    folder = write(spark, str(tmp_path / "d"), files)
    assert run(spark, folder, labels, 1) == want  # a file in each micro-batch
    assert run(spark, folder, labels) == want
    assert run(spark, write(spark, str(tmp_path / "e"), files[::-1]), labels, 1) == want


def test_empty(spark, tmp_path):
    assert run(spark, write(spark, str(tmp_path / "d"), [[]]), []) == {}


def test_bounded_folds(spark, tmp_path, monkeypatch):
    rows = [(k, f"text {k % 7}", f"s{k % 3}") for k in range(300)]
    monkeypatch.setattr(audit, "PER_BUCKET", 20)
    monkeypatch.setattr(audit, "FOLDED", 10)
    folder = write(spark, str(tmp_path / "d"), [rows[200:], rows[:100], rows[100:200]])
    assert run(spark, folder, [], 1) == plain(rows, [])


def test_query(spark):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(FOLDER, t)}.parquet'")
    want = c.execute(queries.ORACLE_SQL["op12_filter_audit"])
    columns = [d[0] for d in want.description]
    got = queries.op12_filter_audit(spark, FOLDER).collect()
    assert sorted(tuple(r[x] for x in columns) for r in got) == sorted(want.fetchall())


@pytest.mark.parametrize("path", ["/a/b.parquet", "/a/b/"])
def test_pattern(path):
    assert audit._pattern(path) in ("/a/b.parque[t]", "/a/[b]")
