"""Registered queries on small tables with odd rows, against their SQL."""

import os
import random
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase import registry
from lorebase.registry import QUERIES
from lorebase.operators import answer, dense, generate, index, scan, sums


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def agrees(spark, folder, name, **tables):
    """Writes the tables and holds the query's rows against its SQL's."""
    with duckdb.connect() as c:
        for table, df in tables.items():
            df.repartition(2).write.parquet(f"{folder}/{table}.parquet")
            c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
        c.execute(f"SET temp_directory = '{os.fspath(folder)}'")
        want = Counter(c.execute(registry.ORACLE_SQL[name]).fetchall())
    got = rows(registry.QUERIES[name](spark, os.fspath(folder)))
    assert got == want
    return got


def test_answer_dedupe_counts_short_words_together(spark, tmp_path):
    said = ["To ed he of.", "a b.", "a b c d.", "ab", "a. b. c.", "Some words. Some words.", "", None]
    turns = spark.createDataFrame([(k, 0, "user", t) for k, t in enumerate(said)], "conv_id long, turn long, role string, text string")
    assert len(agrees(spark, tmp_path, "answer_dedupe", conversations=turns)) == 4


WORDS = ["red", "green", "blue", "lamp", "boat", "über", "灯", "x1"]


def documents(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(k, " ".join(rng.choices(WORDS, k=rng.randint(0, 12))), "en", f"src{k % 3}") for k in range(n)]
    # Copies, an id that comes twice, and no text.
    rows += [(n + k, "red lamp red boat", "en", "src0") for k in range(9)] + [(3, "blue blue lamp", "en", "src1"), (n + 20, None, "en", "src1"), (n + 21, "", "en", "src2")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))


@pytest.mark.parametrize("bounds", [{}, {"BLOCK": 2, "PAIRS": 3, "CELLS": 64, "MATRIX": 2}, {"FREQUENT": 2.0}])
def test_best_rows_by_sums_in_blocks(spark, tmp_path, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(sums, name, value)
    monkeypatch.setattr(index, "TERMS_SENT", 3 if "BLOCK" in bounds else 1000)
    items = spark.createDataFrame([(k, t) for k, t in enumerate(["red lamp", "boat über", "lamp, red!", "zzz", "blue green blue x1", "red", ""])], "item_id long, text string")
    assert agrees(spark, tmp_path, "bm25_topk", documents=documents(spark, 80), benchmark=items)


def test_titles_and_texts_are_found_in_one_pass(spark, tmp_path):
    items = spark.createDataFrame([(0, "red lamp"), (1, "boat über green")], "item_id long, text string")
    docs = documents(spark, 60).dropDuplicates(["doc_id"])
    assert agrees(spark, tmp_path, "keyword_topk", documents=docs, benchmark=items)


def test_parts_of_turns(spark, tmp_path):
    docs = documents(spark, 60).dropDuplicates(["doc_id"])
    turns = spark.createDataFrame([(k, t, "user" if t % 2 == 0 else "assistant", f"red lamp {WORDS[k % 8]}? boat {WORDS[t]}") for k in range(20) for t in range(4)], "conv_id long, turn long, role string, text string")
    assert agrees(spark, tmp_path, "part_references", documents=docs, conversations=turns)


def test_vector_search_holds_bounded_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = spark.createDataFrame([(k, [float(rng.randint(-3, 3)) for _ in range(4)]) for k in range(120)], "vec_id long, embedding array<float>").coalesce(1)
    whole = dense.search(rows, rows.where("vec_id % 10 = 0"), 7).collect()
    monkeypatch.setattr(dense, "CELLS", 50)
    assert sorted(dense.search(rows, rows.where("vec_id % 10 = 0"), 7).collect()) == sorted(whole)


def test_texts_of_chunks_stay_out_of_scans(spark, tmp_path, monkeypatch):
    seen = []
    write = scan.written
    monkeypatch.setattr(scan, "written", lambda df, what: seen.append(df.columns) or write(df, what))
    docs = documents(spark, 20).withColumn("text", F.concat("text", F.lit(" is a long enough sentence about the camera lens and 3 more things.")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["knowledge_base"](spark, str(tmp_path))
    assert out.count() > 0 and seen and not any("text" in columns for columns in seen)


def test_documents_without_units_stay(spark, tmp_path):
    said = [(0, "One! Two? x"), (1, ""), (2, " \n "), (3, None), (4, "a! b"), (4, "c; d"), (None, "n"), (None, ""), (5, "end of it!"), (6, "a! \x1c b\x1f"), (7, "\x1d")]
    docs = spark.createDataFrame([(k, t, "en", "src0", len(t or "")) for k, t in said], "doc_id long, text string, lang string, source string, n_chars long")
    assert len(agrees(spark, tmp_path, "sentence_units_sql", documents=docs)) == len(said)


@pytest.mark.parametrize("k", [1, 3, 40])
@pytest.mark.parametrize("bounds", [{}, {"CELLS": 600, "FREQUENT": 0.3}, {"FREQUENT": 2.0}, {"FREQUENT": 0.0, "FEW": 1}])
def test_best_of_postings_is_best_of_all_sums(monkeypatch, bounds, k):
    for name, value in bounds.items():
        monkeypatch.setattr(sums, name, value)
    rng = np.random.default_rng(k)
    # Rare and frequent terms; equal weights, so that sums tie; queries of frequent terms alone.
    share = np.r_[np.full(6, 0.6), np.full(30, 0.02)]
    queries = [sorted({*rng.integers(0, 6, 3).tolist(), *rng.integers(6, 36, rng.integers(0, 4)).tolist()}) for _ in range(60)] + [[0], [35], [0, 1, 2, 3, 4, 5], [*range(36)]]
    best, whole = sums.Best(sums.Block(np.arange(len(queries)) + 5, queries), k), []
    for chunk in (7, 500, 900, 64):
        weight = np.where(rng.random((chunk, 36)) < share, rng.integers(1, 5, (chunk, 36)) / 4, 0.0)
        row, term = rng.permutation(np.argwhere(weight)).T
        best.add(np.arange(chunk) * 2 + 10000 * len(whole), np.searchsorted(best.block.terms, term), row, weight[row, term])
        whole.append(weight)
    keys, weight = np.concatenate([np.arange(len(w)) * 2 + 10000 * i for i, w in enumerate(whole)]), np.concatenate(whole)
    for q, terms in enumerate(queries):
        all_ = weight[:, terms].sum(1)
        order = np.lexsort((keys, -all_))[:k]
        order = order[all_[order] > 0]
        assert best.scores[q][best.scores[q] > -np.inf].tolist() == all_[order].tolist() and best.keys[q, : len(order)].tolist() == keys[order].tolist()


def test_frequent_terms_are_not_added_up_for_all_rows():
    rng, n, each = np.random.default_rng(2), 1 << 14, 3000
    # Thirty words that half of the rows have, and a rare one for each query: a product of all pairs takes long.
    place = np.concatenate([np.full(n // 2, t) for t in range(30)] + [np.full(20, 30 + q) for q in range(each)])
    row = np.concatenate([rng.permutation(n)[: n // 2] for _ in range(30)] + [rng.permutation(n)[:20] for _ in range(each)])
    weight = np.r_[rng.random(15 * n) / 4, 3 + rng.random(20 * each)]
    best = sums.Best(sums.Block(np.arange(each), [[*range(30), 30 + q] for q in range(each)]), 3)
    seconds = time.process_time()
    best.add(np.arange(n), place, row, weight)
    assert time.process_time() - seconds < 2.5 and (best.scores > 3).all()


def test_answers_of_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sums, "ROWS", 16)
    docs = documents(spark, 60).dropDuplicates(["doc_id"])
    turns = spark.createDataFrame([(k, t, "user" if t % 2 == 0 else "assistant", f"red lamp {WORDS[k % 8]}? boat {WORDS[t]}") for k in range(20) for t in range(4)] + [(30, 0, "user", None), (31, 0, "user", "zzz?"), (32, 0, "user", "")], "conv_id long, turn long, role string, text string")
    assert len(agrees(spark, tmp_path, "part_answers", documents=docs, conversations=turns)) == 42


def test_extractive_answers_make_keys_once(spark):
    text = "Press the red lamp to open the boat. Press the red lamp to open the boat! The lamp is green and it stays so for a while. Red lamp of the boat goes out after a day."
    rows = spark.createDataFrame([(1, 1, "Red lamp", text, ["lamp", "red"], "how to open it"), (2, 1, "", text, [], "the boat"), (2, 2, "Lamp", "", [], "the boat")], "query_id long, evidence_rank int, title string, text string, terms array<string>, query string")
    made = answer.extractive(rows)
    # 121 when each step of the fold made the keys of what was said before.
    assert made._jdf.queryExecution().analyzed().toString().count("regexp_replace") < 100
    said = {r.query_id: r.answer for r in made.collect()}
    assert said[1].startswith("Press the red lamp to open the boat") and said[1].count("Press") == 1 and "stays so" in said[1] and "goes out" in said[2]


def test_visual_terms_has_all_four_lists(spark, tmp_path):
    said = ["The of red.Lamp-x 3.5 a b1", "lamp lamp LAMP of", "VR头显 ok 指示灯为什么一直在闪烁呢", "按键默认密码的注意事项", "甲乙丙丁戊己庚辛壬癸", "", None, "红灯亮 图片 设备 电池组安装屏幕按钮接口开关旋钮", "abcdefghijklm xy ab", "EOS100更换 的 什么 充电器", "x", "请按住红灯与蓝灯三秒后再看说明书上的标识", "1.2.3 4 55", "ab 一"]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(said * 3)] + [(3, "copy id", "en", "s", 7), (None, "no id at all", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    got = agrees(spark, tmp_path, "visual_terms", documents=docs)
    assert sum(r[4] not in (None, "") for r in got) > 20 and any("LAMP" in (r[4] or "") for r in got)
    own = docs.select(generate.visual_terms("text")["other_terms"].alias("a"), generate.further_terms("text").alias("b")).collect()
    assert all(r.a == r.b for r in own) and any(r.a for r in own)
