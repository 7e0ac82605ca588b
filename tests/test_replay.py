"""Logs of answers: the last record of an id, broken lines, answers made ready, figures counted while writing."""

import json

from pyspark.sql import functions as F

from lorebase.operators import submission
from lorebase.sources import replay


def write(folder, lines):
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines), encoding="utf-8")
    return str(folder)


LINES = [
    {"id": "1", "at": 2, "question": "电池", "answer": "结论：把电池插入底座，直到发出咔嗒声为止。", "image_ids": ["p"], "more": 1},
    {"id": "1", "at": 1, "question": "电池", "answer": "alt"}, "", "no json", '{"id": "2", "at":', {"at": 5, "answer": "no id"},
    {"id": "3", "at": 1, "question": "退货运费", "answer": "根据现有资料无法回答此问题。"}, {"id": "4", "answer": None}, {"id": "4", "at": 0, "question": "电池", "answer": "把电池完全充满以后，再第一次使用这台机器"},
    {"id": "5", "at": 1, "question": "x", "answer": "x"}, {"id": "5", "at": 1, "question": "x", "answer": "x"},
]


def test_last_records_and_figures(spark, tmp_path):
    log = replay.read(spark, write(tmp_path / "in", LINES))
    got = {r.id: (r.at, r.n_records) for r in log.answers.collect()}
    assert got == {"1": (2, 2), "3": (1, 1), "4": (0, 2), "5": (1, 2)}
    assert sorted(r.value for r in log.broken.collect()) == sorted(["no json", '{"id": "2", "at":', json.dumps(LINES[5])])
    stated = spark.createDataFrame([("5", "stated"), ("9", "nobody asked")], "id string, override string")
    rows = replay.renewed(log.answers, stated, F.lit("模板"))
    assert {r.id: r.ret for r in rows.collect()} == {"1": '"把电池插入底座，直到发出咔嗒声为止<PIC>。";["p"]', "3": "模板", "4": "把电池完全充满以后，再第一次使用这台机器。", "5": "stated"}
    figures = replay.write(rows, str(tmp_path / "out"))
    assert figures == submission.reprocess_statistics(rows).first().asDict() == {"total": 4, "with_images": 1, "with_pic": 1, "cs_specific": 1, "cs_template": 1, "refusal_cleaned": 1}
    back = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(str(tmp_path / "out"))
    assert {r.id: r.ret for r in back.collect()}["1"] == '"把电池插入底座，直到发出咔嗒声为止<PIC>。";["p"]'
    plain = {r.id: r.ret for r in replay.renewed(log.answers).collect()}
    assert plain["3"] == submission.SERVICE_ANSWER and plain["4"].endswith("这台机器。")


def test_nothing_stored(spark, tmp_path):
    log = replay.read(spark, write(tmp_path / "in", [""]))
    assert replay.renewed(log.answers).collect() == log.broken.collect() == []
