"""Sources, sinks, the build, ranking, fusion and streams."""

import json

import pytest
from pyspark.sql import functions as F

from lorebase.operators import answer, dense, dialog, evaluate, fuse, generate, ingest, rank
from lorebase.sources import manuals, sinks
from lorebase.streaming import sessions


@pytest.fixture()
def raw(tmp_path):
    (tmp_path / "电钻手册.txt").write_text('["# A\\n<PIC>1. Open it\\n2. Close it", ["i1"]]', encoding="utf-8")
    (tmp_path / "b.txt").write_text("['text <PIC>', ['i2', 'i3']]", encoding="utf-8")
    (tmp_path / "c.txt").write_text('["a "quoted" word <PIC><PIC>", ["i4"]]', encoding="utf-8")
    (tmp_path / "d.txt").write_text("no list at all", encoding="utf-8")
    (tmp_path / "e.txt").write_text('{"text": 1}', encoding="utf-8")
    return str(tmp_path)


def test_manuals(spark, raw):
    rows = {r.manual_id: r for r in manuals.scan(spark, raw).collect()}
    assert {k: r.parse_mode for k, r in rows.items()} == {"电钻手册": "json", "b": "literal", "c": "tail-recovery", "d": "failed", "e": "failed"}
    assert rows["电钻手册"].product_name == "电钻" and rows["电钻手册"].pic_count == 1
    assert rows["b"].image_ids == ["i2", "i3"] and rows["c"].image_ids == ["i4"] and '"quoted"' in rows["c"].text
    good, bad = manuals.quarantine(manuals.scan(spark, raw))
    assert good.count() == 3 and bad.count() == 2
    bound = {(r.manual_id, r.pos): r.image_id for r in ingest.bind_pictures(good).collect()}
    assert bound == {("电钻手册", 0): "i1", ("b", 0): "i2", ("c", 0): "i4", ("c", 1): None}
    mismatch = {r.manual_id: (r.unmatched_pic_count, r.extra_image_count) for r in ingest.picture_mismatch(good).collect()}
    assert mismatch == {"b": (0, 1), "c": (1, 0)}
    chunk = [r for r in ingest.chunk_manuals(good).collect() if r.manual_id == "电钻手册"]
    assert chunk[0].image_ids == ["i1"] and chunk[0].metadata.is_procedure and chunk[0].chunk_index == 0


def test_small_sources(spark, tmp_path):
    (tmp_path / "q.csv").write_text("﻿id,question\n2,b\n10,c\n1,\"a, x\"\n", encoding="utf-8")
    assert [r.question for r in manuals.questions_csv(spark, str(tmp_path / "q.csv"), 2).collect()] == ["a, x", "b"]
    (tmp_path / "bad.csv").write_text("no,question\n1,a\n")
    with pytest.raises(ValueError):
        manuals.questions_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "q.txt").write_text("# no\n\n one \n")
    assert [r.question for r in manuals.question_lines(spark, str(tmp_path / "q.txt")).collect()] == ["one"]
    rows = spark.createDataFrame([("data:image/png;base64,aGk=",), ("aGk=",), ("!!",)], "x string").select(manuals.encoded_picture("x").alias("b")).collect()
    assert [r.b and bytes(r.b) for r in rows] == [b"hi", b"hi", None]
    (tmp_path / "f.json").write_text(json.dumps([{"id": "a"}, {"id": "b"}]))
    assert manuals.fixture(spark, str(tmp_path / "f.json"), "id string").count() == 2
    for name in ("a.png", "a.jpg", "b.JPEG", "c.txt"):
        (tmp_path / "p").mkdir(exist_ok=True)
        (tmp_path / "p" / name).write_bytes(b"x")
    assert {r.image_id: r.file_name for r in manuals.pictures(spark, str(tmp_path / "p")).collect()} == {"a": "a.png", "b": "b.JPEG"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, "b")], "id int, ret string")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    sinks.write_jsonl(df, str(tmp_path / "j"), "append")
    assert manuals.chunks_jsonl(spark, str(tmp_path / "j"), "id int, ret string").count() == 4
    sinks.write_answers_csv(df.coalesce(1), str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("*.csv")).read_text(encoding="utf-8").startswith("﻿id,ret")
    sinks.write_tables({"t": df}, str(tmp_path / "t"), {"t": "id"})
    with pytest.raises(ValueError):
        sinks.write_tables({"t": df.union(df)}, str(tmp_path / "t"), {"t": "id"})


CHUNK = "chunk_id string, title string, chunk_text string, product_name string, image_ids array<string>, is_toc boolean, has_ocr_noise boolean, semantic_type string, domain_label string, clean_score double, is_warning_only boolean, fts_hit int, fts_rank double"


def scores(spark, question, rows):
    q = rank.with_intents(generate.analyze(spark.createDataFrame([(1, question)], "query_id int, query_text string"), "query_text"))
    base = dict(title="", chunk_text="", product_name="", image_ids=[], is_toc=False, has_ocr_noise=False, semantic_type="general", domain_label="", clean_score=1.0, is_warning_only=False, fts_hit=0, fts_rank=None)
    names = [x.split()[0] for x in CHUNK.split(", ")]
    chunks = spark.createDataFrame([tuple({**base, **r, "chunk_id": k}[n] for n in names) for k, r in rows.items()], CHUNK)
    return {r.chunk_id: r for r in rank.score(rank.with_norms(chunks).crossJoin(q)).collect()}


@pytest.mark.parametrize(
    "question, better, worse",
    [
        ("电钻指示灯闪烁", dict(title="指示灯", product_name="电钻"), dict(title="其他", chunk_text="指示灯", product_name="电钻")),
        ("电钻怎么充电", dict(title="充电", product_name="电钻"), dict(title="充电", product_name="相机")),
        ("how to replace brake lever", dict(title="Brake lever", semantic_type="procedure"), dict(title="Brake lever", semantic_type="safety_warning")),
        ("DCB107 充电", dict(title="DCB107 充电"), dict(title="充电", chunk_text="DCB107")),
        ("充电", dict(title="充电"), dict(title="充电", is_toc=True)),
        ("充电", dict(title="充电", fts_hit=1, fts_rank=-0.1), dict(title="充电", fts_hit=1, fts_rank=-50.0)),
    ],
)
def test_relative_scores(spark, question, better, worse):
    got = scores(spark, question, {"a": better, "b": worse})
    assert got["a"].score > got["b"].score


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, chunk_id string, rank int")
    one, two = ({r.chunk_id: r.rrf_score for r in fuse.rrf(x).collect()} for x in ([a, b], [b, a]))
    assert one == two and max(one, key=one.get) == "y"
    assert [r.chunk_id for r in fuse.hybrid(a, b.limit(0), 2).orderBy("rrf_rank").collect()] == ["x", "y"]
    rows = spark.createDataFrame([(1, 0, 0, "x", 5.0), (1, 1, 3, "x", 6.0), (1, 1, 0, "y", 5.0)], "query_id int, variant_no int, rank int, chunk_id string, score double")
    got = {r.chunk_id: (r.fusion_score, r.variant_hits, r.score) for r in fuse.fuse_variants(rows).collect()}
    assert got == {"x": (10.05, 2, 6.0), "y": (8.6, 1, 5.0)}


def test_fusion_folds_in_order(spark):
    """The closed form equals the fold: each variant takes the larger of what was and its own, then adds."""
    rows = spark.createDataFrame([(1, 0, 0, "x", 5.0), (1, 1, 3, "x", 6.0), (1, 2, 1, "x", 1.0)], "query_id int, variant_no int, rank int, chunk_id string, score double")
    state = None
    for v, r, s in ((0, 0, 5.0), (1, 3, 6.0), (2, 1, 1.0)):
        own = s + max(0.0, 2.6 - 0.25 * r) + (1.0 if v else 0.0)
        state = own if state is None else max(state, own) + 1.2
    assert fuse.fuse_variants(rows).first().fusion_score == pytest.approx(state)


def test_context_and_evidence(spark):
    parts = spark.createDataFrame([(1, 1, "a" * 3000), (1, 2, "b" * 3000), (1, 3, "c"), (2, 1, "a" * 3900), (2, 2, "b" * 3000)], "query_id int, evidence_rank int, part string")
    got = [(r.query_id, r.evidence_rank, r.kept_chars, r.is_reference) for r in fuse.context_parts(parts).orderBy("query_id", "evidence_rank").collect()]
    assert got == [(1, 1, 3000, True), (1, 2, 1000, False), (2, 1, 3900, True)]
    rows = spark.createDataFrame([(1, "a", "p", "T", 9.0), (1, "b", "p", "t ", 8.0), (1, "c", "q", "U", 7.0), (1, "d", "p", "V", 1.0), (2, "a", "p", "T", 2.0)], "query_id int, chunk_id string, product_name string, title string, evidence_score double")
    kept = fuse.filter_evidence(rows, [F.col("evidence_score").desc(), F.col("chunk_id")])
    assert [(r.query_id, r.chunk_id) for r in kept.collect()] == [(1, "a")]


def test_vector_search(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in dense.search(rows, rows.where("vec_id % 50 = 0"), 5, block=2).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.near_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {q: np.lexsort((np.arange(200), -np.round((unit @ unit[q]).astype(float), 6)))[:5].tolist() for q in (0, 50, 100, 150)}
    made = dense.embed(spark.createDataFrame([("a b",), ("a b",), ("",)], "text string")).collect()
    assert made[0].embedding == made[1].embedding and sum(v * v for v in made[0].embedding) == pytest.approx(1, abs=1e-5)


def test_policy_and_merge(spark):
    f = "overview string, materials string, timeline string, fees string, eligibility string, process string, contact string"
    topics = spark.createDataFrame([(0, "return", ["退货"], "可退。", "凭证。", "七天。", "", "", "", "")], f"pos int, topic string, terms array<string>, {f}")
    scenes = spark.createDataFrame([("return", 0, "gift", ["赠品"], "赠品不退。", "", "", "", "", "", "")], f"topic string, pos int, name string, terms array<string>, {f}")
    asked = spark.createDataFrame([(1, "退货多久"), (2, "赠品退货"), (3, "你好")], "query_id int, text string")
    got = {r.query_id: (r.answer, r.confidence) for r in dialog.policy_answers(asked, topics, scenes).collect()}
    assert got == {1: ("可退。 七天。 " + dialog.CLOSINGS[1][1], 0.75), 2: ("赠品不退。 凭证。", 0.74), 3: (dialog.NO_POLICY, 0.58)}
    in_context = asked.selectExpr("*", "array('return') c")
    assert {r.query_id: (r.topic, r.answer) for r in dialog.policy_answers(in_context, topics, scenes, context="c").collect()}[3] == ("return", "可退。 凭证。")
    parts = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "query_id int, sub_no int, answer string")
    assert {r.query_id: r.answer for r in answer.merge_answers(parts).collect()} == {1: "问题1：a\n问题2：b", 2: "c"}
    ids = spark.createDataFrame([(1, 2, ["c", "a"]), (1, 1, ["a", "b"])], "query_id int, o int, v array<string>")
    assert fuse.ordered_distinct(ids, "query_id", "o", "v", 5).first().v == ["a", "b", "c"]


def test_summary(spark):
    rows = spark.createDataFrame([("a", True, []), ("a", False, ["missing answer term: x", "image_ids too few"])], "category string, ok boolean, failures array<string>")
    assert evaluate.summary(rows).first()[1:] == (2, 1)
    assert {r.issue: r.n for r in evaluate.issue_histogram(rows).collect()} == {"missing answer term": 1, "image_ids too few": 1}


def test_stream_equals_fold(spark, tmp_path):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    looked = dialog.looked_at(turns)
    looked.where("turn < 2").write.parquet(str(tmp_path / "in"))

    def run():
        # A timeout by processing time makes Spark run empty batches without end; one batch takes what is there.
        source = spark.readStream.schema(looked.schema).parquet(str(tmp_path / "in"))
        out = sessions.session_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        out.trigger(once=True).start().awaitTermination(120)

    run()
    looked.where("turn >= 2").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, dialog.fold_sessions(turns).collect())) and got


def test_log_and_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = sessions.append_log(source.select("event_id"), str(tmp_path / "log"), str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.json(str(tmp_path / "log")).count() == events.count()
    assert sessions.windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()
