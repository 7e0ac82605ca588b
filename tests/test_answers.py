"""Answers made ready, extractive answers, retrieval modes, sessions: small cases by hand."""

import pytest
from pyspark.sql import functions as F

from lorebase.operators import answer, dialog, fuse, retrieve, submission

REFS = "array<struct<title:string,text_snippet:string>>"


@pytest.fixture()
def handed_in(spark):
    def run(said, question="怎么安装电钻的电池", sources=(), ids=(), refs=()):
        rows = spark.createDataFrame([(said, question, list(sources), list(ids), list(refs))], f"a string, q string, s array<string>, i array<string>, r {REFS}")
        return rows.select(submission.normalized("a", "q", "s", "i", "r")).first()[0]

    return run


def test_submission(handed_in):
    assert handed_in("") == submission.EMPTY_ANSWER
    assert handed_in("结论：把电池插入底座，直到发出咔嗒声为止。\n\n相关图片：\n- drill0_04") == "把电池插入底座，直到发出咔嗒声为止。"
    assert handed_in("怎么安装电钻的电池：把电池插入底座，直到发出咔嗒声为止[参考 1]", ids=["d1", "d2"]) == '"把电池插入底座，直到发出咔嗒声为止<PIC><PIC>。";["d1", "d2"]'
    assert handed_in("根据现有资料无法回答此问题。") == submission.MANUAL_ANSWER
    assert handed_in("根据现有资料无法回答此问题。", question="运费谁出") == submission.SERVICE_ANSWER
    refs = [("电池安装", "请把电池推入底座，直到听到声音。 其他内容与此无关，请看后面各章的说明。 1 2 3 4 5 6 7 8 9"), ("目录 ......", "")]
    assert handed_in("根据现有资料无法准确回答此问题。", refs=refs, ids=["x"]) == '"电池安装。操作要点：请把电池推入底座，直到听到声音<PIC>。";["x"]'
    english = [("Battery installation", "Push the battery into the base until it clicks. Wash your hands before dinner.")]
    assert handed_in("根据现有资料无法回答此问题。", question="How to install the battery", refs=english) == "Battery installation Push the battery into the base until it clicks.."
    service = "您好，我们会为您登记退货申请。 您好，我们会为您登记退货申请！ 请问还有吗？ 请在三天内寄回商品并保留单据。"
    assert handed_in(service, question="退货", sources=["customer_service_policy"]) == "您好，我们会为您登记退货申请。 请在三天内寄回商品并保留单据。"


def test_reprocess(spark):
    rows = spark.createDataFrame(
        [("a", "答案已经写好", "运费", [], "stated"), ("b", "", "退货运费", [], None), ("c", "根据现有资料无法回答此问题。", "物流", [], None), ("d", "结论：把电池插入底座，直到发出咔嗒声为止。\n- 无", "电池", ["p"], None), ("e", "短", "电池", [], None)],
        "id string, answer string, question string, image_ids array<string>, override string",
    )
    done = rows.withColumn("ret", submission.reprocessed("answer", "question", "image_ids", F.lit("模板"), F.col("override")))
    got = {r.id: r.ret for r in done.collect()}
    assert got == {"a": "stated", "b": "模板", "c": "模板", "d": '"把电池插入底座，直到发出咔嗒声为止<PIC>。";["p"]', "e": submission.MANUAL_ANSWER}
    assert submission.reprocess_statistics(done).first().asDict() == {"total": 5, "with_images": 1, "with_pic": 1, "cs_specific": 1, "cs_template": 1, "refusal_cleaned": 1}


def test_extractive(spark):
    kind = "query_id int, evidence_rank int, title string, text string, query string, terms array<string>"
    rows = [
        (1, 1, "Brake lever", "Press the brake lever with your right hand. Note: press nothing else than the lever here. The lever is made of steel and of rubber.", "How to press the brake lever", ["brake", "lever", "press"]),
        (1, 2, "Contents ... 3", "Page 1 page 2 brake lever. Press the brake lever with your right hand.", "How to press the brake lever", ["brake", "lever", "press"]),
        (2, 1, "电池", "请把电池推入底座，直到听到咔嗒一声为止才算完成。电池要先充满电，然后才能长期保存在干燥的地方。", "电池怎么装", ["电池"]),
        (3, 1, "Nothing", "No word of it.", "the query is about other things", ["zebra"]),
    ]
    got = {r.query_id: r.answer for r in answer.extractive(spark.createDataFrame(rows, kind)).collect()}
    assert got[1] == "Press the brake lever with your right hand.\n\n1. The lever is made of steel and of rubber."
    assert got[2].endswith(answer.SAFETY) and "电池" in got[2]
    assert got[3] == "Nothing No word of it."


def test_modes(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "brake lever and throttle", "a"), (2, "the battery of the drill", "b"), (3, "lever", "c")], "chunk_id long, text string, source string")
    asked = spark.createDataFrame([(1, "brake lever"), (2, "battery")], "query_id int, text string")
    retrieve.build(chunks, str(tmp_path / "i"))
    index = retrieve.load(spark, str(tmp_path / "i"))
    for mode in retrieve.MODES:
        best = {r.query_id: r for r in retrieve.retrieve(mode, asked, index, 2).where("rank = 1").collect()}
        # By cosine alone the short chunk is nearer to the question than the one with both words.
        assert (best[1].chunk_id, best[2].chunk_id, best[2].source) == (3 if mode == "vector" else 1, 2, "b")
    with pytest.raises(ValueError):
        retrieve.retrieve("none", asked, index)
    retrieve.build(chunks, str(tmp_path / "j"), model=False)
    plain = retrieve.load(spark, str(tmp_path / "j"))
    assert plain.vectors is None
    words = retrieve.retrieve("sparse", asked, plain, 2).select("query_id", "chunk_id", "rank").collect()
    assert sorted(words) == sorted(retrieve.retrieve("hybrid", asked, plain, 2).select("query_id", "chunk_id", "rank").collect())
    with pytest.raises(ValueError):
        retrieve.retrieve("vector", asked, plain)


def test_variants(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "brake lever", "a"), (2, "blinking lamp", "b")], "chunk_id long, text string, source string")
    kind = "query_id int, text string, summary string, visual struct<component_terms:array<string>,status_terms:array<string>,issue_terms:array<string>,other_terms:array<string>>"
    asked = spark.createDataFrame([(1, "brake", None, None), (2, "brake", "a lamp", (["lamp"], ["blinking"], [], ["lamp"]))], kind)
    got = sorted((r.query_id, r.variant, r.text) for r in retrieve.variants(asked).collect())
    assert got == [(1, "text_only", "brake"), (2, "multimodal_fused", "brake a lamp"), (2, "text_only", "brake"), (2, "visual_focus", "brake lamp blinking")]
    retrieve.build(chunks, str(tmp_path / "i"), model=False)
    found = retrieve.retrieve_variants("sparse", asked, retrieve.load(spark, str(tmp_path / "i")), 5).collect()
    assert {(r.query_id, r.chunk_id): r.variant_hits for r in found} == {(1, 1): 1, (2, 1): 3, (2, 2): 2}


def test_references_pictures_and_means(spark):
    parts = spark.createDataFrame([(1, "q1", "a"), (1, "q2", "b")], "query_id int, sub_id string, text string")
    results = spark.createDataFrame([(1, "q2", 1, "x"), (1, "q1", 1, "y")], "query_id int, sub_id string, rank int, chunk_id string")
    assert sorted((r.chunk_id, r.sub_question_text, r.sub_question_index) for r in retrieve.references(parts, results).collect()) == [("x", "b", 2), ("y", "a", 1)]
    rows = spark.createDataFrame([(1, ["b", "a", "z"]), (2, [])], "query_id int, image_ids array<string>")
    pictures, probed = (spark.createDataFrame(x, "image_id string, file_name string") for x in ([("a", "a.png")], [("b", "b.jpg"), ("a", "other.png")]))
    got = {r.query_id: [(i.image_id, i.file_name, i.exists) for i in r.images] for r in retrieve.resolved_pictures(rows, pictures, probed).collect()}
    assert got == {1: [("b", "b.jpg", True), ("a", "a.png", True), ("z", None, False)], 2: []}
    means = spark.createDataFrame([(1, 0.5), (1, 0.8), (2, 0.15)], "query_id int, confidence double")
    assert {r.query_id: r.confidence for r in fuse.mean_confidence(means).collect()} == {1: 0.65, 2: 0.15}


def test_session_by_hand(spark):
    said = [
        (1, 0, "user", "电钻怎么充电？"), (1, 1, "assistant", "插上"), (1, 2, "user", "那它的指示灯呢"), (1, 3, "user", "DCB107 EOS100 KFR35 XYZ99 呢"), (1, 4, "user", "继续"), (1, 5, "user", "换个产品"),
        (1, 6, "user", "相机 EOS7 怎么用"), (1, 7, "user", "重新开始"), (1, 8, "user", "还有呢"), (2, 0, "user", None),
    ]
    got = {(r.conv_id, r.turn): r for r in dialog.fold_sessions(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1, 0].product, got[1, 0].resolved, got[1, 0].is_follow_up) == ("电钻", "电钻怎么充电？", False) and got[1, 0].summary.endswith("上一轮回答摘要：插上")
    assert got[1, 2].resolved == "电钻 那它的指示灯呢" and got[1, 2].is_follow_up
    assert got[1, 3].models == "DCB107,EOS100,KFR35" and got[1, 4].models == "DCB107,EOS100" and got[1, 4].resolved == "电钻 DCB107 EOS100 继续"
    assert got[1, 5].needs_clarification and not got[1, 5].is_follow_up and got[1, 5].product == "电钻"
    assert got[1, 6].topic_switched and (got[1, 6].product, got[1, 6].models) == ("相机", "EOS7")
    assert got[1, 7].reset and (got[1, 7].product, got[1, 7].n_history) == ("", 0)
    assert not got[1, 8].is_follow_up and got[1, 8].n_history == 2 and got[2, 0].summary == ""


def test_part_queries(spark):
    from lorebase.operators import generate

    rows = spark.createDataFrame([("电钻怎么充电？指示灯呢？", "电钻怎么充电？指示灯呢？", "", []), ("怎么清洁？", "冰箱 怎么清洁？", "冰箱", ["KFR35"])], "q string, resolved string, took string, took_models array<string>")
    rows = rows.withColumn("part", F.explode(generate.sub_questions("q")))
    made = rows.select(dialog.part_query(F.col("q"), F.col("part"), F.col("resolved"), generate.products("q"), generate.models("q"), F.col("took"), F.col("took_models")).alias("x"))
    assert [r.x for r in made.collect()] == ["电钻怎么充电？指示灯呢？ 电钻怎么充电？", "电钻怎么充电？指示灯呢？ 指示灯呢？", "冰箱 KFR35 怎么清洁？"]
