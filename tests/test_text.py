"""Text functions, labels and terms on small cases, ideographs among them."""

import pytest
from pyspark.sql import functions as F

from lorebase.functions import text as T
from lorebase.operators import answer, classify, dialog, evaluate, generate, images, submission


@pytest.fixture(scope="module")
def one(spark):
    base = spark.range(1)
    return lambda c: base.select(c.alias("x")).first().x


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    "make, given, want",
    [
        (T.compact, "A b　C\nd", "abcd"),
        (T.query_text, " 电钻，怎么(用)？ ok! ", "电钻 怎么 用 ok "),
        (T.search_term, 'a"b', "a b"),
        (T.search_term, "(x)", ""),
        (T.without_markers, "a [[PIC:x1]] b\n\n\n\n[[PIC_MISSING]]c", "a b\n\nc"),
        (T.title, "# 安装。步骤一\nmore", "安装"),
        (T.title, "[[PIC:a]]", "未命名章节"),
        (T.title, "x" * 100, "x" * 80),
        (T.evidence, " - a # b \\u4e2d [[PIC:q]] | ", "a b"),
        (T.sentence_key, "A-b 中 文!", "ab中文"),
        (T.without_thinking, "<think>a\nb</think> yes", "yes"),
        (T.smalltalk_key, "Hello, 你好!_", "hello你好"),
        (T.unescape, "a\\u4e2d\\u6587b\\u00e9", "a中文bé"),
        (T.common_escapes, 'a\\nb\\t\\"c\\"\\/', 'a\nb\t"c"/'),
        (T.without_latex, "a \\textbf{b} $x_1^{2}$ , c", "a   b   x, c"),
        (T.unglue, "Donot use thepoweroutlet", "Do not use the power outlet"),
        (T.respace, "Stop.Then 5cm lf fooBar", "Stop. Then 5 cm If foo Bar"),
        (T.manual_text, "a<pic>b\r\nc　d", "a\n<PIC>\nb\nc d"),
    ],
)
def test_text(one, make, given, want):
    assert one(make(lit(given))) == want


def test_ids_and_lists(one):
    import hashlib

    assert one(T.chunk_id(lit("m"), lit(3), lit("text"))) == "chunk_" + hashlib.sha1(b"m:3:text").hexdigest()[:12]
    assert one(T.string_list(lit('["a", "b"]'))) == ["a", "b"] and one(T.string_list(lit("{bad"))) == []
    assert one(T.picture_suffix(lit("t"), F.array(lit("a"), lit("b")))) == '"t<PIC><PIC>";["a", "b"]'
    assert one(T.overlap(lit("红灯 Blinks"), F.array(lit("红灯"), lit("BLINKS"), lit("x")))) == 2


def test_labels(one):
    assert one(classify.toc_like(lit("Chapter one .......... 1\nChapter two .......... 2\n" + "x" * 80))) is True
    assert one(classify.toc_like(lit("Safety 3 Install 5 Clean 9"))) is True
    assert one(classify.low_value(lit("# Note"))) is True and one(classify.low_value(lit("Press the button for 5 s."))) is False
    assert one(classify.low_value(lit("# Note"), F.array(lit("img")))) is False
    assert one(classify.step_count(lit("1. Open\n2) Close\n3、关"))) == 4
    assert one(classify.semantic_type(lit("Warning"), lit("Keep dry."))) == "safety_warning"
    assert one(classify.semantic_type(lit("Setup"), lit("The lamp is blinking"))) == "troubleshooting"
    assert one(classify.semantic_type(lit("规格"), lit("220V"))) == "specification"
    assert one(classify.domain(lit("The lens and shutter of the vacuum"))) == "camera"
    assert one(classify.domain(lit("nothing at all"))) == ""
    assert one(classify.domain(lit("skiing on a rainbow"))) == ""
    assert set(one(classify.domain_groups(lit("air fryer basket and tv")))) == {"airfryer", "television"}
    assert one(classify.query_intents(lit("how to reset"))) == ["procedure"]
    assert one(classify.clean_score(lit(True), lit(True), lit(True))) == 0.3
    assert one(classify.ascii_heavy(lit("install it now"))) is True and one(classify.ascii_heavy(lit("安装"))) is False
    assert one(classify.toc_noise(lit("see 1 2 3 4 5"))) is True and one(classify.truncated_heading(lit("Use it with"))) is True


def test_backfill(spark):
    rows = spark.createDataFrame([("m", k, d) for k, d in enumerate(["a", "", "", "a", "", "", "", "", "", "", "b"])], "m string, k int, domain_label string")
    got = [r.domain_label for r in classify.backfill_domain(rows, "m", "k").orderBy("k").collect()]
    assert got == ["a", "a", "a", "a", "a", "a", "a", "a", "a", "b", "b"]


def test_terms(one):
    assert one(generate.keywords(lit("how to Use DCB107 电钻"))) == ["DCB107电钻", "DCB107", "电钻"]
    assert one(generate.merged_tokens(lit("VR 头显 ok"))) == ["VR头显", "VR", "头显", "ok"]
    assert one(generate.keywords(lit("指示灯"))) == ["指示灯", "指示", "示灯"]
    assert "指示灯" in one(generate.keywords(lit("电钻的指示灯为什么一直在闪烁呢")))
    assert one(generate.ascii_phrases(lit("replace the brake lever now"))) == ["replace brake lever", "brake lever now", "replace brake", "brake lever", "lever now"][:8]
    assert one(generate.models(lit("my dcb107 and EOS-5"))) == ["DCB107"]
    assert one(generate.products(lit("我的 PS VR"))) == ["VR头显"] and one(generate.products(lit("我的 PS VR"), strict=True)) == []
    assert one(generate.synonyms(lit("红灯亮"))) == ["指示灯", "闪烁"]
    assert one(generate.sections(lit("pre\n# A\nx\n# B"))) == ["pre", "# A\nx", "# B"]
    assert one(generate.sentence_units(lit("一。 二！\n[[PIC:a]] c"))) == ["一。", "二！", "[[PIC:a]]", "c"]
    assert [q.normalized for q in one(generate.sub_questions(lit("请问怎么退货？多久到账？")))] == ["怎么退货？", "多久到账？"]
    assert [q.intent for q in one(generate.sub_questions(lit("请问怎么退货？多久到账？")))] == ["退货", "general"]
    assert one(generate.evidence_sentences(lit("short"))) == ["short"]
    assert one(generate.marker_ids(lit("[[PIC:a]] [[PIC:b]] [[PIC:a]]"))) == ["a", "b"]
    assert one(generate.prioritized(F.array(lit("brake lever")), F.array(lit("X"), lit("LONGER")), F.array(lit("相机")))) == ["相机", "brake lever", "LONGER", "X"]
    seen = one(generate.visual_terms(lit("指示灯闪烁，屏幕裂纹")))
    assert seen.component_terms == ["指示灯", "屏幕"] and seen.status_terms == ["闪烁"] and seen.issue_terms == ["裂纹"]


def test_fill_never_exceeds():
    import random

    rng = random.Random(1)
    for _ in range(200):
        units = ["x" * rng.randint(1, 60) for _ in range(rng.randint(0, 20))]
        chunks = generate.fill(units, 40)
        assert all(len(c) <= 40 for c in chunks) and "".join(chunks).replace("\n", "") == "".join(units)


def test_dialogue(one):
    assert one(dialog.smalltalk(lit("Hello!"))) == "greeting" and one(dialog.smalltalk(lit("hello there"))) is None
    service = one(dialog.route(lit("我要退货，运费谁出")))
    assert service.route == "customer_service" and service.service_score == 4 and service.confidence == 0.89
    assert one(dialog.route(lit("电钻指示灯闪烁"))).route == "manual_rag"
    assert one(dialog.detail_intents(lit("需要什么材料，多久"))) == ["materials", "timeline"]


def test_answers(one, spark):
    assert one(answer.dedupe(lit("It is on. It is on. Now it is off."))) == "It is on. Now it is off."
    assert one(answer.dedupe(lit("Look here." + "<PIC>" * 5))).count("<PIC>") == 3
    assert one(answer.lines_once(lit("a\na\nb"))) == "a\nb"
    assert one(answer.manual_format(lit(""), F.array(lit("x")), lit(""), lit(0))) == answer.NO_ANSWER
    assert "1. x" in one(answer.manual_format(lit("c"), F.array(lit("x")), lit(answer.SAFETY), lit(5)))
    assert one(submission.without_labels(lit("[参考1] 结论：可以（参考 3）Manual1_2"))) == "可以"
    assert one(submission.service_short(lit("这是第一句回答内容。 好吗？ 太短。 这是第二句回答内容。 这是第一句回答内容！"))) == "这是第一句回答内容。 这是第二句回答内容"
    assert one(submission.alike(T.sentence_key(lit("Press it.")), T.sentence_key(lit("press it now")), 0)) is True
    assert one(answer.answer_status(lit("  "))) == 400
    prompts = spark.createDataFrame([("a", "d"), ("boom", "d"), ("", "d")], "prompt string, fallback string")

    def client():
        def ask(p):
            if p == "boom":
                raise RuntimeError("no")
            return p.upper()

        return ask

    said = answer.answer_with(prompts, client).collect()
    assert [(r.answer, r.error) for r in said] == [("A", None), ("d", "no"), ("d", None)]
    assert [r.answer for r in answer.answer_with(prompts).collect()] == ["d", "d", "d"]


def test_evaluation(one):
    assert one(evaluate.faithfulness(lit("Press the button. Fly away."), lit("press the red button"))) == 0.5
    assert one(evaluate.relevancy(lit("red button"), lit("the button"))) == 0.5
    assert one(evaluate.completeness(lit("1. x" + "y" * 200 + "<PIC>"))) == 1.0


def test_pictures(one):
    def size(raw):
        return one(images.image_type(lit(bytearray(raw)))), one(images.image_size(lit(bytearray(raw))))

    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    gif = b"GIF89a" + (3).to_bytes(2, "little") + (4).to_bytes(2, "little")
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc2\0\x11\x08" + (9).to_bytes(2, "big") + (7).to_bytes(2, "big") + b"\x03"
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert [size(x) and (size(x)[0], tuple(size(x)[1])) for x in (png, gif, jpeg, webp)] == [("PNG", (640, 480)), ("GIF", (3, 4)), ("JPEG", (7, 9)), ("WEBP", (100, 50))]
    assert size(b"text")[0] == "UNKNOWN" and size(b"text")[1] is None


def test_pictures_lists_are_made_only_when_asked_for(spark):
    from lorebase.registry import QUERIES

    plan = QUERIES["visual_terms"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "issue_terms" in plan and "other_terms" not in plan and "regexp_extract_all" not in plan


def test_glued_words_are_no_loop_of_replacements(spark):
    texts = ["Donot", "word.Word a1b camelCase lf x9.Y", "thepoweroutlet", None, "", "elf lf", "aB aBc 9z,Z"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.ocr_repair("t").alias("r"))
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r.r for r in df.orderBy("k").collect()] == ["Do not", "word. Word a 1 b camel Case If x 9. Y", "the power outlet", None, "", "elf If", "aB a Bc 9 z, Z"]
