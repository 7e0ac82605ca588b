"""Documents and conversations with content that the plain tables lack, put in by the same rule in Spark and in SQL.

The tables hold invented prose, in which no label, intent, route or product occurs. Each document gets a head and a tail
by its number, whole texts stay, one in sixteen is replaced; most user turns are replaced by stated ones.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import lit, table

N_DOCS, N_TURNS = 16, 20

#: Number of a document modulo N_DOCS: what stands before and behind its text.
AROUND = {
    0: ("", "\nIntroduction ........ 3\nParts ...... 5\nCare ......... 9"),
    1: ("# Safety warning for the boat hull\n", ""),
    2: ("", "\nTroubleshooting: the indicator is flashing and the snowmobile throttle cable fails."),
    3: ("# Accessories included with the camera\n", "\nThe lens and the shutter are in the box. camera"),
    4: ("# Specifications and model\n", "\nWeight of the air fryer basket, hot air."),
    5: ("# How to install and clean the vacuum\n1. Remove the side brush\n2. Press it\n", "\nEmpty the dust bin. roomba"),
    6: ("# Warning before you install\n1) Open it\n2) Close it\n", "\nNever put it into water."),
    7: ("", "\n红灯一直亮，手机连不上，PIN code 忘了，怎么更换？"),
    8: ("", "\nThe bios of the motherboard shows \\u4e2d and \\mathrm{V} for the cpu."),
    9: ("", "\nantidisestablishment of the drip tray in the coffee machine: espresso"),
    10: ("", "\nOne 3\nTwo 4\nThree 5\nFour 6\nFive 7\nSix 8\nSeven 9\nEight 10\nNine 11\nTen 12"),
    12: ("# First part\n", "\n# Second part\nSome more words.\n#\tThird part"),
    14: ("", "\n电钻电池充电指示灯闪烁。请把底座和电源线的两端接好"),
    15: ("", "\n甲乙丙丁戊己庚辛壬癸"),
    13: ("# Overview\n", "\nMicrowave oven light, grease filter. A grill with a burner and the earbuds."),
}
WHOLE = {11: "Intro 3 Parts of it 5 Care 9"}

#: (3 * conversation + turn) modulo N_TURNS: what a user says in place of the table's text.
SAID = (
    "电钻怎么充电？", "那它的指示灯闪烁是什么意思", "Hello!", "我要退货，订单运费谁承担？需要什么材料", "那多久到账", "相机 EOS100 的屏幕有划痕，怎么更换", "换个产品", "重新开始",
    "谢谢", "DCB107 怎么安装？\n清洁方法呢？", "空调和 KFR35 都不制冷", "发票抬头开错了，怎么申请重开？联系谁", "good bye", "请问，这个呢？", "包裹丢了，物流没有更新，几天能赔",
    "人工客服在哪",
)


def documents(spark, sf_dir: str) -> DataFrame:
    n = F.pmod(F.col("doc_id"), F.lit(N_DOCS))
    text = F.coalesce(*[F.when(n == k, F.lit(t)) for k, t in WHOLE.items()], *[F.when(n == k, F.concat(F.lit(a), F.col("text"), F.lit(b))) for k, (a, b) in AROUND.items()], F.col("text"))
    return table(spark, sf_dir, "documents").withColumn("text", text)


def conversations(spark, sf_dir: str) -> DataFrame:
    n = F.pmod(3 * F.col("conv_id") + F.col("turn"), F.lit(N_TURNS)).cast("int")
    said = F.when(F.col("role") == "user", F.get(F.array(*map(F.lit, SAID)), n))
    return table(spark, sf_dir, "conversations").withColumn("text", F.coalesce(said, "text"))


def _escaped(text: str) -> str:
    return lit(text).replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '")


_DOCS = "planted AS (SELECT * REPLACE (CASE doc_id % 16 " + " ".join(f"WHEN {k} THEN {_escaped(t)}" for k, t in WHOLE.items()) + " " + " ".join(f"WHEN {k} THEN {_escaped(a)} || text || {_escaped(b)}" for k, (a, b) in AROUND.items()) + " ELSE text END AS text) FROM documents)"
_TURNS = "said AS (SELECT * REPLACE (CASE WHEN role = 'user' THEN coalesce([" + ", ".join(map(_escaped, SAID)) + f"][(3 * conv_id + turn) % {N_TURNS} + 1], text) ELSE text END AS text) FROM conversations)"


def _over(sql: str, name: str, new: str, rows: str) -> str:
    body = re.sub(rf"\b{name}\b", new, sql.strip())
    return f"WITH {'RECURSIVE ' * body.startswith('WITH RECURSIVE')}{rows}{', ' + re.sub('^WITH (RECURSIVE )?', '', body) if body.startswith('WITH ') else ' ' + body}"


def over_documents(sql: str) -> str:
    """The same SQL over planted documents."""
    return _over(sql, "documents", "planted", _DOCS)


def over_conversations(sql: str) -> str:
    return _over(sql, "conversations", "said", _TURNS)
