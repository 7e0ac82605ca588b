"""Table functions for SQL: generators as rows of a lateral join, and chunk filling over partitions of a table.

    tables.register(spark)
    spark.sql("SELECT d.doc_id, s.* FROM documents d, LATERAL section_rows(d.text) s")
    spark.sql("SELECT * FROM chunk_rows(TABLE(units) PARTITION BY doc_id ORDER BY pos)")

Each gives the rows of the column operator of the same kind in generate. A partition of chunk_rows is one document's
units; it holds their lengths' state and the chunk that is being filled, not the document.

Cases: null and blank texts give no rows (but for unit_rows(text, true)); rows of units without a text are passed over; ties keep SQL's order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..functions import lexicon
from .generate import MAX_CHARS

# Where sections, units and lines end, and what a question may begin with.
HEADING, MARKER = re.compile(r"(?m)(?=^#\s+)"), re.compile(r"(\[\[PIC:[^\]]+\]\])")
#: White space as the column operators have it; for Python U+001C to U+001F are white space too.
SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")
UNIT_END, QUESTION_END = re.compile(rf"(?<=[。！？!?；;])[{SPACE}]+|\n+"), re.compile(r"\n|(?<=[？?])")
FILLER = re.compile(r"^(请问|我想咨询一下|我想了解一下|我想问一下|帮我看一下|想问一下|我想知道|麻烦问一下)[，,\s]*")


def stripped(parts: list[str]) -> Iterator[str]:
    return (p.strip(SPACE) for p in parts if p.strip(SPACE))


@udtf(returnType="section_index int, section string")
class SectionRows:
    """G1."""

    def eval(self, text: str):
        yield from enumerate(stripped(HEADING.split(text or "")))


@udtf(returnType="pos int, unit string")
class UnitRows:
    """G2. outer: a text without units has a row of nulls. A LEFT JOIN LATERAL doesn't keep it: Spark's plan for Python functions is that of an inner join."""

    def eval(self, text: str, outer: bool = False):
        units = list(stripped(UNIT_END.split(MARKER.sub("\n\\1\n", text or ""))))
        yield from enumerate(units) if units or not outer else [(None, None)]


@udtf(returnType="sub_id string, text string, normalized string, intent string, depends boolean")
class QuestionRows:
    """G12."""

    def eval(self, text: str):
        text = (text or "").strip()
        parts = list(stripped(re.findall('"([^"]+)"', text)))
        if len(parts) < 2:
            lines = (x.strip(" ,，") for x in QUESTION_END.split(re.sub("\r\n?", "\n", text)))
            parts = [x for x in lines if x]
        for k, part in enumerate(parts):
            own = " ".join(FILLER.sub("", part.strip().strip('"').strip(" ,，")).split())
            if own:
                yield f"q{k + 1}", part, own, next((w for w in lexicon.SUB_INTENTS if w in own), "general"), k > 0


@udtf(returnType="doc_id long, part int, chunk string")
class ChunkRows:
    """Takes a table of doc_id and unit, partitioned by the document and ordered; fills chunks as units come."""

    def __init__(self):
        self.key, self.lines, self.size, self.part = None, [], None, 0

    def eval(self, row: Row):
        self.key, unit = row["doc_id"], row["unit"]
        if unit is None:
            return
        if len(unit) > MAX_CHARS:  # stands alone, in pieces
            yield from self.full()
            for k in range(0, len(unit), MAX_CHARS):
                yield from self.chunk(unit[k : k + MAX_CHARS])
            self.size = None
        elif self.size is not None and self.size + len(unit) + 1 <= MAX_CHARS:
            self.lines.append(unit)
            self.size += len(unit) + 1
        else:
            # A line end counts with each unit but with one that didn't fit into the chunk before.
            size = len(unit) + (self.size is None)
            yield from self.full()
            self.lines, self.size = [unit], size

    def chunk(self, text: str):
        if text.strip():
            yield self.key, self.part, text.strip()
            self.part += 1

    def full(self):
        lines, self.lines = self.lines, []
        yield from self.chunk("\n".join(lines))

    def terminate(self):
        yield from self.full()


FUNCTIONS = {"section_rows": SectionRows, "unit_rows": UnitRows, "question_rows": QuestionRows, "chunk_rows": ChunkRows}


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
