"""The registry of queries: each has a name, a function of (session, folder) and, where SQL can say it, SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


#: Bytes of a table that is small enough to deal out by a shuffle.
SMALL = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. A small one often is a single row group, which one task reads: it's dealt out over the cores. Larger ones
    have splits enough of their own."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if name in TEXTS and size < SMALL else df


#: Tables whose rows are worth a shuffle.
TEXTS = ("documents", "pages")


def lit(text: str) -> str:
    """A string in SQL."""
    return "'" + text.replace("'", "''") + "'"


def any_in(text: str, terms) -> str:
    """SQL for: one of the terms is in the text."""
    return "(" + " OR ".join(f"contains({text}, {lit(t.lower())})" for t in terms) + ")"


#: White space that the tables hold.
WS = "' ' || chr(10) || chr(9) || chr(13)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def squeeze(x: str) -> str:
    return rf"regexp_replace({x}, '\s+', ' ', 'g')"


def unmarked(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def title_line(x: str) -> str:
    return strip(f"split_part({strip(f"regexp_replace({unmarked(x)}, '^[# ]+', '')")}, chr(10), 1)")


#: documents with title and title line, for use in WITH.
TITLED = f"""
titled AS (
    SELECT *, left(coalesce(nullif({strip("regexp_extract(line, '^[^。！？!?；;]*')")}, ''), nullif(line, ''), '未命名章节'), 80) AS title
    FROM (SELECT *, {title_line('text')} AS line FROM documents)
)"""

#: Terms as the index has them.
TERMS = "regexp_extract_all(lower({}), '[一-鿿]+|[a-z0-9à-öø-ÿß]+')"
