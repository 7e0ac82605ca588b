"""How text filters overlap: what each filter removes, wherever it stands in a sequence of filters.

The files of a table are a stream that is read to its end in micro-batches. Of each row only a mask of the filters that it
fails, its part, its labels and its text's digest go on. Four filters look at the row alone; the fifth is failed by texts
that a smaller id has too, and that isn't known before all files were seen. So state holds, for each text, the smallest
id so far with the masks of its rows. A row that comes with a larger id fails; a smaller id takes over, and the rows
that held the text before are retracted from their part's counter and counted again as failing. Each micro-batch writes
its changes under its number, so that one that runs again replaces what it wrote; the sums of all changes are the counters.

State is keyed by a text's digest and kept in buckets of digests, of about PER_BUCKET texts each: changes are worked out
for whole buckets in arrays, and only new and changed texts are appended to a bucket's list. Before the shuffle, rows of
one text that meet in a task are folded, so that a text that a third of all rows have sends a few rows a task.

From 32 sums over each part (rows that pass all filters of a set) all orders of the filters follow without another look
at rows.

Cases: null texts count as empty, and empty texts are copies of one another; null parts are the empty string; a row
without an id fails no comparison of ids, in either direction; rows that repeat an id don't make copies of one another;
a row is good or toxic if any label of its id says so; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from .common import bounded_batches, materialize, shared_dir

FILTERS = "ABCDE"
#: The last filter compares texts; bits of the masks.
COPY, ALL = 1 << 4, (1 << 5) - 1
WORD_ENDS = r"[\x20\x09-\x0D]+"
#: Micro-batches at most, about, and the fewest bytes of one; texts of a bucket, about; rows that a task folds at once.
BATCHES, LEAST_BYTES, PER_BUCKET, FOLDED = 16, 256 << 20, 2000, 50_000
#: State stores at least, and rows of one, about: each store costs a task and its files in each micro-batch.
STORES, PER_STORE = 8, 500_000

ROW = "bucket long, digest binary, id long, part string, mask int, good int, toxic int, n long"
HELD = "digest binary, id long, part string, mask int, good int, toxic int, n long"
CHANGE = "part string, mask int, good int, toxic int, n long"
GROUP = ["part", "mask", "good", "toxic"]
COLUMNS = ["digest", "id", *GROUP, "n"]


def row_mask(text: str = "text") -> Column:
    """Bits of the filters that a text fails by itself: few words, few distinct words, capitals, marks."""
    words = F.array_remove(F.split(text, WORD_ENDS), "")
    fails = (
        F.size(words) < 200,
        F.lit(100) * F.size(F.array_distinct(words)) < F.lit(50) * F.size(words),
        F.lit(100) * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))) > F.lit(2) * F.length(text),
        F.col(text).rlike("[#$%&*|]"),
    )
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def fold(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of one text and id in one; those that a smaller id of the same text proves copies lose their text."""
    known = rows["digest"].notna() & rows["id"].notna()
    least = rows["id"].where(known).groupby(rows["digest"]).transform("min")
    copy = known & (rows["id"] > least)
    rows = rows.assign(mask=rows["mask"].where(~copy, rows["mask"] | COPY), digest=rows["digest"].where(~copy & known, None), id=rows["id"].where(~copy & known))
    return rows.groupby(["digest", "id", *GROUP], dropna=False, sort=False, as_index=False)["n"].sum()


def _folded(batches: Iterator[pa.RecordBatch], buckets: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def given() -> Iterator[pa.RecordBatch]:
        rows = fold(pa.Table.from_batches(held).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get))
        texts = rows["digest"].notna().to_numpy()
        bucket = np.arange(len(rows)) % buckets  # rows without a text may go anywhere
        bucket[texts] = (np.frombuffer(b"".join(d[:8] for d in rows["digest"][texts]), np.uint64) % np.uint64(buckets)).astype(np.int64)
        rows = rows.assign(digest=rows["digest"].astype(object).where(texts, None))
        rows.insert(0, "bucket", bucket)
        yield pa.RecordBatch.from_pandas(rows, schema=schema, preserve_index=False)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= FOLDED:
            yield from given()
            held = []
    if held:
        yield from given()


class Copies(StatefulProcessor):
    """Keeps the smallest id of each text of a bucket and gives out changes of the counters."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.texts = handle.getListState("texts", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        counted, new = new[new["digest"].isna()], new[new["digest"].notna()]
        changes = [counted[[*GROUP, "n"]]]
        if len(new):
            new = new.assign(digest=new["digest"].map(bytes), id=new["id"].astype("int64"), old=False)[[*COLUMNS, "old"]]
            asked = set(new["digest"])
            # The list is a log: of each text the rows of its smallest id hold.
            log = [r for r in map(tuple, self.texts.get()) if bytes(r[0]) in asked]
            if log:
                held = pd.DataFrame(log, columns=COLUMNS).assign(old=True)
                held["digest"] = held["digest"].map(bytes)
                new = pd.concat([held[held["id"] == held.groupby("digest")["id"].transform("min")], new], ignore_index=True)
            first, old = new["id"] == new.groupby("digest")["id"].transform("min"), new["old"]
            kept, lost = new[~old & first], new[old & ~first]
            copies = new[~first].assign(mask=new["mask"] | COPY)  # new ones and those that held a text until now
            changes += [kept[[*GROUP, "n"]], copies[[*GROUP, "n"]], lost.assign(n=-lost["n"])[[*GROUP, "n"]]]
            if len(kept):
                self.texts.appendList(list(kept[COLUMNS].itertuples(index=False, name=None)))
        out = pd.concat(changes, ignore_index=True).groupby(GROUP, as_index=False)["n"].sum()
        yield out[out["n"] != 0].astype({"mask": "int32", "good": "int32", "toxic": "int32", "n": "int64"})

    def close(self) -> None:
        pass


def counters(spark: SparkSession, path: str, labels: DataFrame, batch_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, good, toxic, n: how many rows of each part fail which filters. path: the Parquet files of the table."""
    bounded_batches(spark)
    table = spark.read.parquet(path)
    rows = table.count()
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    stores = max(STORES, rows // PER_STORE)
    buckets = max(8 * stores, rows // PER_BUCKET)
    flag = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(flag("quality"), flag("toxic"))
    known = materialize(known.select("id", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")), spark, "labels")

    stream = spark.readStream.schema(table.schema).option("maxBytesPerTrigger", str(batch_bytes or max(LEAST_BYTES, size // BATCHES))).parquet(_pattern(path))
    texts = stream.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    narrow = texts.select(F.unhex(F.sha2("text", 256)).alias("digest"), "id", "part", row_mask().alias("mask")).join(known, "id", "left")
    narrow = narrow.select("digest", "id", "part", F.col("mask").cast("int").alias("mask"), *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("good", "toxic")], F.lit(1).cast("long").alias("n"))
    schema = to_arrow_schema(StructType.fromDDL(ROW))
    folded = narrow.mapInArrow(lambda batches: _folded(batches, buckets, schema), ROW)
    changes = folded.groupBy("bucket").transformWithStateInPandas(Copies(), CHANGE, "update", "none")

    out, log = shared_dir(spark, "changes"), shared_dir(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*GROUP).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _state_store(spark, stores):
        query = changes.writeStream.outputMode("update").option("checkpointLocation", log).foreachBatch(write).trigger(availableNow=True).start()
        query.awaitTermination()
    written = spark.read.schema(CHANGE).parquet(out) if query.lastProgress is not None and _exists(spark, out) else spark.createDataFrame([], CHANGE)
    return written.groupBy(*GROUP).agg(F.sum("n").alias("n")).where("n <> 0")


class _state_store:
    """Settings of the state store for as long as a stream runs."""

    WANTED = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # Many small stores: no disk is set aside for each.
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }

    def __init__(self, spark: SparkSession, stores: int):
        self.conf, self.wanted = spark.conf, self.WANTED | {"spark.sql.shuffle.partitions": str(stores)}

    def __enter__(self):
        self.before = {k: self.conf.get(k, None) for k in self.wanted}
        for k, v in self.wanted.items():
            self.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.before.items():
            self.conf.unset(k) if v is None else self.conf.set(k, v)


def _pattern(path: str) -> str:
    """A pattern that finds the path alone: a stream reads a folder by its name, but a single file only by a pattern."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def orders() -> list[tuple[str, int, int, int]]:
    """Each order of the filters and step: the bits of the filters before it, and its own bit."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[k] for k in order)
        out += [(name, step + 1, sum(1 << k for k in order[:step]), 1 << order[step]) for step in range(len(order))]
    return out


def audit(counts: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley from the counters."""
    names = {"n": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}
    passing = lambda value, s: F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) == 0, value).otherwise(0))
    sums = counts.groupBy("part").agg(*[F.array(*[passing(v, s) for s in range(ALL + 1)]).alias(k) for k, v in names.items()])
    steps = F.array(*[F.struct(F.lit(name).alias("filter_order"), F.lit(step).alias("step"), F.lit(before).alias("before"), F.lit(own).alias("own")) for name, step, before, own in orders()])
    rows = sums.select("*", F.inline(steps))
    at = lambda c, s: F.get(c, s)
    after = F.col("before").bitwiseOR(F.col("own"))
    gone = lambda c: at(c, F.col("before")) - at(c, after)
    # A filter removes what passes the set before it and not that set with it; in how many orders a set comes before.
    ways = [factorial(k) * factorial(len(FILTERS) - 1 - k) for k in range(len(FILTERS))]
    others = lambda s: F.lit(s).bitwiseAND(F.col("own")) == 0
    shapley = sum((F.when(others(s), F.lit(ways[s.bit_count()]) * (at("n", F.lit(s)) - at("n", F.lit(s).bitwiseOR(F.col("own"))))).otherwise(0) for s in range(ALL) if s.bit_count() < len(FILTERS)), F.lit(0))
    long = lambda c, name: c.cast("long").alias(name)
    return rows.select(
        "part", "filter_order", "step", long(at("n", after), "kept"), long(gone("n"), "removed"), long(at("n", F.lit(0)) - at("n", F.col("own")) - gone("n"), "redundant"),
        long(at("n", F.lit(ALL).bitwiseXOR(F.col("own"))) - at("n", F.lit(ALL)), "unique_fails"), long(gone("good"), "good_lost"), long(gone("toxic"), "toxic_lost"), long(shapley, "shapley"),
    )
