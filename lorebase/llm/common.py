"""What the operators share: the shared folder, checkpoints, Arrow batch bounds and map-side helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and bytes of one Arrow batch: long texts must not make a batch of gigabytes.
BATCH_ROWS, BATCH_BYTES = "1000", "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    except Exception:  # noqa: BLE001  an older Spark has no such setting
        pass


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder's URI under spark.checkpoint.dir, which the driver and all executors see.

    Only a local session may do without the setting and gets a folder of this machine; on a cluster that's an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lorebase-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/lorebase-{what}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, spark: SparkSession, what: str, *by: str) -> DataFrame:
    """Writes df in the shared folder and reads it again: cuts the lineage, survives lost executors."""
    path = shared_dir(spark, what)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def map_columns(df: DataFrame, id_col: str, text_col: str, out: str, make: Callable[[], Callable[[pa.Array], list]]) -> DataFrame:
    """Maps texts by a function of whole columns and keeps their ids; null texts count as empty.

    make() builds that function once per task; it takes an Arrow column of texts and gives the columns that out names,
    as Arrow arrays, numpy arrays or lists. The rest of df's columns never reach Python, so names that clash with the
    output's do no harm.
    """
    bounded_batches(df.sparkSession)
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = StructType.fromDDL(out).fields
    kinds = [narrow.schema["id"].dataType, *[f.dataType for f in fields]]
    schema = StructType()
    for k, kind in enumerate(kinds):
        schema.add(f"c{k}", kind)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in by_bytes(batch):
                columns = work(pc.fill_null(part.column(1), ""))
                columns = [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, arrow.types[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.types[0]), *columns], schema=arrow)

    return narrow.mapInArrow(run, schema).select(*[F.col(f"c{k}").alias(n) for k, n in enumerate([id_col, *[f.name for f in fields]])])


def map_texts(df: DataFrame, id_col: str, text_col: str, out: str, make: Callable[[], Callable[[list[str]], list[list]]]) -> DataFrame:
    """As map_columns, for a function of lists of texts."""

    def columns():
        work = make()
        return lambda column: work(column.to_pylist())

    return map_columns(df, id_col, text_col, out, columns)


def by_bytes(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about `most` bytes of text, or one row."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for k, n in enumerate(lengths):
        if held and held + n > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += int(n)
    yield batch.slice(start)


def local_path(uri: str) -> tuple[object, str]:
    """The pyarrow file system and path of a URI, for binary files that Spark's writers can't make."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Writes under another name first, so that a reader never sees half a file."""
    system, path = local_path(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with system.open_output_stream(draft) as f:
        f.write(data)
    system.move(draft, path)


def spread_files(names: DataFrame) -> DataFrame:
    """Deals out a list of files, so that many tasks read them: by itself Spark takes so short a list for one task's work."""
    partitions = 8 * int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return names.repartition(max(1, min(names.count(), partitions)))
