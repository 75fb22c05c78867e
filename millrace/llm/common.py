"""Helpers shared by the text operators: table reading, staged tables, label splits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.session import ensure_checkpoint_dir, prepare

# Bytes of text that one numpy pass takes; a single longer text is a slice of its own.
SLICE_BYTES = 2 << 20
# Rows of text that Spark hands to a Python worker at once: bounds the memory of both sides.
BATCH_ROWS = "2000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    prepare(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` and survives lost executors, but is columnar and compressed.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """The folder is deleted when the driver's JVM ends, on any file system Hadoop knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def fresh(name: str) -> str:
    """A helper column's name that no table has."""
    return f"_{name}_{uuid.uuid4().hex}"


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Zero-based position of every row in the global ``order``; rows with equal keys follow each other in any order.

    Range partitions are sorted and written once with the row number inside the task; one offset per task is added when
    the rows are read again.  No task sees more than its range.
    """
    raw, task, base, tie = fresh("raw"), fresh("task"), fresh("base"), fresh("tie")
    keys = [*order, F.col(tie)]  # the number of the row splits even equal keys over tasks
    spread = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys)
    rows = staged(spread.sortWithinPartitions(*keys).drop(tie).withColumn(raw, F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.shiftright(raw, 33).alias(task)).count().orderBy(task).collect()  # one row per task
    offsets = [(r[0], b) for r, b in zip(sizes, accumulate((r[1] for r in sizes), initial=0), strict=False)]
    bases = df.sparkSession.createDataFrame(offsets, f"{task} long, {base} long")
    joined = rows.withColumn(task, F.shiftright(raw, 33)).join(F.broadcast(bases), task)
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), (F.col(base) + F.col(raw).bitwiseAND((1 << 33) - 1)).alias(name))


def label_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut a batch into runs of rows of at most ``limit`` text bytes; yields (rows, texts without nulls)."""
    texts = pc.fill_null(batch.column(column), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start), texts.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if start < len(sizes):
        yield batch.slice(start), texts.slice(start)


def annotate(docs: DataFrame, make, fields: str, column: str = "text") -> DataFrame:
    """Add result columns computed from whole texts, slice by slice, inside the scan's own tasks.

    ``make()`` runs once per task and returns ``work(texts) -> list of arrays``, one per field of ``fields`` (a DDL
    string).  Null texts are passed as empty.  A column of ``docs`` that has the name of a result is replaced.
    """
    added = T.StructType.fromDDL(fields)
    kept = [f for f in docs.schema.fields if f.name not in added.names]
    names = [f.name for f in kept] + added.names
    result_types = [to_arrow_type(f.dataType) for f in added.fields]
    # The text is read even if the result replaces its column.
    text = fresh("text")
    source = docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{column}`").cast("string").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for rows, texts in text_slices(batch, text):
                results = [pa.array(r, t) if not isinstance(r, pa.Array) else r for r, t in zip(work(texts), result_types, strict=True)]
                yield pa.RecordBatch.from_arrays(rows.columns[: len(kept)] + results, names=names)

    return source.mapInArrow(run, T.StructType(kept + added.fields))
