"""Tables that cut lineage: written once to shared storage, then read back."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where it is unset (tests, a local session) it is set below the warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Set while a table is written: its shuffle files are of no more use afterwards and
#: go at once; batches for Python are bounded by bytes, so that long texts fit too.
DURING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20)}


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, for mapInArrow, giving its memory back when its task ends.

    Python workers live on into later stages, and the allocators would keep what
    the earlier ones used.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # The C library may have none.
        if trim is not None:
            trim(0)

    return task


def stored(df: DataFrame, name: str, rows: int | None = None, per_file: int = 200_000) -> DataFrame:
    """Write `df` to the shared folder and return what was written.

    The copy is complete before anything reads it, so a lost executor costs at
    most the tasks that were running. Where a bound on its `rows` is known, it is
    written in files of about `per_file` rows rather than one a task: many tiny
    files cost more than their contents, on any store. Few rows are dealt out
    again for that, so that what computes them stays as wide as it is.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    shaped = df
    if rows is not None:
        files = -(-rows // per_file) or 1
        shaped = df.repartition(files) if files <= 8 else df.coalesce(files)
    before = {key: spark.conf.get(key) for key in DURING}
    for key, value in DURING.items():
        spark.conf.set(key, value)
    try:
        shaped.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by `stored` that nothing reads any more."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(conf).delete(path, True)


class Scratch:
    """The tables of one run, to be deleted together when its result is written."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def stored(self, df: DataFrame, name: str, **options) -> DataFrame:
        table = stored(df, name, **options)
        self.tables.append(table)
        return table

    def clear(self) -> None:
        discard(*self.tables)


def row_key(df: DataFrame) -> Column:
    """A 64-bit hash of a whole row: rows of one key are equal, nulls and all."""
    return F.xxhash64(*(x for c in df.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))))


def without(docs: DataFrame, gone: DataFrame, name: str, broadcast_upto: int = 1_000_000, key: str = "doc_id") -> DataFrame:
    """`docs` without the keys in `gone` (a null key equals a null).

    Up to `broadcast_upto` keys (8 MB) are counted and then sent to the texts;
    beyond that both sides are shuffled.
    """
    gone = stored(gone.select(F.col(key).alias("_gone")).distinct(), name, rows=docs.count())
    ids = F.broadcast(gone) if gone.count() <= broadcast_upto else gone
    return docs.join(ids, docs[key].eqNullSafe(ids["_gone"]), "left_anti").select(*docs.columns)
