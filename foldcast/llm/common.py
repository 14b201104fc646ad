"""Shared storage and Arrow helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, unset on a local master (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='foldcast-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Workspace:
    """Tables that one operator call writes to the shared folder.

    Writing a table cuts the lineage: a lost executor costs only the stage that runs. ``drop`` frees a table as soon
    as nothing lazily depends on it; what the returned frame still reads is removed when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.load(name, df)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))

    def release(self) -> None:
        """Let the driver forget plans that are done with, so that their shuffle files go before the next stage writes its own."""
        gc.collect()
        self.spark._jvm.System.gc()

    def close(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session has ended before the process
            pass


def identified(ws: Workspace, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, bool]:
    """(rows, documents, many): every row as (d, v, t), each document once as (d, v, t), and whether some id has several texts.

    v is 0 where an id has one text and else a hash of the text, so that (d, v) names a document; null counts as an empty
    text. ``documents`` leaves out rows without an id. The list of ids that come more than once is written; where it is
    small, as it is where ids are unique, Spark broadcasts it by the size of its file, else texts are joined in a shuffle.
    """
    base = docs.select(F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    key = F.xxhash64("t")
    counted = base.filter("d is not null").select("d", key.alias("k")).groupBy("d").agg(F.count("k").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    again = ws.save(counted.filter("n > 1").select("d", (F.col("lo") < F.col("hi")).alias("many")), "again")
    marked = base.join(again, "d", "left").select("d", F.when(F.col("many"), key).otherwise(F.lit(0).cast("long")).alias("v"), "t", F.col("many").isNotNull().alias("again"))
    once = marked.filter("d is not null and not again").select("d", "v", "t")
    each = once.union(marked.filter("again").groupBy("d", "v").agg(F.min("t").alias("t")))
    return marked.select("d", "v", "t"), each, not again.filter("many").isEmpty()


#: What operators keep in a worker process from one task to the next, by operator.
KEPT: dict[str, dict] = {}


def only(owner: str) -> None:
    """Drop what operators other than ``owner`` keep in this process."""
    others = [name for name in KEPT if name != owner]
    for name in others:
        del KEPT[name]
    if others:
        gc.collect()
        give_back()


def give_back() -> None:
    """Return free memory of this process to the system; Arrow's pool and glibc hold on to most of it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def worker(owner: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, without what other operators keep in the worker process and without free memory left behind.

    A worker serves one task after another, of any operator, and counts in its executor's memory all the while.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the text of each piece has at most ``most`` bytes (a longer text gets a piece of its own)."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = flat_bytes(batch.column(column))
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield batch.slice(first, last - first)
        first = last


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow column one after another, and n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def held_out(doc_id: str = "doc_id"):
    """True where crc32(doc_id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
