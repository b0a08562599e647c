"""Shared scratch tables, code shipping and input hygiene for the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch that goes to Python, whatever the length of its texts.
BATCH_BYTES = 4 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share. Where the cluster names none, only a local session has one:
    its executors are this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "meridia-checkpoints")
    return root.rstrip("/")


def file_system(uri: str):
    """pyarrow's file system and path of a folder on a disk that all executors share, HDFS or an object store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def side_rows(folder: str, part: int, columns: list[str]) -> pa.Table:
    """What ``Workspace.write_parts`` wrote in ``folder`` for one part; no rows where it wrote nothing."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, root = file_system(folder)
    files = fs.get_file_info(pafs.FileSelector(f"{root}/of={part}", allow_not_found=True))
    found = [pq.read_table(f.path, columns=columns, filesystem=fs, partitioning=None) for f in files if f.path.endswith(".parquet")]
    return pa.concat_tables(found).combine_chunks() if found else pa.table({c: pa.array([], pa.bool_() if c == "hot" else pa.int64()) for c in columns})


def free_memory() -> None:
    """Give what a task has freed back to the system, so that a worker that is used again starts small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its memory
        pass


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="meridia-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "meridia_src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of a ``mapInArrow``, with memory given back at the end of each task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            free_memory()

    return tidied


class Workspace:
    """Tables written to the shared folder: they cut lineage, and a lost executor loses none of them.

    Shuffle files of a step are deleted as soon as its table is written.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/meridia-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def path(self, step: str) -> str:
        return f"{self.root}/{step}"

    def write(self, df: DataFrame, step: str) -> DataFrame:
        self._write(df.write, step)
        return self.spark.read.schema(df.schema).parquet(self.path(step))

    def write_parts(self, df: DataFrame, step: str, part: str) -> str:
        """Writes a folder of rows for each value of the int column ``part``, for ``side_rows``; gives the folder.
        A part is what one task of a table's writer wrote, so its rows are bounded as that task's are."""
        self._write(df.withColumnRenamed(part, "of").repartition("of").write.partitionBy("of"), step)
        return self.path(step)

    def _write(self, writer: DataFrameWriter, step: str) -> None:
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, "false")
        self.spark.conf.set(key, "true")
        try:
            writer.mode("overwrite").parquet(self.path(step))
        finally:
            self.spark.conf.set(key, before)

    def drop(self, *steps: str) -> None:
        for step in steps:
            self._delete(self.path(step))

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone at exit; the folder is only scratch
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(target, True)


def texts_by_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text), one row per id: rows with a null id are left out, and of rows that
    share an id the one with the smallest text stays (null text counts as smallest)."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    picked = picked.where(F.col("doc_id").isNotNull())
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull())
    repeated = ids.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        return picked
    return picked.groupBy("doc_id").agg(F.min_by("text", F.coalesce("text", F.lit(""))).alias("text"))
