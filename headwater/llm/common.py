"""What the operators share: shipping code, the shared folder, words, names that do not clash."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one Arrow batch, and bytes where they are bound too. Texts are long; a batch of whole texts must stay small in a Python worker.
ROWS_PER_BATCH, BYTES_PER_BATCH = 1000, 4 << 20

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, and keep Arrow batches of texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "headwater_llm.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder in (package, os.path.join(package, "llm")):
            for name in sorted(os.listdir(folder)):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of a few megabytes from now on, however long the texts of their rows are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor and the driver see.

    Only a local session without the setting gets a folder of its own, as in tests.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="headwater-shared-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/headwater-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: lineage ends here.

    A lost executor then costs nothing that was done before, and Spark knows the size of what it reads.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Deletes the folders of staged tables that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished jobs, which Spark deletes when the driver has collected what refers to them."""
    gc.collect()
    spark._jvm.System.gc()


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, with underscores added until no column is called so (case aside)."""
    lower = {name.lower() for name in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str):
    """A column by its exact name, dots and backquotes included."""
    return F.col(quoted(name))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def groups_by_size(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of ``limit`` characters at most, or of one longer text."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [text or "" for text in batch.column(name).to_pylist()]
