"""Files as bytes: listed by Spark's own file systems, read by tasks in windows, never whole.

Tasks open files through pyarrow, so a path must be one that both know (file, hdfs, s3 and the like).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

WINDOW = 8 << 20
SNIFF = 1024  # bytes that tell whether a file is a web page


def open_file(uri: str) -> pa.NativeFile:
    """A file of Spark's naming, open for reading and seeking."""
    if uri.startswith("s3a://"):
        uri = "s3" + uri[3:]
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(uri, bytes) of the files of a path, glob or folder, in name order; hidden files are left out."""
    start = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = start.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in store.globStatus(start) or []:
        files = store.listFiles(status.getPath(), True)
        while files.hasNext():
            one = files.next()
            if not one.getPath().getName().startswith(("_", ".")):
                found.append((one.getPath().toString(), one.getLen()))
    return sorted(found)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256, head) of each file of any size: a task hashes a file window by window.

    ``head`` are the first bytes, by which content is told. What is sent to tasks is a list of names.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                sha, size, head = hashlib.sha256(), 0, b""
                with open_file(uri) as source:
                    while window := source.read(WINDOW):
                        head = head or window[:SNIFF]
                        sha.update(window)
                        size += len(window)
                yield pa.RecordBatch.from_pydict(
                    {"path": [uri], "length": [size], "sha256": [sha.hexdigest()], "head": [head]},
                    pa.schema([("path", pa.string()), ("length", pa.int64()), ("sha256", pa.string()), ("head", pa.binary())]),
                )

    names = listed(spark, path)
    # Large files first, each to a task of its own as far as there are tasks.
    frame = spark.createDataFrame(sorted(names, key=lambda f: -f[1]), "path string, size long")
    dealt = frame.select("path").repartition(max(1, min(len(names), 4 * spark.sparkContext.defaultParallelism)))
    return dealt.mapInArrow(digest, "path string, length long, sha256 string, head binary")
