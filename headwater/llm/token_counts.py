"""Operator 1: token counts by a compiled finite-state tokenizer.

``bpe.Transducer`` is compiled once per Python worker from the vocabulary file. The pre-token
machine runs over fixed chunks from all its states at once, the chunk maps compose by a parallel
prefix scan, and the byte machine adds the count its transitions carry. No token list is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwater.llm import bpe
from headwater.llm.common import column, groups_by_size, ship, texts_of

CHARACTERS_AT_ONCE = 2_000_000


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_tokens, over_limit.

    Null counts as the empty text, which has no tokens. Repeated rows and repeated or null keys give
    a row each. Other columns are not read, so their names cannot clash. Nothing is shuffled.
    """
    ship(docs.sparkSession)
    rows = docs.select(column(key).alias("doc_id"), column(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = bpe.load(tokenizer)
        for batch in batches:
            texts = texts_of(batch, "text")
            counts: list[int] = []
            for a, b in groups_by_size(texts, CHARACTERS_AT_ONCE):
                counts += machine.count(texts[a:b])
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    counted = rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
    return counted if key == "doc_id" else counted.withColumnRenamed("doc_id", key)
