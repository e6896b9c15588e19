"""Operator 2: BPE encoding and decoding as streaming transducers.

Encoding reads a pre-token byte by byte. The lookahead after which no merge can change a token any
more is computed from the merge list when the transducer is compiled; a token is given out once
that many bytes have been read after its end, so memory does not grow with the pre-token. Short
pre-tokens end within the lookahead and are read many at a time by the same machine. Decoding is a
byte-to-text state machine: bytes of an unfinished character wait for the next token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from headwater.llm import bpe
from headwater.llm.common import column, groups_by_size, ship, texts_of

CHARACTERS_AT_ONCE = 2_000_000
IDS_AT_ONCE = 65_536


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_tokens, ids (binary, little-endian unsigned 32-bit integers).

    Null counts as the empty text and has no ids. Strings of special tokens become their ids, as the
    vocabulary file's library does by default. Other columns are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(column(key).alias(key), column(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = bpe.load(tokenizer)
        for batch in batches:
            texts = texts_of(batch, "__text")
            ids: list[bytes] = []
            for a, b in groups_by_size(texts, CHARACTERS_AT_ONCE):
                ids += machine.encode(texts[a:b])
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(ids, pa.binary())], [key, "n_tokens", "ids"])

    schema = T.StructType([rows.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids added as ``out``; special tokens are written out.

    Bytes that are no UTF-8 become the replacement character. Null ids give the empty text. A column
    called ``out`` is replaced.
    """
    ship(encoded.sparkSession)
    rows = encoded.drop(out)
    place, names = rows.columns.index(ids), [*rows.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = bpe.token_bytes(tokenizer)
        for batch in batches:
            texts = []
            for data in batch.column(place).to_pylist():
                stream, numbers = bpe.TextStream(bytes_of), np.frombuffer(data or b"", "<u4")
                parts = [stream.feed(numbers[i : i + IDS_AT_ONCE].tolist()) for i in range(0, len(numbers), IDS_AT_ONCE)]
                texts.append("".join(parts) + stream.close())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))
