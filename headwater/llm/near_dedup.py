"""Operator 10: near-duplicate documents by circulant MinHash.

Two random permutations make the whole signature: the first scatters the shingles, the second,
shifted circularly by k, gives coordinate k. Permutations of the 2^32 numbers are bijective mixing
steps, so no table is kept. Bands of the signature bring candidates together; links are confirmed
by exact Jaccard similarity of the full shingle sets, and components run over links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwater.llm.banding import near_components
from headwater.llm.common import column, free_name, ship, staged
from headwater.llm.shingles import band_keys, band_keys_of, bands_for, shingle_hashes, word_hashes

ROWS = 4
RECALL = 0.99999
BLOCK = 4096


def scatter(x: np.ndarray) -> np.ndarray:
    """First permutation of the 32-bit numbers."""
    x = (x ^ x >> np.uint32(16)) * np.uint32(0x21F0AAAD)
    x = (x ^ x >> np.uint32(15)) * np.uint32(0x735A2D97)
    return x ^ x >> np.uint32(15)


def second(x: np.ndarray) -> np.ndarray:
    """Second permutation of the 32-bit numbers; works on ``x`` itself."""
    x ^= x >> np.uint32(17)
    x *= np.uint32(0xED5AD4BB)
    x ^= x >> np.uint32(11)
    x *= np.uint32(0xAC4C1B51)
    x ^= x >> np.uint32(15)
    return x


def circulant_minhash(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates: the least value of the second permutation, shifted by 0, 1, 2, ..."""
    placed = scatter(shingles.astype(np.uint32))
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    least = np.full(size, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(placed), BLOCK):
        least = np.minimum(least, second(placed[None, at : at + BLOCK] - shifts).min(axis=1))
    return least


def circulant_minhash_of(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Signatures of many non-empty sets at once, equal to ``circulant_minhash`` of each."""
    placed = scatter(np.concatenate(sets).astype(np.uint32))
    starts = np.cumsum([0] + [len(x) for x in sets[:-1]])
    out = np.empty((len(sets), size), np.uint32)
    for k in range(size):
        out[:, k] = np.minimum.reduceat(second(placed - np.uint32(k)), starts)
    return out


def signatures(docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, bands) per row; node is a digest of the set, null if it is empty."""
    ship(docs.sparkSession)
    bands = bands_for(percent / 100, RECALL, ROWS)
    rows = docs.select(column(key).alias("doc_id"), F.xxhash64(column(text)).alias("text_hash"), column(text).alias("text"))

    def sign(small: list[tuple[int, np.ndarray]], keys: list) -> None:
        if small:
            rows_of = circulant_minhash_of([found for _, found in small], bands * ROWS)
            for (i, _), row in zip(small, band_keys_of(rows_of, bands, ROWS)):
                keys[i] = row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, keys, small, waiting = [], [], [], [], 0
            for i, value in enumerate(batch.column(2).to_pylist()):
                found = np.unique(shingle_hashes(word_hashes(value), k))
                sizes.append(len(found))
                nodes.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(None)
                if len(found) > BLOCK:
                    keys[i] = band_keys(circulant_minhash(found, bands * ROWS), bands, ROWS)
                elif len(found):
                    small.append((i, found))
                    waiting += len(found)
                if waiting > BLOCK or i == batch.num_rows - 1:
                    sign(small, keys)
                    small, waiting = [], 0
            arrays = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "n_shingles", "node", "bands"])

    return rows.mapInArrow(run, T.StructType([
        rows.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("n_shingles", T.LongType()),
        T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
    ]))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, n_shingles, node) and the group of each node: (node, component_id, keep_hash).

    The component's id is the smallest doc_id in it; null doc_ids come last, so only a component of
    null doc_ids has a null id. keep_hash is the text of that row, which tells rows of one doc_id apart.
    """
    rows = staged(signatures(docs, key, text, k, percent))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash"))
    classes = staged(
        rows.where(F.col("node").isNotNull()).groupBy("node", F.col("n_shingles").alias("n"), "bands").agg(F.min(first).alias("first"))
    )

    def texts_of(needed: DataFrame) -> DataFrame:
        wanted = classes.join(needed, "node").select("node", F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash"))
        texts = docs.select(column(key).alias("doc_id"), column(text).alias("text"))
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("hash"))
        return texts.join(wanted, same).groupBy("node").agg(F.min("text").alias("text"))

    roots = near_components(classes.select("node", "n", "bands"), texts_of, k, percent)
    placed = classes.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    best = placed.groupBy("root").agg(F.min("first").alias("best"))
    groups = placed.select("node", "root").join(best, "root").select(
        "node", F.col("best.doc_id").alias("component_id"), F.col("best.text_hash").alias("keep_hash")
    )
    return rows.drop("bands"), staged(groups)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept.

    Rows without words (null text too) are linked with nothing and stay. Equal sets are linked. Repeated
    rows share a component and have the same verdict. Other columns are not read.
    """
    rows, groups = near_groups(docs, key, text, k, percent)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = rows.join(groups, "node", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
    return out if key == "doc_id" else out.withColumnRenamed("doc_id", key)


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, columns unchanged. Rows that go are matched by key and text."""
    rows, groups = near_groups(docs, key, text, k, percent)
    named = {c: free_name(c, docs.columns) for c in ("gone_id", "gone_hash")}
    gone = staged(
        rows.join(groups, "node")
        .where(~(F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("text_hash").eqNullSafe(F.col("keep_hash"))))
        .select(F.col("doc_id").alias(named["gone_id"]), F.col("text_hash").alias(named["gone_hash"])).distinct()
    )
    match = column(key).eqNullSafe(column(named["gone_id"])) & (F.xxhash64(column(text)) == column(named["gone_hash"]))
    return docs.join(gone, match, "left_anti")
