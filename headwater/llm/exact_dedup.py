"""Operator 9: exact deduplication with static binary-fuse filters per immutable snapshot.

The digests of a snapshot are dealt into buckets of bounded size, and each bucket gets a 3-wise
binary-fuse filter of 8-bit fingerprints. Digests of a new batch are grouped among themselves, and
one per group is screened by the filter of its bucket. Positives join the exact digests; the texts
of all groups of two and more are then compared byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.llm.common import column, quoted, ship, staged

KEYS_PER_BUCKET = 50_000
FILTER_SCHEMA = "bucket long, seed long, segment long, segments long, fingerprints binary"


# -- binary-fuse filters, vectorised -----------------------------------------------------------------

def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys ^ np.uint64(seed)
    for constant in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ h >> np.uint64(33)) * np.uint64(constant)
    return h ^ h >> np.uint64(33)


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """The three slots of each hash, in three consecutive segments."""
    first = ((h >> np.uint64(32)) * np.uint64(segment * segments) >> np.uint64(32)).astype(np.int64)
    mask = np.uint64(segment - 1)
    second = first + segment ^ (h >> np.uint64(18) & mask).astype(np.int64)
    third = first + 2 * segment ^ (h & mask).astype(np.int64)
    return np.stack([first, second, third])


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (h ^ h >> np.uint64(32)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """Seed, segment length, number of start segments and fingerprints of a filter of 64-bit keys."""
    keys = np.unique(keys)
    n = max(len(keys), 1)
    segment = 1 << max(2, min(18, int(np.log(n) / np.log(3.33) + 2.25)))
    size = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))))
    segments = max(1, -(-size // segment) - 2)
    for seed in range(1, 1000):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 & 2**64 - 1)
        peeled = _peel(_slots(h, segment, segments), segment * (segments + 2))
        if peeled is not None:
            break
        segments += seed // 8
    else:
        raise RuntimeError("no binary-fuse filter found")
    table, slots, prints = np.zeros(segment * (segments + 2), np.uint8), _slots(h, segment, segments), _fingerprint(h)
    for round_keys, round_slots in reversed(peeled):
        own = slots[:, round_keys]
        table[round_slots] = prints[round_keys] ^ table[own[0]] ^ table[own[1]] ^ table[own[2]]
    return seed, segment, segments, table.tobytes()


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, slots) such that each key is alone in its slot once earlier rounds are gone."""
    numbers = np.arange(slots.shape[1])
    count = np.bincount(slots.ravel(), minlength=size)
    total = np.bincount(slots.ravel(), weights=np.tile(numbers, 3).astype(float), minlength=size).astype(np.int64)
    rounds, left, alone = [], slots.shape[1], np.flatnonzero(count == 1)
    while len(alone):
        keys, first = np.unique(total[alone], return_index=True)
        rounds.append((keys, alone[first]))
        left -= len(keys)
        touched = slots[:, keys].ravel()
        np.subtract.at(count, touched, 1)
        np.subtract.at(total, touched, np.tile(keys, 3))
        touched = np.unique(touched)
        alone = touched[count[touched] == 1]
    return rounds if left == 0 else None


def may_contain(keys: np.ndarray, seed: int, segment: int, segments: int, table: bytes) -> np.ndarray:
    """False only for keys that the filter was not built from."""
    h = _mix(keys, seed * 0x9E3779B97F4A7C15 & 2**64 - 1)
    slots, bits = _slots(h, segment, segments), np.frombuffer(table, np.uint8)
    return (bits[slots[0]] ^ bits[slots[1]] ^ bits[slots[2]]) == _fingerprint(h)


# -- Spark --------------------------------------------------------------------------------------------

def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _key(sha: str) -> Column:
    """64 bits of the digest for the filters."""
    return F.conv(F.substring(sha, 1, 16), 16, -10).cast("long")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def snapshot_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """A filter row per bucket of the snapshot's distinct digests (key). Built once; a snapshot never changes."""
    def build(part: pd.DataFrame) -> pd.DataFrame:
        keys = part["key"].to_numpy(np.int64).astype(np.uint64)
        return pd.DataFrame([(part["bucket"].iloc[0], *build_filter(keys))], columns=["bucket", "seed", "segment", "segments", "fingerprints"])

    keyed = groups.select(_bucket("key", buckets).alias("bucket"), "key")
    return keyed.groupBy("bucket").applyInPandas(build, FILTER_SCHEMA)


def screen(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Rows of ``groups`` (sha, key) whose digest may be in the snapshot. Buckets are of bounded size on both sides."""
    def probe(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if part.empty or own.empty:
            return part[["sha", "key"]].iloc[:0]
        f = own.iloc[0]
        hit = may_contain(part["key"].to_numpy(np.int64).astype(np.uint64), int(f.seed), int(f.segment), int(f.segments), f.fingerprints)
        return part.loc[hit, ["sha", "key"]]

    left = groups.select(_bucket("key", buckets).alias("bucket"), "sha", "key").groupBy("bucket")
    return left.cogroup(filters.groupBy("bucket")).applyInPandas(probe, "sha string, key long")


def grouped(rows: DataFrame) -> DataFrame:
    """One row per distinct digest of a part: combined before the shuffle, so copies cost little."""
    return rows.groupBy("sha").agg(F.count("*").alias("n")).withColumn("key", _key("sha"))


def exact_groups(docs: DataFrame, in_snapshot: Column, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, sha) of ``docs`` and, for each text with two rows or more, its group.

    A group is (sha, keep_id, keep_row, n, n_ties): the largest doc_id stays; of repeated rows with
    that doc_id (n_ties of them) one stays. Null doc_ids come last; a group of null doc_ids alone has a
    null keep_id. Null text is the empty text.
    """
    ship(docs.sparkSession)
    parts = docs.select(
        column(key).alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text"), F.coalesce(in_snapshot, F.lit(False)).alias("old"),
    )
    rows = staged(parts.select(F.monotonically_increasing_id().alias("row"), "doc_id", digest(F.col("text")).alias("sha"), "old"))
    old, new = staged(grouped(rows.where("old"))), staged(grouped(rows.where("NOT old")))
    buckets = max(1, -(-max(old.count(), new.count()) // KEYS_PER_BUCKET))
    filters = staged(snapshot_filters(old, buckets))
    positives = screen(new, filters, buckets).join(old.select("sha"), "sha").select("sha")
    repeated = staged(
        old.where("n > 1").select("sha").union(new.where("n > 1").select("sha")).union(positives).distinct()
    )
    # Byte check. Rows are matched by digest; equal bytes combine before they are shuffled again.
    # Always by a shuffle, which Spark splits at hot texts, so that the cost is in proportion at every size.
    copies = parts.select("text", digest(F.col("text")).alias("sha")).join(repeated.hint("merge"), "sha")
    texts = copies.select("text", F.xxhash64("text").alias("other")).groupBy("other", "text").agg(F.count("*").alias("n"))
    checked = texts.select(digest(F.col("text")).alias("sha"), "n").groupBy("sha").agg(F.count("*").alias("texts"), F.sum("n").alias("checked"))
    chosen = (
        rows.join(repeated, "sha").groupBy("sha", "doc_id").agg(F.count("*").alias("same"), F.max("row").alias("row"))
        .groupBy("sha").agg(F.max(F.struct("doc_id", "row", "same")).alias("top"), F.sum("same").alias("n"))
    )
    sound = F.when((F.col("texts") == 1) & (F.col("checked") == F.col("n")), F.col("n")).otherwise(
        F.raise_error(F.lit("texts of one SHA-256 digest differ, or the input changed while it was read")).cast("long")
    )
    groups = chosen.join(checked, "sha").select(
        "sha", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"), sound.alias("n"), F.col("top.same").alias("n_ties"),
    )
    return rows, staged(groups)


def exact_duplicates(docs: DataFrame, in_snapshot: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256. See ``exact_groups``."""
    rows, groups = exact_groups(docs, in_snapshot, key, text)
    out = rows.join(groups, "sha", "left").select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), F.col("sha").alias("text_sha256"),
    )
    return out if key == "doc_id" else out.withColumnRenamed("doc_id", key)


def drop_exact_duplicates(docs: DataFrame, in_snapshot: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each text, columns unchanged; texts move once."""
    from headwater.llm.common import free_name

    _, groups = exact_groups(docs, in_snapshot, key, text)
    sha = free_name("sha", docs.columns)
    names = {c: free_name(f"group_{c}", docs.columns) for c in ("sha", "keep_id", "n_ties")}
    marked = docs.withColumn(sha, digest(column(text))).join(
        groups.select(*[F.col(c).alias(n) for c, n in names.items()]), F.expr(f"{quoted(sha)} = {quoted(names['sha'])}"), "left"
    )
    own = [column(c) for c in docs.columns]
    alone = marked.where(column(names["sha"]).isNull() | (column(key).eqNullSafe(column(names["keep_id"])) & (column(names["n_ties"]) == 1)))
    if groups.where("n_ties > 1").isEmpty():
        return alone.select(*own)
    ties = marked.where(column(key).eqNullSafe(column(names["keep_id"])) & (column(names["n_ties"]) > 1))
    return alone.select(*own).unionByName(ties.dropDuplicates([sha]).select(*own))


def older_half(docs: DataFrame, key: str = "doc_id") -> Column:
    """The snapshot where a table has none of its own: the lower half of the range of keys."""
    low, high = docs.agg(F.min(column(key)), F.max(column(key))).first()
    return F.lit(False) if low is None else column(key) <= (low + high) // 2
