"""Operator 6: packed token matrices on disk.

Every task encodes its texts, cuts overlong ones into pieces without loss, and packs groups of pieces of
bounded size best-fit decreasing; the sequence with the least sufficient room is found in a segment
tree over capacities. A shard has the id matrix, the cumulative segment lengths and the places where
positions restart. Nothing is shuffled. Files carry the name of their attempt, and only those named in
the returned table count, so lost executors leave nothing that is read.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from headwater.llm.common import column, groups_by_size, shared_folder, ship, staged, texts_of
from headwater.llm.pattern_packing import CHARACTERS_AT_ONCE
from headwater.llm.store import open_store
from headwater.llm.word_ids import encoder

TOKENS_PER_SHARD = 4 << 20
PAD = 0


class CapacityTree:
    """Segment tree over capacities that knows where sequences are open; finds the least sufficient one."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}

    def _change(self, gap: int, by: int) -> None:
        at = gap + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def add(self, gap: int, sequence: int) -> None:
        if gap:
            self.open.setdefault(gap, []).append(sequence)
            self._change(gap, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(gap, sequence) of the smallest gap of at least ``length``, which is closed; None if there is none."""
        at = length + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        gap = at - self.size
        self._change(gap, -1)
        return gap, self.open[gap].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Sequence and offset of each piece, and the number of sequences."""
    tree, sequences = CapacityTree(capacity), 0
    place, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found, sequences = (capacity, sequences), sequences + 1
        gap, place[i] = found
        offset[i] = capacity - gap
        tree.add(gap - lengths[i], place[i])
    return place, offset, sequences


def shard_bytes(ids: list[bytes], place: list[int], offset: list[int], sequences: int, capacity: int) -> bytes:
    """A shard: an ``npz`` with ids (sequences x capacity), cu_seqlens, sequence_starts and position_resets.

    cu_seqlens are the ends of all segments in the flattened matrix, padding at a row's end being a segment
    without a document; position_resets are the flat places where a segment begins; sequence_starts says
    which segment each row begins with.
    """
    kind = np.uint16 if all(np.frombuffer(x, "<u4").max(initial=0) < 65_536 for x in ids) else np.uint32
    matrix = np.full((sequences, capacity), PAD, kind)
    flat = np.array(place, np.int64) * capacity + np.array(offset, np.int64)
    lengths = np.array([len(x) // 4 for x in ids], np.int64)
    whole = matrix.reshape(-1)
    for start, x in zip(flat.tolist(), ids):
        whole[start : start + len(x) // 4] = np.frombuffer(x, "<u4")
    filled = np.bincount(place, weights=lengths, minlength=sequences).astype(np.int64)
    padded = np.flatnonzero(filled < capacity)
    starts = np.sort(np.concatenate([flat, padded * capacity + filled[padded]]))
    ends = np.append(starts[1:], sequences * capacity)
    out = io.BytesIO()
    np.savez(
        out, ids=matrix, cu_seqlens=np.concatenate(([0], ends)), position_resets=starts,
        sequence_starts=np.searchsorted(starts, np.arange(sequences) * capacity),
    )
    return out.getvalue()


def write_matrices(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, folder: str | None = None, key: str = "doc_id", text: str = "text"
) -> tuple[str, DataFrame]:
    """Writes the shards into ``folder`` and returns it with the table of their pieces.

    One row per piece: key, piece, start, length, ids_crc32, shard, sequence, offset. Null text is empty and
    gives one piece with the end token alone. Repeated rows and null keys give pieces of their own.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or shared_folder(spark)
    rows = docs.select(column(key).alias("doc_id"), column(text).cast("string").alias("text"))
    last = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "sequence", "offset"]

    def flush(store, path, keys, pieces) -> pa.RecordBatch:
        lengths = [len(p[2]) // 4 for p in pieces]
        place, offset, sequences = best_fit_decreasing(lengths, capacity)
        name = f"shard-{uuid.uuid4().hex}.npz"
        with store.open_output_stream(f"{path}/{name}", compression=None) as out:
            out.write(shard_bytes([p[2] for p in pieces], place, offset, sequences, capacity))
        columns = [
            pa.array([p[0] for p in pieces], pa.int32()), pa.array([p[1] for p in pieces], pa.int64()), pa.array(lengths, pa.int64()),
            pa.array([zlib.crc32(p[2]) for p in pieces], pa.int64()), pa.array([name] * len(pieces)),
            pa.array(place, pa.int64()), pa.array(offset, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), *columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        keys, pieces, tokens = [], [], 0
        for batch in batches:
            texts = texts_of(batch, "text")
            for a, b in groups_by_size(texts, CHARACTERS_AT_ONCE):
                at = []
                for i, ids in zip(range(a, b), encode(texts[a:b])):
                    ids += last
                    cut = [(n, s // 4, ids[s : s + 4 * capacity]) for n, s in enumerate(range(0, len(ids), 4 * capacity))]
                    pieces += cut
                    at += [i] * len(cut)
                    tokens += len(ids) // 4
                keys.append(batch.column(0).take(pa.array(at, pa.int64())))
                if tokens >= TOKENS_PER_SHARD:
                    yield flush(store, path, keys, pieces)
                    keys, pieces, tokens = [], [], 0
        if pieces:
            yield flush(store, path, keys, pieces)

    schema = T.StructType([
        rows.schema["doc_id"], T.StructField("piece", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in names[2:5]],
        T.StructField("shard", T.StringType()), *[T.StructField(n, T.LongType()) for n in names[6:]],
    ])
    table = staged(rows.mapInArrow(run, schema))
    return folder, table if key == "doc_id" else table.withColumnRenamed("doc_id", key)


def read_pieces(spark: SparkSession, folder: str, table: DataFrame) -> DataFrame:
    """``table`` with the crc32 of the ids of each piece as the shard holds them, and the segment's place found there.

    Pieces are read shard by shard; a shard is of bounded size, and only shards of the table are opened.
    """
    def read(part: pa.Table) -> pa.Table:
        store, path = open_store(folder)
        name = part.column("shard")[0].as_py()
        with store.open_input_file(f"{path}/{name}") as file:
            shard = np.load(io.BytesIO(file.read()))
        ids, resets, ends = shard["ids"], shard["position_resets"], shard["cu_seqlens"][1:]
        sequence, offset, length = (part.column(c).to_numpy() for c in ("sequence", "offset", "length"))
        flat, whole = sequence * ids.shape[1] + offset, ids.reshape(-1)
        at = np.minimum(np.searchsorted(resets, flat), len(resets) - 1)
        sound = (resets[at] == flat) & (ends[at] - resets[at] == length)
        crc = [zlib.crc32(whole[f : f + n].astype("<u4").tobytes()) for f, n in zip(flat.tolist(), length.tolist())]
        return part.append_column("read_crc32", pa.array(crc, pa.int64())).append_column("segment_found", pa.array(sound))

    kind = T.StructType([*table.schema.fields, T.StructField("read_crc32", T.LongType()), T.StructField("segment_found", T.BooleanType())])
    return table.groupBy("shard").applyInArrow(read, kind)
